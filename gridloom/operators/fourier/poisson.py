"""The Poisson equation with a linear term, by momentum space."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .complexes import Z
from .dft import DFT, MODES


class SpectralPoissonSolver:
    """Solves lap f - m^2 f = rho. ``effective_k2(k, dx)`` gives the Laplacian's eigenvalue along an axis, such as
    ``SecondCenteredDifference(h).get_eigenvalues``, so the solution is exact for that stencil. The mode
    without momentum is 0, for any m."""

    def __init__(self, fft: DFT, effective_k2=lambda k, dx: -(k**2)):
        self.fft, self.effective_k2 = fft, effective_k2

    def __call__(self, df: DataFrame, rho: str, f: str, m_squared: float = 0.0) -> DataFrame:
        """The keys and the solution."""
        modes = self.fft.dft(df, rho)
        eigen = sum(self.fft.effective(self.effective_k2, zero_nyquist=False), F.lit(0.0))
        still = (F.col(MODES[0]) == 0) & (F.col(MODES[1]) == 0) & (F.col(MODES[2]) == 0)
        below = F.when((eigen < 0) & ~still, eigen - m_squared)
        solved = (Z.of(rho) * F.coalesce(F.lit(1 / self.fft.lattice.cells) / below, F.lit(0.0))).named(f)
        return self.fft.idft(modes.withColumns(solved), f)
