"""Spectral collocation: derivatives by momentum space."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .complexes import Z
from .dft import DFT, MODES, total


class SpectralCollocator:
    """Gradient, Laplacian and divergence as i k f and -k^2 f in momentum space; first derivatives of modes n / 2 are 0."""

    def __init__(self, fft: DFT):
        self.fft = fft

    def _first(self) -> list:
        return [F.when(F.abs(F.col(m)) == n // 2, 0.0).otherwise(F.col(m) * float(d)) for m, n, d in zip(MODES, self.fft.lattice.shape, self.fft.dk, strict=True)]

    def __call__(self, df: DataFrame, fx: str, *, lap: str | None = None, pdx: str | None = None, pdy: str | None = None, pdz: str | None = None, grd: tuple[str, str, str] | None = None) -> DataFrame:
        """The keys and the wanted columns."""
        wanted = dict(zip(grd, range(3), strict=True)) if grd else {n: d for d, n in enumerate((pdx, pdy, pdz)) if n}
        modes, scale, first = self.fft.dft(df, fx), 1 / self.fft.lattice.cells, self._first()
        columns = {}
        for name, axis in wanted.items():
            columns |= (Z.of(fx) * Z(0.0, first[axis]) * scale).named(name)
        if lap:
            columns |= (Z.of(fx) * (self.fft.k2() * -scale)).named(lap)
        names = [*wanted, *([lap] if lap else [])]
        return self.fft.idft(modes.withColumns(columns), *names)

    def divergence(self, df: DataFrame, vec: tuple[str, str, str], div: str) -> DataFrame:
        modes, first = self.fft.dft(df, *vec), self._first()
        found = total(Z.of(v) * Z(0.0, first[n]) for n, v in enumerate(vec)) * (1 / self.fft.lattice.cells)
        return self.fft.idft(modes.withColumns(found.named(div)), div)
