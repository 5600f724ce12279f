"""Power spectra: modes binned by the size of their momentum."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .complexes import Z
from .dft import DFT
from .projectors import Projector, tensor_index


#: Momenta so close below the middle between two bins, in bins, count as in the middle and so to the higher bin: sums of squares differ in their last bits.
TIE = 1e-9


class PowerSpectra:
    """Binned spectra of fields on a lattice; bin b holds momenta that round to b times the bin width.

    Results have outer keys, bin, modes and a column of power for each field. Bins without
    modes have none.
    """

    def __init__(self, fft: DFT, bin_width: float | None = None):
        self.fft, self.lattice = fft, fft.lattice
        self.bin_width = bin_width or min(fft.dk)
        volume = self.lattice.volume
        self.norm = 1 / (2 * math.pi**2 * volume) * (volume / self.lattice.cells) ** 2
        highest = math.sqrt(sum((d * (n // 2)) ** 2 for d, n in zip(fft.dk, self.lattice.shape, strict=True)))
        self.num_bins = int(highest / self.bin_width + 0.5) + 1

    def _bin(self, modes: DataFrame, powers: dict[str, Column], k_power: float, norm: float) -> DataFrame:
        k = F.sqrt(self.fft.k2())
        bin_ = F.floor(k / self.bin_width + F.lit(0.5 + TIE)).cast("int")
        weight = self.fft.weight() * (F.pow(k, F.lit(float(k_power))) if k_power else F.lit(1.0))
        rows = modes.select(*self.lattice.outer, bin_.alias("bin"), self.fft.weight().alias("modes"), *[(weight * p).alias(n) for n, p in powers.items()])
        sums = rows.groupBy(*self.lattice.outer, "bin").agg(F.sum("modes").alias("modes"), *[(F.sum(n) / F.sum("modes") * norm).alias(n) for n in powers])
        return sums

    def bin_power(self, modes: DataFrame, *fields: str, k_power: float = 3) -> DataFrame:
        """Weighted by k ** k_power, averaged over the modes of a bin; not normalised."""
        return self._bin(modes, {f: Z.of(f).abs2() for f in fields}, k_power, 1.0)

    def __call__(self, df: DataFrame, *fields: str, k_power: float = 3) -> DataFrame:
        """Spectra of fields in position space."""
        return self._bin(self.fft.dft(df, *fields), {f: Z.of(f).abs2() for f in fields}, k_power, self.norm)

    def polarization(self, df: DataFrame, vector: tuple[str, str, str], projector: Projector, k_power: float = 3) -> DataFrame:
        """Spectra ``plus`` and ``minus`` of a vector's polarisations."""
        modes = projector.vec_to_pol(self.fft.dft(df, *vector), vector)
        return self._bin(modes, {n: Z.of(n).abs2() for n in ("plus", "minus")}, k_power, self.norm)

    def vector_decomposition(self, df: DataFrame, vector: tuple[str, str, str], projector: Projector, k_power: float = 3) -> DataFrame:
        """Spectra ``plus``, ``minus`` and ``lng`` (the longitudinal part, times k)."""
        modes = projector.decompose_vector(self.fft.dft(df, *vector), vector, times_abs_k=True)
        return self._bin(modes, {n: Z.of(n).abs2() for n in ("plus", "minus", "lng")}, k_power, self.norm)

    def gw(self, df: DataFrame, hij: tuple[str, ...], projector: Projector, hubble: float, k_power: float = 3) -> DataFrame:
        """The spectrum ``gw`` of the transverse and traceless part of a symmetric tensor, all nine components."""
        modes = projector.transverse_traceless(self.fft.dft(df, *hij), hij)
        power = sum((Z.of(hij[tensor_index(a, b)]).abs2() for a in range(1, 4) for b in range(1, 4)), F.lit(0.0))
        return self._bin(modes, {"gw": power}, k_power, self.norm / 12 / hubble**2)

    def gw_polarization(self, df: DataFrame, hij: tuple[str, ...], projector: Projector, hubble: float, k_power: float = 3) -> DataFrame:
        """Spectra ``plus`` and ``minus`` of a tensor's polarisations."""
        modes = projector.tensor_to_pol(self.fft.dft(df, *hij), hij)
        return self._bin(modes, {n: Z.of(n).abs2() for n in ("plus", "minus")}, k_power, self.norm / 12 / hubble**2)
