"""Gaussian random fields drawn in momentum space.

Draws are hashes of a mode's wavenumbers and the seed, so a field is the same however its
modes are partitioned and whenever a task is run again. Of two modes that a real field ties
together one is drawn and the other is its conjugate.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .complexes import Z
from .dft import DFT
from .projectors import Projector


def _one(k: Column) -> Column:
    return F.lit(1.0)


class RayleighGenerator:
    """Fields of a given power spectrum; ``field_ps``, ``window`` and ``omega_k`` are functions of a column of momenta."""

    def __init__(self, spark: SparkSession, fft: DFT, seed: int = 13298):
        self.spark, self.fft, self.seed = spark, fft, seed

    def _uniform(self, n: int) -> Column:
        """In (0, 1), by the mode's representative."""
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(self.seed), F.lit(n), "__rx", "__ry", "__rz"), 11)
        return (bits.cast("double") + 0.5) / float(1 << 53)

    def _modes(self) -> DataFrame:
        """All modes with __k, the representative __rx, __ry, __rz that is drawn, and the sign __flip of the conjugate. Every draw is a function of this row."""
        ni, nj, nk = self.fft.lattice.shape
        kx, ky, kz = (F.col(m) for m in ("kx", "ky", "kz"))
        modes = self.fft.grid(self.spark)
        tied = (kz == 0) | (kz == nk // 2) if self.fft.is_real else F.lit(False)
        # The opposite of a wavenumber; n / 2 is its own.
        opposite = [F.when(k == n // 2, k).otherwise(-k) for k, n in ((kx, ni), (ky, nj))]
        later = tied & ((kx > opposite[0]) | ((kx == opposite[0]) & (ky > opposite[1])))
        own = tied & (kx == opposite[0]) & (ky == opposite[1])
        pick = lambda a, b: F.when(later, b).otherwise(a)
        return modes.select("*", pick(kx, opposite[0]).alias("__rx"), pick(ky, opposite[1]).alias("__ry"), kz.alias("__rz"), F.when(own, 0.0).when(later, -1.0).otherwise(1.0).alias("__flip"), F.sqrt(self.fft.k2()).alias("__k"))

    def _power(self, field_ps: Callable[[Column], Column], norm: float, window: Callable[[Column], Column]) -> Column:
        k = F.when(F.col("__k") > 0, F.col("__k"))
        return F.coalesce(norm / self.fft.lattice.volume * window(k) * window(k) * field_ps(k), F.lit(0.0))

    def _mode(self, power: Column, salt: int, n: int, random: bool) -> Z:
        """Draws n and n + 1 of a salt: the amplitude, 1 without ``random``, and the phase."""
        amplitude = F.sqrt(-F.ln(self._uniform(salt * 16 + n))) if random else F.lit(1.0)
        size, phase = amplitude * F.sqrt(power), self._uniform(salt * 16 + n + 1) * (2 * math.pi)
        return Z(size * F.cos(phase), size * F.sin(phase) * F.col("__flip"))

    def _clean(self, modes: DataFrame) -> DataFrame:
        return modes.select(*[c for c in modes.columns if not c.startswith("__")])

    def generate(self, name: str, field_ps: Callable[[Column], Column], *, random: bool = True, norm: float = 1.0, window: Callable[[Column], Column] = _one, salt: int = 0) -> DataFrame:
        """Modes sqrt(-ln u1) e^(2 pi i u2) sqrt(P), P = norm / V window^2 field_ps(k); without ``random`` all amplitudes are 1."""
        return self._clean(self._modes().withColumns(self._mode(self._power(field_ps, norm, window), salt, 0, random).named(name)))

    def generate_WKB(self, name: str, rate: str, field_ps, omega_k: Callable[[Column], Column], *, hubble: float = 0.0, random: bool = True, norm: float = 1.0, window=_one, salt: int = 0) -> DataFrame:  # noqa: N802
        """Modes and their time derivatives from left and right movers."""
        modes, power = self._modes(), self._power(field_ps, norm, window)
        left, right = (self._mode(power, salt, n, random) for n in (0, 2))
        field = (left + right) * (1 / math.sqrt(2))
        omega = F.coalesce(omega_k(F.col("__k")), F.lit(0.0))
        # The conjugate of a mode has the conjugate of its derivative, so i changes sign with it.
        turn = Z(0.0, F.when(F.col("__flip") == 0, 0.0).otherwise(F.col("__flip")) * omega / math.sqrt(2))
        moved = (left - right) * turn
        return self._clean(modes.withColumns(field.named(name) | (moved - field * hubble).named(rate)))

    def init_field(self, name: str, field_ps, **options) -> DataFrame:
        return self.fft.idft(self.generate(name, field_ps, **options), name)

    def init_WKB_fields(self, name: str, rate: str, field_ps, omega_k, **options) -> DataFrame:  # noqa: N802
        return self.fft.idft(self.generate_WKB(name, rate, field_ps, omega_k, **options), name, rate)

    def _several(self, fields: dict[str, tuple[Callable, int]], *, random: bool = True, norm: float = 1.0, window: Callable[[Column], Column] = _one) -> DataFrame:
        """Modes of several fields, each of its own spectrum and salt, in one pass over the grid."""
        columns = {}
        for name, (field_ps, salt) in fields.items():
            columns |= self._mode(self._power(field_ps, norm, window), salt, 0, random).named(name)
        return self._clean(self._modes().withColumns(columns))

    def init_transverse_vector(self, projector: Projector, vector: tuple[str, str, str], field_ps, **options) -> DataFrame:
        modes = self._several({name: (field_ps, n + 1) for n, name in enumerate(vector)}, **options)
        return self.fft.idft(projector.transversify(modes, vector), *vector)

    def init_vector_from_pol(self, projector: Projector, vector: tuple[str, str, str], plus_ps, minus_ps, **options) -> DataFrame:
        modes = self._several({"plus": (plus_ps, 8), "minus": (minus_ps, 9)}, **options)
        return self.fft.idft(projector.pol_to_vec(modes, vector), *vector)


def make_hermitian(modes: DataFrame, fft: DFT, *fields: str) -> DataFrame:
    """Give tied modes of a real field conjugate values: the one of the smaller wavenumbers decides, and modes tied to themselves are real."""
    ni, nj, nk = fft.lattice.shape
    kx, ky, kz = (F.col(m) for m in ("kx", "ky", "kz"))
    tied = (kz == 0) | (kz == nk // 2)
    opposite = [F.when(k == n // 2, k).otherwise(-k) for k, n in ((kx, ni), (ky, nj))]
    later = tied & ((kx > opposite[0]) | ((kx == opposite[0]) & (ky > opposite[1])))
    own = tied & (kx == opposite[0]) & (ky == opposite[1])
    pick = lambda a, b: F.when(later, b).otherwise(a).cast("int")
    keyed = modes.withColumns({"__x": pick(kx, opposite[0]), "__y": pick(ky, opposite[1]), "__later": later, "__own": own})
    lead = keyed.where(~F.col("__later")).select(*fft.lattice.outer, F.col("__x"), F.col("__y"), "kz", *[F.col(f"{f}_{p}").alias(f"__{f}_{p}") for f in fields for p in ("re", "im")])
    joined = keyed.join(lead, [*fft.lattice.outer, "__x", "__y", "kz"])
    columns = {}
    for f in fields:
        columns[f"{f}_re"] = F.col(f"__{f}_re")
        columns[f"{f}_im"] = F.when(F.col("__own"), 0.0).otherwise(F.when(F.col("__later"), -F.col(f"__{f}_im")).otherwise(F.col(f"__{f}_im")))
    return joined.withColumns(columns).select(*modes.columns)
