"""Discrete Fourier transforms, an axis at a time.

Each pass collects the lattice lines along one axis (as many values as the axis has
cells) and transforms them as vectors, so a transform of n cells costs three shuffles of n
rows and n log n operations. Real fields are transformed along the last axis first, which halves the
modes that the other passes move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lattice import Lattice
from .complexes import Z

MODES = ("kx", "ky", "kz")


def fftfreq(n: int) -> np.ndarray:
    """Integer wavenumbers in the order of the transform; that of n / 2 is positive."""
    m = np.arange(n)
    return np.where(m <= n // 2, m, m - n)


def _pass(df: DataFrame, keys: list[str], axis: str, names: list[str], n: int, kind: str, n_out: int) -> DataFrame:
    """Transform columns name_re, name_im along ``axis`` (0 to n - 1) in each group of ``keys``; kind is fft, ifft, rfft or irfft."""
    parts = [f"{name}_{p}" for name in names for p in ("re", "im")]
    lines = df.groupBy(*keys).agg(F.collect_list(F.struct(F.col(axis).cast("int").alias("at"), *[F.col(p).cast("double").alias(p) for p in parts])).alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            line = batch.column(batch.num_columns - 1)
            row = np.repeat(np.arange(len(line)), np.diff(line.offsets.to_numpy()))
            flat = line.flatten()
            at = flat.field(0).to_numpy()
            out = []
            for c in range(len(names)):
                dense = np.zeros((len(line), n if kind != "irfft" else n // 2 + 1), complex)
                dense[row, at] = flat.field(1 + 2 * c).to_numpy() + 1j * flat.field(2 + 2 * c).to_numpy()
                found = {
                    "fft": lambda x: np.fft.fft(x, axis=1),
                    "ifft": lambda x: np.fft.ifft(x, axis=1) * n,
                    "rfft": lambda x: np.fft.rfft(x.real, axis=1),
                    "irfft": lambda x: np.fft.irfft(x, n, axis=1) * n + 0j,
                }[kind](dense)
                out += [pa.array(list(np.ascontiguousarray(p)), pa.list_(pa.float64())) for p in (found.real, found.imag)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *out], [*batch.schema.names[:-1], *parts])

    kinds = ", ".join([f"{k} {lines.schema[k].dataType.simpleString()}" for k in keys] + [f"{p} array<double>" for p in parts])
    spread = lines.mapInArrow(run, kinds)
    at = F.sequence(F.lit(0), F.lit(n_out - 1)).alias(axis)
    return spread.select(*keys, F.inline(F.arrays_zip(at, *parts)))


class DFT:
    """Transforms of the fields of a lattice, even along each axis.

    A mode frame has the outer keys, integer wavenumbers kx, ky, kz (that of n / 2 is
    positive), and for each field its columns name_re and name_im. Modes of a real field have kz from 0
    to n / 2. Neither direction is normalised: idft(dft(f)) is f times the number of cells.
    """

    def __init__(self, lattice: Lattice, is_real: bool = True):
        if any(n % 2 and n > 1 for n in lattice.shape):
            raise ValueError(f"odd axes in {lattice.shape}: their highest mode has no pair")
        self.lattice, self.is_real = lattice, is_real
        self.dk = tuple(2 * np.pi / (n * d) for n, d in zip(lattice.shape, lattice.spacing, strict=True))
        nz = lattice.shape[2]
        self.mode_shape = (*lattice.shape[:2], nz // 2 + 1 if is_real else nz)

    @property
    def mode_keys(self) -> list[str]:
        return [*self.lattice.outer, *MODES]

    def _signed(self, name: str, n: int) -> Column:
        return F.when(F.col(name) <= n // 2, F.col(name)).otherwise(F.col(name) - n).cast("int")

    def dft(self, df: DataFrame, *fields: str) -> DataFrame:
        """Real fields in columns of their name, or complex ones in name_re and name_im."""
        outer, (i, j, k), (ni, nj, nk) = list(self.lattice.outer), self.lattice.axes, self.lattice.shape
        values = []
        for f in fields:
            re, im = (f, None) if f in df.columns else (f"{f}_re", f"{f}_im")
            values += [F.col(re).cast("double").alias(f"{f}_re"), (F.col(im).cast("double") if im and not self.is_real else F.lit(0.0)).alias(f"{f}_im")]
        names = list(fields)
        out = df.select(*outer, *self.lattice.axes, *values)
        out = _pass(out, [*outer, i, j], k, names, nk, "rfft" if self.is_real else "fft", self.mode_shape[2])
        out = _pass(out, [*outer, i, k], j, names, nj, "fft", nj)
        out = _pass(out, [*outer, j, k], i, names, ni, "fft", ni)
        parts = [f"{f}_{p}" for f in names for p in ("re", "im")]
        signed = [self._signed(a, n).alias(m) for a, n, m in zip((i, j, k), (ni, nj, nk), MODES, strict=True)]
        return out.select(*outer, *signed, *parts)

    def idft(self, modes: DataFrame, *fields: str) -> DataFrame:
        """The fields of a mode frame, not normalised: columns of their name, or name_re and name_im if complex."""
        outer, (i, j, k), (ni, nj, nk) = list(self.lattice.outer), self.lattice.axes, self.lattice.shape
        names = list(fields)
        places = [F.pmod(F.col(m), F.lit(n)).alias(a) for m, n, a in zip(MODES, (ni, nj, nk), (i, j, k), strict=True)]
        out = modes.select(*outer, *places, *[f"{f}_{p}" for f in names for p in ("re", "im")])
        out = _pass(out, [*outer, j, k], i, names, ni, "ifft", ni)
        out = _pass(out, [*outer, i, k], j, names, nj, "ifft", nj)
        out = _pass(out, [*outer, i, j], k, names, nk, "irfft" if self.is_real else "ifft", nk)
        values = [F.col(f"{f}_re").alias(f) for f in names] if self.is_real else [f"{f}_{p}" for f in names for p in ("re", "im")]
        return out.select(*outer, F.col(i).cast("int"), F.col(j).cast("int"), F.col(k).cast("int"), *values)

    def grid(self, spark) -> DataFrame:
        """All modes."""
        ni, nj, nk = self.mode_shape
        # Integers all the way, exact beyond 2 ** 53.
        whole = lambda n: F.expr(f"id div {n}L")
        places = [whole(nj * nk), F.pmod(whole(nk), F.lit(nj)), F.pmod(F.col("id"), F.lit(nk))]
        rows = spark.range(ni * nj * nk).select(*[p.alias(m) for p, m in zip(places, MODES, strict=True)])
        return rows.select(*[self._signed(m, n).alias(m) for m, n in zip(MODES, self.lattice.shape, strict=True)])

    def corner(self) -> Column:
        """Whether all of a mode's wavenumbers are 0 or n / 2."""
        found = F.lit(True)
        for m, n in zip(MODES, self.lattice.shape, strict=True):
            found = found & ((F.col(m) == 0) | (F.abs(F.col(m)) == n // 2))
        return found

    def zero_corner_modes(self, modes: DataFrame, *fields: str, only_imag: bool = False) -> DataFrame:
        """Set the corner modes to 0, or make them real."""
        return modes.withColumns({f"{f}_{p}": F.when(self.corner(), 0.0).otherwise(F.col(f"{f}_{p}")) for f in fields for p in (("im",) if only_imag else ("re", "im"))})

    def k2(self) -> Column:
        return sum((F.col(m) * float(d)) * (F.col(m) * float(d)) for m, d in zip(MODES, self.dk, strict=True))

    def weight(self) -> Column:
        """How many modes of the full transform a mode stands for."""
        if not self.is_real:
            return F.lit(1.0)
        return F.when((F.col("kz") > 0) & (F.col("kz") < self.lattice.shape[2] // 2), 2.0).otherwise(1.0)

    def effective(self, effective_k, zero_nyquist: bool = True) -> list[Column]:
        """Effective momentum along each axis: a halo's first difference, 0 for the continuum, or a callable (k, dx) over arrays.

        The first two are formulas of the wavenumber, whatever the axis's length. Only a callable, which may be any Python, is
        tabulated, as an array of an axis's cells in the plan; if it is a centred difference's ``get_eigenvalues``, it too is a formula.
        """
        from ..stencil import CenteredDifference, FirstCenteredDifference

        difference = getattr(effective_k, "__self__", None)
        if not callable(effective_k):
            difference = FirstCenteredDifference(effective_k) if effective_k else None
        out = []
        for mode, n, dk, dx in zip(MODES, self.lattice.shape, self.dk, self.lattice.spacing, strict=True):
            m, k = F.col(mode), F.col(mode) * float(dk)
            if isinstance(difference, CenteredDifference):
                found = difference.eigenvalue(k, dx)
            elif not callable(effective_k):
                found = k
            else:
                values = np.asarray(effective_k(dk * fftfreq(n).astype(float), dx), float)
                found = F.get(F.array(*[F.lit(float(x)) for x in values]), F.pmod(m, F.lit(n)))
            out.append(F.when((m == 0) | (F.abs(m) == n // 2), 0.0).otherwise(found) if zero_nyquist else found)
        return out


def total(parts) -> Z:
    out = Z(0.0)
    for p in parts:
        out = out + p
    return out
