"""Projections of vector and tensor modes: transverse, longitudinal, traceless, polarisations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .complexes import Z
from .dft import DFT, total


def tensor_index(i: int, j: int) -> int:
    """The place of component (i, j), 1 to 3 each, of a symmetric tensor's six: 11, 12, 13, 22, 23, 33."""
    a, b = min(i, j), max(i, j)
    return {(1, 1): 0, (1, 2): 1, (1, 3): 2, (2, 2): 3, (2, 3): 4, (3, 3): 5}[a, b]


class Projector:
    """Projections along effective momenta, which are 0 at wavenumbers 0 and n / 2.

    ``effective_k`` is a callable (k, dx), the halo of a first difference, or 0 for the continuum.
    The first step writes the momenta to columns, so each is looked up once; they are dropped at the end.
    """

    def __init__(self, fft: DFT, effective_k=0):
        self.fft, self.effective_k = fft, effective_k
        self.k = [F.col(f"__k{a}") for a in "xyz"]
        self.kmag, self.kappa = F.col("__k"), F.col("__kappa")
        self.no_k = (F.abs(self.k[0]) < 1e-14) & (F.abs(self.k[1]) < 1e-14) & (F.abs(self.k[2]) < 1e-14)

    def _with_momenta(self, modes: DataFrame) -> DataFrame:
        out = modes.withColumns({f"__k{a}": k for a, k in zip("xyz", self.fft.effective(self.effective_k), strict=True)})
        k = self.k
        return out.withColumns({"__k": F.sqrt(k[0] * k[0] + k[1] * k[1] + k[2] * k[2]), "__kappa": F.sqrt(k[0] * k[0] + k[1] * k[1])})

    def _write(self, modes: DataFrame, results: dict[str, Z], drop: tuple[str, ...] = ()) -> DataFrame:
        columns = {}
        for name, z in results.items():
            columns |= z.named(name)
        out = modes.withColumns(columns)
        return out.drop("__kx", "__ky", "__kz", "__k", "__kappa", *[f"{d}_{p}" for d in drop for p in ("re", "im")])

    def _over(self, a: Column, b: Column) -> Column:
        return F.when(b > 0, a / F.when(b > 0, b)).otherwise(0.0)

    def _eps(self) -> list[Z]:
        """The polarisation vector; along z where kx = ky = 0."""
        k, root = self.k, math.sqrt(2)
        flat = (F.abs(k[0]) < 1e-10) & (F.abs(k[1]) < 1e-10)
        up = F.when(F.abs(k[2]) > 1e-10, 1 / root).otherwise(0.0)
        over = lambda x: self._over(x, self.kappa) / root
        tilt = self._over(k[2], self.kmag)
        first = Z(over(k[0] * tilt), over(-k[1])).where(~flat, Z(up, 0.0))
        second = Z(over(k[1] * tilt), over(k[0])).where(~flat, Z(F.lit(0.0), up))
        third = Z(F.when(~flat, -self._over(self.kappa, self.kmag) / root).otherwise(0.0), 0.0)
        return [first, second, third]

    def _div(self, vector: tuple[str, ...]) -> Z:
        return total(Z.of(v) * self.k[n] for n, v in enumerate(vector))

    def transversify(self, modes: DataFrame, vector: tuple[str, str, str]) -> DataFrame:
        """v - k (k.v) / k^2 in place; 0 for k = 0."""
        modes = self._with_momenta(modes)
        div = self._div(vector)
        k2 = self.kmag * self.kmag
        return self._write(modes, {v: (Z.of(v) - div * self._over(self.k[n], k2)).where(~self.no_k) for n, v in enumerate(vector)})

    def vec_to_pol(self, modes: DataFrame, vector: tuple[str, str, str]) -> DataFrame:
        """Columns plus and minus in place of the vector."""
        eps = self._eps()
        found = {"plus": total(Z.of(v) * e.conj() for v, e in zip(vector, eps, strict=True)), "minus": total(Z.of(v) * e for v, e in zip(vector, eps, strict=True))}
        return self._write(self._with_momenta(modes), found, vector)

    def pol_to_vec(self, modes: DataFrame, vector: tuple[str, str, str]) -> DataFrame:
        """The transverse vector of columns plus and minus, in their place."""
        found = {v: Z.of("plus") * e + Z.of("minus") * e.conj() for v, e in zip(vector, self._eps(), strict=True)}
        return self._write(self._with_momenta(modes), found, ("plus", "minus"))

    def decompose_vector(self, modes: DataFrame, vector: tuple[str, str, str], times_abs_k: bool = False) -> DataFrame:
        """Columns plus, minus and lng in place of the vector; lng = -i k.v / k^2, or -i k.v / k with ``times_abs_k``."""
        eps, div = self._eps(), self._div(vector)
        below = self.kmag if times_abs_k else self.kmag * self.kmag
        found = {"plus": total(Z.of(v) * e.conj() for v, e in zip(vector, eps, strict=True)), "minus": total(Z.of(v) * e for v, e in zip(vector, eps, strict=True))}
        found["lng"] = (div * Z(0.0, -1.0) * self._over(F.lit(1.0), below)).where(~self.no_k)
        return self._write(self._with_momenta(modes), found, vector)

    def decomp_to_vec(self, modes: DataFrame, vector: tuple[str, str, str], times_abs_k: bool = False) -> DataFrame:
        """The inverse of ``decompose_vector`` with the same flag."""
        found = {}
        for n, (v, e) in enumerate(zip(vector, self._eps(), strict=True)):
            along = self._over(self.k[n], self.kmag) if times_abs_k else self.k[n]
            found[v] = Z.of("plus") * e + Z.of("minus") * e.conj() + (Z.of("lng") * Z(0.0, 1.0) * along).where(~self.no_k)
        return self._write(self._with_momenta(modes), found, ("plus", "minus", "lng"))

    def transverse_traceless(self, modes: DataFrame, hij: tuple[str, ...]) -> DataFrame:
        """(P_ac P_db - P_ab P_cd / 2) h_cd in place; 0 for k = 0."""
        hat = [self._over(k, self.kmag) for k in self.k]
        modes = self._with_momenta(modes)
        modes = modes.withColumns({f"__P{a}{b}": F.lit(float(a == b)) - hat[a - 1] * hat[b - 1] for a in range(1, 4) for b in range(a, 4)})
        p = {(a, b): F.col(f"__P{min(a, b)}{max(a, b)}") for a in range(1, 4) for b in range(1, 4)}
        found = {}
        for a in range(1, 4):
            for b in range(a, 4):
                parts = (Z.of(hij[tensor_index(c, d)]) * (p[a, c] * p[d, b] - p[a, b] * p[c, d] / 2) for c in range(1, 4) for d in range(1, 4))
                found[hij[tensor_index(a, b)]] = total(parts).where(~self.no_k)
        return self._write(modes, found).drop(*[f"__P{a}{b}" for a in range(1, 4) for b in range(a, 4)])

    def tensor_to_pol(self, modes: DataFrame, hij: tuple[str, ...]) -> DataFrame:
        """Columns plus and minus in place of the tensor."""
        eps = self._eps()
        of = lambda e: total(Z.of(hij[tensor_index(c, d)]) * e[c - 1] * e[d - 1] for c in range(1, 4) for d in range(1, 4))
        return self._write(self._with_momenta(modes), {"plus": of([e.conj() for e in eps]), "minus": of(eps)}, hij)

    def pol_to_tensor(self, modes: DataFrame, hij: tuple[str, ...]) -> DataFrame:
        """The tensor of columns plus and minus, in their place."""
        eps = self._eps()
        found = {hij[tensor_index(a, b)]: Z.of("plus") * eps[a - 1] * eps[b - 1] + Z.of("minus") * eps[a - 1].conj() * eps[b - 1].conj() for a in range(1, 4) for b in range(a, 4)}
        return self._write(self._with_momenta(modes), found, ("plus", "minus"))
