"""Moving fields between a lattice and the one of half its cells along each axis.

Both ways scatter, an axis at a time: a cell sends its weighted value to the cells of the other
lattice that take from it. Weights are products over the axes, so three passes move fewer rows
than one over all products would.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lattice import Lattice


class _Transfer:
    def _columns(self, df: DataFrame, lattice: Lattice, names: tuple[str, ...]) -> list[str]:
        return list(names) or lattice.values(df)

    def _correct(self, coarse_or_fine: DataFrame, lattice: Lattice, change: DataFrame, names: list[str], sign: int) -> DataFrame:
        moved = change.select(*lattice.keys, *[F.col(n).alias(f"__{n}") for n in names])
        joined = coarse_or_fine.join(moved, lattice.keys)
        return joined.withColumns({n: F.col(n) + sign * F.col(f"__{n}") for n in names}).drop(*[f"__{n}" for n in names])


def _send(df: DataFrame, lattice: Lattice, axis: str, names: list[str], cells: list[tuple[Column, float]]) -> DataFrame:
    """Send each cell's values, weighted, to other places along one axis (null: nowhere) and add up what arrives."""
    parts = [F.when(place.isNotNull(), F.struct(place.cast("int").alias(axis), *[(w * F.col(n)).alias(n) for n in names])) for place, w in cells]
    rest = [k for k in lattice.keys if k != axis]
    sent = df.select(*rest, F.inline(F.filter(F.array(*parts), lambda x: x.isNotNull())))
    return sent.groupBy(*lattice.keys).agg(*[F.sum(n).alias(n) for n in names])


class Restriction(_Transfer):
    """Coarse cell i takes fine cells 2i + offset, weighted by ``coefs`` along each axis in turn."""

    coefs: Mapping[int, float] = {}

    def __call__(self, fine: DataFrame, lattice: Lattice, *names: str) -> DataFrame:
        """Keys of the coarse lattice and the restricted columns (all of them unless named)."""
        names = self._columns(fine, lattice, names)
        lattice.coarser()  # raises if it can't be halved
        out = fine
        for axis, n in zip(lattice.axes, lattice.shape, strict=True):
            cells = []
            for offset, w in self.coefs.items():
                at = F.pmod(F.col(axis) - offset, F.lit(n))
                cells.append((F.when(at % 2 == 0, F.floor(at / 2)), w))
            out = _send(out, lattice, axis, names, cells)
        return out.select(*lattice.keys, *names)

    def correct(self, fine: DataFrame, coarse: DataFrame, lattice: Lattice, *names: str) -> DataFrame:
        """``coarse`` less the restriction of ``fine``."""
        names = self._columns(coarse, lattice, names)
        return self._correct(coarse, lattice, self(fine, lattice, *names), names, -1)


class FullWeighting(Restriction):
    coefs = {-1: 1 / 4, 0: 1 / 2, 1: 1 / 4}


class Injection(Restriction):
    coefs = {0: 1.0}

    def __call__(self, fine: DataFrame, lattice: Lattice, *names: str) -> DataFrame:
        names = self._columns(fine, lattice, names)
        lattice.coarser()
        even = fine
        for a in lattice.axes:
            even = even.where(F.col(a) % 2 == 0)
        return even.select(*lattice.outer, *[(F.col(a) / 2).cast("int").alias(a) for a in lattice.axes], *names)


class Interpolation(_Transfer):
    """Even fine cells take ``even`` and odd ones ``odd`` along each axis: {offset in fine cells to an even cell: weight}."""

    even: Mapping[int, float] = {0: 1.0}
    odd: Mapping[int, float] = {}

    def __call__(self, coarse: DataFrame, lattice: Lattice, *names: str) -> DataFrame:
        """Keys of the fine ``lattice`` and the interpolated columns."""
        names = self._columns(coarse, lattice, names)
        out = coarse
        for axis, n in zip(lattice.axes, lattice.shape, strict=True):
            # Coarse cell c lies at fine cell 2c and is taken by the fine cells at these distances.
            out = _send(out, lattice, axis, names, [(F.pmod(2 * F.col(axis) - d, F.lit(n)), w) for d, w in (*self.even.items(), *self.odd.items())])
        return out.select(*lattice.keys, *names)

    def correct(self, coarse: DataFrame, fine: DataFrame, lattice: Lattice, *names: str) -> DataFrame:
        """``fine`` plus the interpolation of ``coarse``."""
        names = self._columns(coarse, lattice, names)
        return self._correct(fine, lattice, self(coarse, lattice, *names), names, 1)


class LinearInterpolation(Interpolation):
    odd = {-1: 1 / 2, 1: 1 / 2}


class CubicInterpolation(Interpolation):
    odd = {-3: -1 / 16, -1: 9 / 16, 1: 9 / 16, 3: -1 / 16}
