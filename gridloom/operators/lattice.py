"""A periodic lattice and the DataFrames that hold its fields.

Cell layout: a row per cell, keyed by the lattice's axes and any outer keys, a column per
field component. The DataFrame doesn't know its extents, so a Lattice goes with it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = ("i", "j", "k")


@dataclass(frozen=True)
class Lattice:
    shape: tuple[int, int, int]
    lengths: tuple[float, float, float] | None = None
    outer: tuple[str, ...] = ()
    axes: tuple[str, str, str] = field(default=AXES)

    @property
    def cells(self) -> int:
        return self.shape[0] * self.shape[1] * self.shape[2]

    @cached_property
    def spacing(self) -> tuple[float, float, float]:
        lengths = self.lengths or tuple(map(float, self.shape))
        return tuple(length / n for length, n in zip(lengths, self.shape, strict=True))

    @cached_property
    def volume(self) -> float:
        lengths = self.lengths or tuple(map(float, self.shape))
        return lengths[0] * lengths[1] * lengths[2]

    @property
    def keys(self) -> list[str]:
        return [*self.outer, *self.axes]

    def coarser(self) -> Lattice:
        if any(n % 2 for n in self.shape):
            raise ValueError(f"{self.shape} can't be halved")
        return Lattice(tuple(n // 2 for n in self.shape), self.lengths or tuple(map(float, self.shape)), self.outer, self.axes)

    def cell_id(self) -> Column:
        i, j, k = (F.col(a).cast("bigint") for a in self.axes)
        return (i * self.shape[1] + j) * self.shape[2] + k

    def grid(self, spark: SparkSession) -> DataFrame:
        """All cells, by their axes."""
        return from_ids(spark.range(self.cells), "id", self).drop("id")

    def values(self, df: DataFrame) -> list[str]:
        return [c for c in df.columns if c not in self.keys]


def from_ids(df: DataFrame, cell: str, lattice: Lattice) -> DataFrame:
    """Give rows with a row-major cell number, 0 up, their axes; rows of other numbers go."""
    ni, nj, nk = lattice.shape
    c = F.col(cell).cast("bigint")
    whole = lambda n: F.expr(f"cast(`{cell}` as bigint) div {n}L")  # noqa: E731  integers all the way, exact beyond 2 ** 53
    place = (whole(nj * nk), F.pmod(whole(nk), F.lit(nj)), F.pmod(c, F.lit(nk)))
    inside = df.where((c >= 0) & (c < lattice.cells))
    return inside.select(*[p.cast("int").alias(a) for p, a in zip(place, lattice.axes, strict=True)], *df.columns)
