"""Reductions and statistics: every quantity of a call in one aggregate."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import Expr, lower, wrap
from .lattice import Lattice

# Spark's max takes NaN for the largest and its min passes it over.
_OPS: dict[str, Callable[[Column, int], Column]] = {
    "avg": lambda c, n: F.sum(c) / F.lit(n),
    "sum": lambda c, n: F.sum(c),
    "prod": lambda c, n: F.product(c),
    "max": lambda c, n: F.max(c),
    "min": lambda c, n: F.min(c),
}


def _reducers(source: Any) -> dict[str, list]:
    """Merge the reducers of a dict, a sector or a list of sectors."""
    if isinstance(source, Mapping):
        return dict(source)
    if isinstance(source, (list, tuple)):
        merged: dict[str, list] = {}
        for one in source:
            for name, entries in _reducers(one).items():
                merged.setdefault(name, []).extend(entries)
        return merged
    return dict(source.reducers)


class Reduction:
    """``input``: ``{name: [expression, or (expression, op)]}``, a sector, or a list of them. op is avg (by default), sum, prod, max or min.

    ``grid_size`` is the number of cells that averages divide by, the lattice's own unless given.
    """

    def __init__(self, lattice: Lattice, input: Any, *, grid_size: int | None = None, callback: Callable[[dict], Any] = lambda found: found, params: Mapping[str, Any] | None = None):
        self.lattice, self.grid_size, self.callback, self.params = lattice, grid_size or lattice.cells, callback, dict(params or {})
        self.entries: list[tuple[str, int, Expr, str]] = []
        for name, entries in _reducers(input).items():
            for n, entry in enumerate(entries if isinstance(entries, (list, tuple)) and not isinstance(entries, Expr) else [entries]):
                expr, op = entry if isinstance(entry, tuple) else (entry, "avg")
                if op not in _OPS:
                    raise NotImplementedError(f"reduction operation {op}")
                self.entries.append((name, n, wrap(expr), op))

    def frame(self, df: DataFrame, **params: Any) -> DataFrame:
        """One row, or one for each value of the outer keys; columns are named name_0, name_1 and so on."""
        found = [_OPS[op](lower(e, params=self.params | params), self.grid_size).alias(f"{name}_{n}") for name, n, e, op in self.entries]
        return df.groupBy(*self.lattice.outer).agg(*found) if self.lattice.outer else df.agg(*found)

    def __call__(self, df: DataFrame, **params: Any) -> Any:
        """``{name: [values]}``, through the callback."""
        if self.lattice.outer:
            raise ValueError("use frame() for fields with outer keys")
        row, out = self.frame(df, **params).first(), {}
        for name, n, _, _ in self.entries:
            out.setdefault(name, []).append(row[f"{name}_{n}"])
        return self.callback(out)


class FieldStatistics:
    """Mean and population variance of a column, E[f^2] - E[f]^2; with ``max_min`` also max, min and those of its absolute value."""

    def __init__(self, lattice: Lattice, *, max_min: bool = False, grid_size: int | None = None):
        self.lattice, self.max_min, self.grid_size = lattice, max_min, grid_size or lattice.cells

    def frame(self, df: DataFrame, f: str) -> DataFrame:
        c = F.col(f).cast("double")
        found = [(F.sum(c) / self.grid_size).alias("mean"), (F.sum(c * c) / self.grid_size).alias("__square")]
        if self.max_min:
            found += [F.max(c).alias("max"), F.min(c).alias("min"), F.max(F.abs(c)).alias("abs_max"), F.min(F.abs(c)).alias("abs_min")]
        out = df.groupBy(*self.lattice.outer).agg(*found)
        return out.withColumn("variance", F.col("__square") - F.col("mean") * F.col("mean")).drop("__square")

    def __call__(self, df: DataFrame, f: str) -> list[dict]:
        return [r.asDict() for r in self.frame(df, f).collect()]
