"""Weighted histograms: a group-by on a computed bin, zero-filled."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import lower
from .lattice import Lattice


class Histogrammer:
    """``{name: (bin expression, weight expression)}``: the weights of each bin, floor of the expression, summed.

    All histograms share one pass. Bins outside 0 to num_bins - 1 are an error of the
    caller's expression; such rows are left out.
    """

    def __init__(self, lattice: Lattice, histograms: Mapping[str, tuple[Any, Any]], num_bins: int, *, params: Mapping[str, Any] | None = None):
        self.lattice, self.histograms, self.num_bins, self.params = lattice, dict(histograms), num_bins, dict(params or {})

    def __call__(self, df: DataFrame, **params: Any) -> DataFrame:
        """Outer keys, bin, and a column of weights for each histogram."""
        return self.of_columns(df, {n: tuple(lower(e, params=self.params | params) for e in pair) for n, pair in self.histograms.items()})

    def of_columns(self, df: DataFrame, columns: Mapping[str, tuple[Column, Column]]) -> DataFrame:
        names, outer = list(columns), self.lattice.outer
        entries = [F.struct(F.floor(b).cast("int").alias("bin"), *[(w if m == n else F.lit(None)).alias(m) for m in names]) for n, (b, w) in columns.items()]
        rows = df.select(*outer, F.inline(F.array(*entries))).where((F.col("bin") >= 0) & (F.col("bin") < self.num_bins))
        sums = rows.groupBy(*outer, "bin").agg(*[F.sum(n).alias(n) for n in names])
        bins = df.sparkSession.range(self.num_bins).select(F.col("id").cast("int").alias("bin"))
        if outer:
            # Every outer value has every bin: exploded, not joined, and as many rows as the result.
            every = F.sequence(F.lit(0), F.lit(self.num_bins - 1))
            bins = df.select(*outer).distinct().withColumn("bin", F.explode(every))
        joined = bins.join(sums, [*outer, "bin"], "left")
        return joined.select(*outer, "bin", *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names])


class FieldHistogrammer:
    """Linear histogram of a column and logarithmic one of its absolute value, over bounds that are found or given.

    Values are clipped to the first and last bin. Zeros have no logarithm and are left out of the
    logarithmic histogram and its bounds. A field of one value fills bin 0.
    """

    def __init__(self, lattice: Lattice, num_bins: int):
        self.lattice, self.num_bins = lattice, num_bins

    def bounds(self, df: DataFrame, f: str) -> DataFrame:
        """A row for each outer value."""
        c = F.col(f).cast("double")
        size = F.when(c != 0, F.abs(c))
        return df.groupBy(*self.lattice.outer).agg(F.min(c).alias("min"), F.max(c).alias("max"), F.ln(F.min(size)).alias("min_log"), F.ln(F.max(size)).alias("max_log"))

    def __call__(self, df: DataFrame, f: str, bounds: Mapping[str, float] | None = None) -> DataFrame:
        """Outer keys, bin, linear, log, and the bin's lower edges linear_edge and log_edge."""
        outer, n = self.lattice.outer, self.num_bins
        if bounds is None:
            found = self.bounds(df, f)
            # A row without outer keys; else rows that grow with them, which Spark joins as it sees fit.
            ends = df.crossJoin(F.broadcast(found)) if not outer else df.join(found, list(outer))
        else:
            ends = df.withColumns({k: F.lit(float(bounds[k])) for k in ("min", "max", "min_log", "max_log")})
        c = F.col(f).cast("double")

        def place(value: Column, low: str, high: str) -> Column:
            width = F.col(high) - F.col(low)
            raw = F.when(width > 0, F.floor((value - F.col(low)) / F.when(width > 0, width) * n)).otherwise(F.lit(0))
            return F.when(value.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(n - 1), raw)))

        logs = F.when(c != 0, F.ln(F.when(c != 0, F.abs(c))))
        columns = {"linear": (place(c, "min", "max"), F.lit(1.0)), "log": (place(logs, "min_log", "max_log"), F.lit(1.0))}
        counts = Histogrammer(self.lattice, {}, n).of_columns(ends, columns)
        if bounds is None:
            with_ends = counts.crossJoin(F.broadcast(found)) if not outer else counts.join(found, list(outer))
        else:
            with_ends = counts.withColumns({k: F.lit(float(bounds[k])) for k in ("min", "max", "min_log", "max_log")})
        edge = lambda low, high: F.col(low) + (F.col(high) - F.col(low)) * F.col("bin") / n
        return with_ends.select(*outer, "bin", "linear", "log", edge("min", "max").alias("linear_edge"), F.exp(edge("min_log", "max_log")).alias("log_edge"))
