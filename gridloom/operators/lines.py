"""Line layout, for work that is iterated: a row holds the cells along the lattice's last axis.

A sweep in cell layout sends each cell to each of its neighbours as a row of its own. Here neighbours along the last axis are in
the same row, and the others arrive as whole lines: for a Laplacian five rows a line where cells take seven rows a cell.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import AXES, Expr, evaluate, fields_of
from .lattice import Lattice

Place = tuple[int, int]


def fits(exprs: Mapping[str, Expr], params: Mapping[str, Any]) -> bool:
    """Whether expressions can be swept in line layout: their fields have all three axes, and their parameters are numbers."""
    return all(f.indices == AXES for f in fields_of(*exprs.values())) and all(isinstance(p, (int, float, np.number)) for p in params.values())


def _keys(lattice: Lattice) -> list[str]:
    return [*lattice.outer, *lattice.axes[:2]]


def pack(df: DataFrame, lattice: Lattice) -> DataFrame:
    """Cells to lines: the values of every column by their place on the last axis. A line is one row, so its cells must fit in memory."""
    last, names = lattice.axes[2], lattice.values(df)
    lines = df.groupBy(*_keys(lattice)).agg(F.array_sort(F.collect_list(F.struct(last, *names))).alias("__line"))
    return lines.select(*_keys(lattice), *[F.col("__line")[n].alias(n) for n in names])


def unpack(lines: DataFrame, lattice: Lattice) -> DataFrame:
    """Lines to cells."""
    names = [c for c in lines.columns if c not in _keys(lattice)]
    at = F.sequence(F.lit(0), F.lit(lattice.shape[2] - 1)).alias(lattice.axes[2])
    return lines.select(*_keys(lattice), F.inline(F.arrays_zip(at, *names)))


def sweep(lines: DataFrame, lattice: Lattice, exprs: Mapping[str, Expr], params: Mapping[str, Any]) -> DataFrame:
    """Set the columns named to expressions of the state before, all at once. Lattices without a cell's neighbour raise.

    Batches to Python are bounded by spark.sql.execution.arrow.maxBytesPerBatch, whatever a line's length.
    """
    keys, (i, j, _), (ni, nj, nk) = _keys(lattice), lattice.axes, lattice.shape
    columns = [c for c in lines.columns if c not in keys]
    reads: dict[str, set[Place]] = {c: {(0, 0)} for c in columns}
    for f in fields_of(*exprs.values()):
        reads[f.column].add(f.shifted()[:2])
    places = sorted(set().union(*reads.values()))

    # A line goes to those that read it; what isn't read there stays behind.
    kinds = {c: lines.schema[c].dataType for c in columns}
    sent = [
        F.struct(
            F.pmod(F.col(i) - di, F.lit(ni)).cast("int").alias(i),
            F.pmod(F.col(j) - dj, F.lit(nj)).cast("int").alias(j),
            F.lit(n).alias("__place"),
            *[(F.col(c) if (di, dj) in reads[c] else F.lit(None).cast(kinds[c])).alias(c) for c in columns],
        )
        for n, (di, dj) in enumerate(places)
    ]
    met = [(c, place) for c in columns for place in places if place in reads[c]]
    name = {(c, place): f"__{m}" for m, (c, place) in enumerate(met)}
    around = (
        lines.select(*lattice.outer, F.inline(F.array(*sent)))
        .groupBy(*keys)
        .agg(*[F.first(F.when(F.col("__place") == places.index(place), F.col(c)), ignorenulls=True).alias(name[c, place]) for c, place in met])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, np.ndarray] = {}

            def value(f, batch=batch, found=found):
                *place, dk = f.shifted()
                label = name[f.column, tuple(place)]
                if label not in found:
                    found[label] = batch.column(label).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(batch.num_rows, nk)
                return np.roll(found[label], -dk, axis=1) if dk else found[label]

            out = {c: batch.column(name[c, (0, 0)]) for c in columns}
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * np.int32(nk))
            for c, e in exprs.items():
                new = np.broadcast_to(np.asarray(evaluate(e, value, params), float), (batch.num_rows, nk))
                out[c] = pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(new).ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], *out.values()], [*keys, *out])

    schema = ", ".join([f"`{k}` {around.schema[k].dataType.simpleString()}" for k in keys] + [f"`{c}` {'array<double>' if c in exprs else kinds[c].simpleString()}" for c in dict.fromkeys([*columns, *exprs])])
    return around.mapInArrow(run, schema)
