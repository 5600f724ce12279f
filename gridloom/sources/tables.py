"""Lattices read from tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lattice import Lattice, from_ids


def _fields(events: DataFrame, lattice: Lattice) -> DataFrame:
    cells = from_ids(events.select("event_id", "value", "props"), "event_id", lattice)
    f = F.round(F.col("value") * 100).cast("bigint").alias("f")
    g = F.get_json_object("props", "$.k").cast("int").alias("g")
    return cells.select(*lattice.axes, f, g)


def even_shape(n: int) -> tuple[int, int, int]:
    """Even sides, the longest at most five times the shortest, of the smallest lattice that holds n cells; of several the one nearest to a cube."""
    eighths = max(1, -(-n // 8))
    while True:
        found = []
        for a in range(1, round(eighths ** (1 / 3)) + 2):
            if eighths % a == 0:
                rest = eighths // a
                found += [(rest // b - a, -a, b) for b in range(a, math.isqrt(rest) + 1) if rest % b == 0 and rest // b <= 5 * a]
        if found:
            _, a, b = min(found)
            return 2 * -a, 2 * b, 2 * (eighths // -a // b)
        eighths += 1


def event_lattice(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Lattice]:
    """All events in order as a lattice of ``even_shape``: f is the value in cents, g is k of the props. Cells beyond or between the events hold 0."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    count, last = events.agg(F.count(F.lit(1)), F.max("event_id")).first()
    lattice = Lattice(even_shape((last or 0) + 1))
    cells = _fields(events, lattice)
    if count < lattice.cells:
        zeros = lattice.grid(spark).join(cells.select(*lattice.axes), [*lattice.axes], "left_anti")
        cells = cells.unionByName(zeros.withColumns({"f": F.lit(0).cast("bigint"), "g": F.lit(0)}))
    return cells, lattice


def embedding_lattice(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Lattice]:
    """Each embedding as a 4 x 4 x 4 lattice of ``e`` under the outer key vec_id."""
    lattice = Lattice((4, 4, 4), outer=("vec_id",))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("at", "e"))
    return from_ids(rows, "at", lattice).select("vec_id", *lattice.axes, F.col("e").cast("double").alias("e")), lattice
