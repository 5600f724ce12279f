"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.session import shared_folder
from .common import compact

#: Edges that a task writes; their number never grows from round to round.
EDGES_A_TASK = 200_000


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node that can be reached.

    Each round keeps at most as many edges as before and the rounds grow with the
    logarithm of the largest component. A node of many edges costs no task more than
    its share: minima are pre-aggregated, and the joins are ones that Spark can split.
    Edges are checkpointed each round in the shared folder, in as many parts as their number calls for. Self-loops are
    ignored, repeated edges count once, no edges give no rows.
    """
    shared_folder(edges.sparkSession)
    now = compact(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()).checkpoint()
    mark = _mark(now)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        now = _small_star(_large_star(now)).coalesce(1 + mark[0] // EDGES_A_TASK).checkpoint()
        before, mark = mark, _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError("the components did not settle")
    members = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return members.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of the node and its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    tied = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the smallest of them. Edges run from larger to smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    tied = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return tied.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
