"""Exact deduplication by skew-safe combining.

Equal texts meet in three stages. The map side of the first aggregate deduplicates
within each task; groups are then merged by digest, those of a hot digest by digest
and salt; the winners of the salts are combined globally. The full text is a
grouping key of every stage, so a digest only routes rows and never decides that
two texts are equal.

A digest is hot if it covers 1/4096 of all rows (and 1000 rows at least), so the list
of hot digests has at most 4096 entries whatever the input. Texts cross the network
once; hot ones cross it as one copy per map task, then as one per salt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, table, text_of

MOST_HOT = 4096
LEAST_HOT_ROWS = 1000
SALTS = 16


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _hot(slim: DataFrame) -> list:
    counts = slim.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    least = max(LEAST_HOT_ROWS, -(-slim.count() // MOST_HOT))
    return [bytes(r.digest) for r in counts.where(F.col("n") >= least).select("digest").collect()]


def _is_hot(hot: list) -> Column:
    return F.col("digest").isin([F.lit(x) for x in hot]) if hot else F.lit(False)


def _combine(rows: DataFrame, hot: list, salt_by: str) -> DataFrame:
    """One row per text: the largest ``row`` and the number of rows. Where ``row`` is a plain id, all of it is hash aggregation."""
    first = lambda d, *keys: d.groupBy(*keys).agg(F.max("row").alias("row"), F.count(F.lit(1)).alias("n"))
    cold = first(rows.where(~_is_hot(hot)), "digest", "text")
    if not hot:
        return cold
    salted = rows.where(_is_hot(hot)).withColumn("salt", F.pmod(F.xxhash64(salt_by), F.lit(SALTS)))
    winners = first(salted, "digest", "salt", "text")
    return cold.unionByName(winners.groupBy("digest", "text").agg(F.max("row").alias("row"), F.sum("n").alias("n")))


def mark(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """For every row of ``docs``: doc_id, keep_id, group_size, kept, digest.

    Null texts equal empty ones. Of equal texts the largest doc_id stays; a null id is
    smaller than any other. If rows repeat that id, one of them stays. Extra
    columns are ignored; an empty table gives no rows.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    base = base.withColumn("digest", digest(F.col("text")))
    slim = materialise(base.select("doc_id", "digest", F.monotonically_increasing_id().alias("uid")), "digests")  # the ids are fixed once written
    hot = _hot(slim)
    classes = _combine(base.select("doc_id", "digest", "text", F.col("doc_id").alias("row")), hot, "doc_id")
    classes = materialise(classes.select("digest", F.col("row").alias("keep_id"), F.col("n").alias("group_size")), "winners")
    clashes = classes.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest")
    tops = slim.groupBy("digest").agg(F.max(F.struct("doc_id", "uid")).alias("top"))
    if clashes.isEmpty():
        found = classes.join(tops.select("digest", F.col("top.uid").alias("top_uid")), "digest")
        return _attach(slim, found, hot)
    # Different texts share a digest: their rows are matched by the texts themselves.
    clear = classes.join(clashes, "digest", "left_anti").join(tops.select("digest", F.col("top.uid").alias("top_uid")), "digest")
    rest = base.join(clashes, "digest", "left_semi")
    texts = _combine(rest.select("doc_id", "digest", "text", F.col("doc_id").alias("row")), hot, "doc_id")
    texts = texts.select("digest", "text", F.col("row").alias("keep_id"), F.col("n").alias("group_size"))
    matched = rest.join(texts, ["digest", "text"])
    tops_of = matched.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).dropDuplicates(["digest", "text"]).withColumn("kept", F.lit(True))
    others = matched.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).withColumn("kept", F.lit(False))
    columns = ["doc_id", "keep_id", "group_size", "kept", "digest"]
    return _attach(slim, clear, hot).unionByName(tops_of.select(columns)).unionByName(others.select(columns))


def _attach(slim: DataFrame, found: DataFrame, hot: list) -> DataFrame:
    """Rows of ``slim`` with their group: cold digests by a shuffled join, the bounded list of hot ones by broadcast."""
    joined = slim.where(~_is_hot(hot)).join(found.where(~_is_hot(hot)), "digest")
    if hot:
        joined = joined.unionByName(slim.where(_is_hot(hot)).join(F.broadcast(found.where(_is_hot(hot))), "digest"))
    return joined.select("doc_id", "keep_id", "group_size", (F.col("uid") == F.col("top_uid")).alias("kept"), "digest")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all its columns, under the rules of ``mark``.

    The other columns ride along in the aggregate, so no join follows it.
    """
    rest = [F.col(c) for c in docs.columns if c not in (doc_id, text)]
    row = F.struct(F.col(doc_id).alias("doc_id"), F.col(text).isNotNull().alias("has_text"), F.struct(F.lit(0).alias("_"), *rest).alias("rest"))
    rows = docs.select(F.col(doc_id).alias("salt_id"), sha256(text_of(text)).alias("digest"), text_of(text).alias("text"), row.alias("row"))
    kept = _combine(rows, _hot(rows.select("digest")), "salt_id")
    columns = {doc_id: F.col("row.doc_id"), text: F.when(F.col("row.has_text"), F.col("text"))}
    return kept.select(*[columns.get(c, F.col(f"row.rest.{c}")).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return mark(table(spark, sf_dir, "documents")).withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


SQL = """
WITH base AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
grouped AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM base GROUP BY text)
SELECT b.doc_id, g.keep_id, g.group_size, b.doc_id = g.keep_id AS kept, sha256(b.text) AS text_sha256
FROM base b JOIN grouped g ON b.text = g.text
"""
