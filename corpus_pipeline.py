"""Corpus preparation in five stages, each written as Parquet and read again by the next.

1. quality: documents that the quality classifier scores below its threshold go.
2. exact_dedup: of equal texts the one with the largest doc_id stays.
3. near_dedup: of documents linked by a similarity of 0.8 or more over five-word shingles, the one with the smallest doc_id stays.
4. mixing: each document comes as often as the mix of sources uses it.
5. packing: the documents' pieces and the token sequences that hold them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import exact_dedup, mixing, packing, quality, simhash
from gridloom.llm.common import discard, new_path, scratch, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = quality.measured(docs)
    return quality.keep(docs, quality.learn(rows, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: A trained classifier, similarity links and token ids are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's files and what it wrote on the way are deleted once the next stage is written.

    Null and empty texts go through all stages as texts without words, where the classifier keeps them; ties and repeated rows are
    settled as the stages' operators say. Columns beyond those of documents are carried along to packing; an empty table gives no rows.
    """
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_path(spark, name)
        with scratch():
            stage(spark, docs, sf_dir).write.parquet(path)
        if last is not None:
            discard(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
