"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.session import shared_folder

#: A word is a maximal run of code points other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes that go to a Python worker at once; a single longer row goes alone.
BATCH_BYTES = 4 << 20

#: The filter that spares rows of no interest a shuffle has so many bits for each row of interest, and 2 ** MOST_FILTER_BITS (128 MB)
#: at most; where there are more such rows than that serves, more others are shuffled with them.
FILTER_ROOM, MOST_FILTER_BITS = 32, 30

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` in batches of bounded size.

    Spark has no setting of this for a single plan: the session's limit is lowered to BATCH_BYTES, and left as it is where the caller
    has set a lower one.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    said = conf.get(name).lower().rstrip("b")
    if not said.isdigit() or not 0 < int(said) <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def local(spark: SparkSession, columns: dict[str, pa.Array]) -> DataFrame:
    """A small table of the driver's as a DataFrame. Unlike rows of Python objects, Arrow columns start no Python workers."""
    return spark.createDataFrame(pa.table(columns))


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver or a ``scratch`` ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def compact(df: DataFrame) -> DataFrame:
    """``df`` in no more tasks than an eighth of the shuffle partitions, or two a core.

    Partitions are as many as whole texts need; tables of ids that were shuffled are small beside those, and a file a task of
    them is a burden to any store.
    """
    spark = df.sparkSession
    return df.coalesce(max(2 * spark.sparkContext.defaultParallelism, shuffle_partitions(spark) // 8))


def materialise(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it again; ``small`` tables are made compact.

    The lineage is cut at a file that survives the loss of any executor, and the
    costly stage before it runs once however often the result is used.
    """
    spark = df.sparkSession
    df = compact(df) if small else df
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete the files of materialised tables that no later plan reads."""
    for df in tables:
        discard(df.sparkSession, df._path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a path that ``new_path`` gave."""
    delete(spark, path)
    _written.remove((spark, path))


@contextmanager
def scratch() -> Iterator[None]:
    """Delete at the end what was written to the shared folder within, but for paths that were taken before."""
    before = len(_written)
    try:
        yield
    finally:
        for spark, path in _written[before:]:
            delete(spark, path)
        del _written[before:]


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before
            return


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of the documents whose labels are never learnt from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _bitmap(nodes: DataFrame) -> np.ndarray:
    """A bitmap of the low bits of a column ``node``, as many as its rows call for; its words are made by an aggregate and bounded by MOST_FILTER_BITS."""
    bits = min(MOST_FILTER_BITS, max(10, (FILTER_ROOM * nodes.count()).bit_length()))
    low = F.col("node").bitwiseAND(F.lit((1 << bits) - 1))
    words = nodes.select(F.shiftrightunsigned(low, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), low.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return out


def may_be_in(nodes: DataFrame):
    """A function of a column of nodes: true for those of the table, and for few others. Only that column visits Python."""
    bitmap = nodes.sparkSession.sparkContext.broadcast(_bitmap(nodes))

    @F.pandas_udf("boolean")
    def hit(node: pd.Series) -> pd.Series:
        low = node.to_numpy() & (64 * len(bitmap.value) - 1)
        return pd.Series((bitmap.value[low >> 6] >> (low & 63)) & 1 == 1)

    return hit
