"""Token counts of flat token files by a separator scan.

A flat file is a run of little-endian 16-bit ids with nothing but an end-of-document id
between documents: no index, no lengths. Ids are stored plus one, so 0 is free to
end a document. Files are read in blocks, each a task's, and a block is searched piece by piece
with one vector comparison each. What a block holds is a list of fragments; the prefix scan of the
blocks' separator counts numbers each fragment by the document it belongs to, and the fragments of one
number, in however many blocks and files they lie, add up to its document.

The blocks are the splits of Spark's own text reader, so any store it knows will do and no file is ever a
single row: it parts the files at zero bytes, which is put right when a block's bytes are joined again.
Every block but a file's first starts after a zero byte; how many bytes lie before it is a prefix scan as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import local, map_arrow, materialise, new_path, table, text_of
from .textbytes import Texts, chunks
from .tokens import default_path, encoder

END = 0
#: Ids that are compared at once.
BLOCK = 1 << 20
#: Ids before each document's own that spell its doc_id: 15 bits each, plus one.
HEADER = 5
#: Stands five times for a null doc_id.
NULL_ID = (1 << 15) + 1


def spell(doc_id: int | None) -> list[int]:
    if doc_id is None:
        return [NULL_ID] * HEADER
    return [(doc_id % (1 << 64) >> 15 * k & 0x7FFF) + 1 for k in range(HEADER)]


def unspell(ids: list[int]) -> int | None:
    if len(ids) < HEADER or ids[0] == NULL_ID:
        return None
    value = sum((x - 1) << 15 * k for k, x in enumerate(ids[:HEADER]))
    return value - (1 << 64) if value >> 63 else value


def write(docs: DataFrame, to: str, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> None:
    """Write every document's ids, after the spelling of its doc_id, to flat files under ``to``.

    Spark's own writer makes the files, so any store it knows will do: a row is a
    document's bytes and the row separator is the end-of-document id. A null or empty text, or one without
    words, is a document of no ids; rows that repeat are written each. Other columns are ignored; an empty table gives no documents.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                ids, offsets = encoder(path).encode(Texts.arrow(part.column("text")))
                stored = (ids + 1).astype("<u2")
                heads = [np.array(spell(x), "<u2").tobytes() for x in part.column("doc_id").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([h + stored[a:b].tobytes() for h, a, b in zip(heads, offsets[:-1], offsets[1:], strict=True)], pa.binary())], ["value"])

    rows = map_arrow(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_of(text).alias("text")), run, "value binary")
    rows.select(F.col("value").cast("string")).write.option("lineSep", "\0\0").text(to)


def fragments(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(document, start, length) of the fragments of all pieces of ``block`` ids, and the number of separators.

    ``document`` counts the separators before the fragment; empty fragments are left
    out unless a separator ends them.
    """
    found, before = [], 0
    for low in range(0, len(ids), block):
        ends = np.flatnonzero(ids[low : low + block] == END) + low
        high = min(low + block, len(ids))
        starts = np.concatenate([[low], ends + 1])
        stops = np.append(ends, high)
        number = before + np.arange(len(starts))
        whole = np.ones(len(starts), bool)
        whole[-1] = stops[-1] > starts[-1]
        found.append((number[whole], starts[whole], (stops - starts)[whole]))
        before += len(ends)
    if not found:
        return (np.zeros(0, np.int64),) * 3 + (0,)
    return (*(np.concatenate(x) for x in zip(*found, strict=True)), before)


def stitch(number: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) with the fragments of each document added up."""
    first = np.flatnonzero(np.diff(number, prepend=-1))
    return number[first], start[first], np.add.reduceat(length, first) if len(first) else length[:0]


def prefix(rows: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows before each in the order.

    Ranges of the order are summed in a task each, the ranges' totals on the driver, and each row gets its range's
    offset and what lies before it within the range.
    """
    dealt = materialise(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges", small=True)
    totals = sorted((r.part, r.total) for r in dealt.groupBy("part").agg(F.sum(value).alias("total")).collect())  # a row a task
    offset, offsets = 0, []
    for _, total in totals:
        offsets.append(offset)
        offset += total
    before = local(rows.sparkSession, {"part": pa.array([p for p, _ in totals], pa.int32()), "offset": pa.array(offsets, pa.int64())})
    within = F.sum(value).over(Window.partitionBy("part").orderBy(*order)) - F.col(value)
    return dealt.join(F.broadcast(before), "part").withColumn(name, F.col("offset") + within).drop("part", "offset")


def _blocks(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Rows (file, block, value) of the files in their order within a block, parted at zero bytes; and (id, file, block, offset, stop, mark) of each block."""
    rows = spark.read.option("lineSep", "\0").option("recursiveFileLookup", "true").text(folder)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value"))
    sizes = rows.groupBy("file", "block", "size").agg(F.sum(F.length("value") + 1).alias("bytes"))
    placed = prefix(sizes, ["file", "block"], "bytes", "before")
    of = Window.partitionBy("file")
    # What the reader left out at a file's start is a byte order mark; past its end it has added a zero byte.
    missing = F.col("size") - F.sum("bytes").over(of)
    mark = F.when(missing >= 2, 3).otherwise(0)
    offset = F.col("before") - F.min("before").over(of) + mark
    placed = placed.select("file", "block", "size", offset.alias("offset"), "bytes", mark.alias("mark"))
    first = F.col("offset") == F.col("mark")
    placed = placed.select("file", "block", F.when(first, 0).otherwise(F.col("offset")).alias("offset"), F.least(F.col("offset") + F.col("bytes"), "size").alias("stop"), F.when(first, F.col("mark")).otherwise(0).alias("mark"))
    return rows.select("file", "block", "value"), materialise(placed.withColumn("id", F.monotonically_increasing_id()), "blocks", small=True)


def scan(spark: SparkSession, folder: str, header: int = 0, joined: bool = False, block: int = BLOCK) -> DataFrame:
    """(file, document, start, tokens, head): every document of the flat files in ``folder``.

    ``document`` counts from 0 in its file, ``start`` is the place of its first id,
    ``head`` has its first ``header`` ids as stored, which aren't counted as tokens. A
    last document that no separator ends counts too; a byte that is left over at a file's end does not. With ``joined`` the files, by
    name, are one stream: a document may run on from file to file, ``document`` counts through all of them
    and ``file`` and ``start`` tell where it begins. Files without bytes hold no documents, no files give no rows.

    What is known of the blocks, a row of some 200 bytes for each split of a file, is broadcast.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of the block that is being read: what it is, the next id's place, separators so far, the open fragment, a byte that waits for its other half.
        now, at, ends, opened, wait = None, 0, 0, None, b""

        def take(data: bytes) -> list[tuple]:
            nonlocal at, ends, opened, wait
            data = wait + data
            wait = data[len(data) // 2 * 2 :]
            ids = np.frombuffer(data, "<u2", len(data) // 2)
            number, start, length = stitch(*(found := fragments(ids, block))[:3])
            rows = []
            for n, a, size in zip((number + ends).tolist(), start.tolist(), length.tolist(), strict=True):
                head = ids[a : a + min(header, size)].tolist()
                if opened and opened[0] == n:
                    opened = (n, opened[1], opened[2] + size, opened[3] + head[: header - len(opened[3])])
                else:
                    rows += [opened] if opened else []
                    opened = (n, at + a, size, head)
            at, ends = at + len(ids), ends + found[3]
            return rows

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            # The separators before a fragment are counted within its block; a block's last row also has them all.
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            found = [pa.array(list(x), kind) for x, kind in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([now] * len(rows), pa.int64()), *found], ["id", "number", "start", "length", "head"])

        def finish() -> list[tuple]:
            rows = [opened] if opened else []
            return [*rows, (-1, 0, ends, [])]

        for batch in batches:
            ids = batch.column("id").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if ids[a] != now:
                    if now is not None:
                        yield batch_of(finish())
                    offset, stop, mark = (batch.column(k)[a].as_py() for k in ("offset", "stop", "mark"))
                    now, at, ends, opened = int(ids[a]), offset // 2, 0, None
                    # A block that starts within an id starts after the zero byte that is the id's lower half.
                    wait = b"\0" * (offset % 2) + (b"\xef\xbb\xbf" if mark else b"")
                    left = stop - offset - mark
                data = (b"\0".join(batch.column("value").slice(a, b - a).to_pylist()) + b"\0")[:left]
                left -= len(data)
                yield batch_of(take(data))
        if now is not None:
            yield batch_of(finish())

    rows, blocks = _blocks(spark, folder)
    told = rows.join(F.broadcast(blocks), ["file", "block"]).select("id", "offset", "stop", "mark", "value")
    found = materialise(map_arrow(told, run, "id bigint, number bigint, start bigint, length bigint, head array<int>"), "fragments")
    ends = found.where("number < 0").select("id", F.col("length").alias("ends")).join(F.broadcast(blocks.select("id", "file", "block")), "id")
    ends = prefix(ends, ["file", "block"], "ends", "before")
    of = Window.partitionBy("file")
    ends = ends.withColumns({"base": F.lit(0).cast("bigint") if joined else F.min("before").over(of), "first": F.col("block") == F.min("block").over(of)})
    numbered = found.where("number >= 0").join(F.broadcast(ends), "id").withColumn("document", F.col("before") - F.col("base") + F.col("number"))
    # Fragments at a block's ends may go on in its neighbours; the others are whole documents.
    is_open = (F.col("number") == F.col("ends")) | ((F.col("number") == 0) & (F.lit(joined) | ~F.col("first")))
    keys = ["document"] if joined else ["file", "document"]
    parts = F.sort_array(F.collect_list(F.struct("file", "start", "head")))
    stitched = numbered.where(is_open).groupBy(*keys).agg(parts.alias("parts"), F.sum("length").alias("length"))
    stitched = stitched.select(F.col("parts")[0]["file"].alias("file"), "document", F.col("parts")[0]["start"].alias("start"), "length", F.slice(F.flatten("parts.head"), 1, max(header, 1)).alias("head"))
    whole = numbered.where(~is_open).select("file", "document", "start", "length", "head")
    return whole.unionByName(stitched).select("file", "document", "start", F.greatest(F.col("length") - header, F.lit(0)).alias("tokens"), "head")


def query(spark, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "tokens")
    write(table(spark, sf_dir, "documents"), folder)
    digits = [(F.get("head", F.lit(k)).cast("bigint") - 1) for k in range(HEADER)]
    doc_id = digits[0]
    for k in range(1, HEADER):
        doc_id = doc_id.bitwiseOR(F.shiftleft(digits[k], 15 * k))
    found = scan(spark, folder, HEADER)
    return found.select(F.when(F.get("head", F.lit(0)) != NULL_ID, doc_id).alias("doc_id"), "tokens", F.regexp_extract("file", r"part-(\d+)", 1).cast("int").alias("file"), "document", "start")
