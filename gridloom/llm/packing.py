"""Packing documents into windows by minimum bin slack.

A document is cut into full windows and a remainder. How the remainders share windows
depends only on how many there are of each length, at most one count a length: the
driver solves that histogram. Each step takes the longest length left and finds,
by a bitset subset-sum over the counts, the multiset that fills the rest of the window
closest to its capacity; backtracking gives the multiset's counts, and it is used as
often as they allow. Pieces of one length are interchangeable, so a piece finds its
window from its rank among them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_arrow, materialise, table, text_of
from .textbytes import Texts, chunks
from .tokens import default_path, encoder

WINDOW = 2048
END_ID = 1


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, at most ``counts`` of each, whose sum comes closest to ``capacity`` from below."""
    reach, states, items = 1, [1], []
    full, mask = 1 << capacity, (1 << (capacity + 1)) - 1
    for length in sorted(counts, reverse=True):
        left, lot = min(counts[length], capacity // length), 1
        while left:
            take = min(lot, left)
            reach |= (reach << (take * length)) & mask
            items.append((length, take))
            states.append(reach)
            left, lot = left - take, 2 * lot
            if reach & full:
                break
        if reach & full:
            break
    at, chosen = reach.bit_length() - 1, {}
    for k in range(len(items), 0, -1):
        if not states[k - 1] >> at & 1:
            length, take = items[k - 1]
            chosen[length] = chosen.get(length, 0) + take
            at -= length * take
    return chosen


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: count}) of the windows that hold all pieces; counts times times add up to the histogram."""
    left, out = {k: n for k, n in histogram.items() if n}, []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        chosen = fill({k: n for k, n in rest.items() if n and k <= window - longest}, window - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[k] // n for k, n in chosen.items())
        out.append((times, chosen))
        for k, n in chosen.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, path: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, task, nth): documents cut into full windows and a remainder.

    nth counts the pieces of the same length within the task.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        for batch in batches:
            for part in chunks(batch, "text"):
                ids, offsets = encoder(path).encode(Texts.arrow(part.column("text")))
                rows = [[] for _ in range(6)]
                owner = part.column("doc_id").to_pylist()
                for i, one in enumerate(owner):
                    mine = np.append(ids[offsets[i] : offsets[i + 1]], END_ID).astype("<u4")
                    for at in range(0, len(mine), window):
                        cut = mine[at : at + window]
                        for column, value in zip(rows, (one, at, len(cut), zlib.crc32(cut.tobytes()), len(mine), int(seen[len(cut)])), strict=True):
                            column.append(value)
                        seen[len(cut)] += 1
                found = [pa.array(rows[0], part.schema.field("doc_id").type), *[pa.array(x, pa.int64()) for x in rows[1:]]]
                yield pa.RecordBatch.from_arrays([*found[:5], pa.array([task] * len(rows[0]), pa.int64()), found[5]], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "nth"])

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, task bigint, nth bigint"
    return map_arrow(docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text")), run, schema)


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, path: str | None = None) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset`` there; the pieces of a sequence have no gaps and at most ``window`` ids.

    A null or empty text is one piece of its end id. Rows that repeat a doc_id are packed
    each. Extra columns are ignored; an empty table gives no rows.
    """
    cut = materialise(pieces(docs, doc_id, text, window, path), "pieces")
    counts = materialise(cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most a row a length
    order = Window.partitionBy("length").orderBy("task")  # a row a task
    before = counts.select("length", "task", (F.sum("n").over(order) - F.col("n")).alias("before"))
    ranked = cut.join(before, ["length", "task"]).withColumn("rank", F.col("before") + F.col("nth"))

    used, spans, sequence = dict.fromkeys(histogram, 0), [], 0
    for times, chosen in plan(histogram, window):
        offset = 0
        for length in sorted(chosen, reverse=True):
            n = chosen[length]
            spans.append((length, used[length], sequence, n, offset))
            used[length] += n * times
            offset += n * length
        sequence += times
    spans.sort()
    length_, first_, sequence_, n_, offset_ = np.array(spans, np.int64).reshape(-1, 5).T
    keys = (length_ << 48) | first_

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in ("length", "rank"))
            at = np.searchsorted(keys, (length << 48) | rank, side="right") - 1
            past = rank - first_[at]
            found = [pa.array(sequence_[at] + past // n_[at]), pa.array(offset_[at] + past % n_[at] * length)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in names], *found], [*names, "sequence_id", "offset"])

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return map_arrow(ranked, run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
