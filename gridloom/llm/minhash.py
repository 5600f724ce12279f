"""Document fingerprints by one-permutation MinHash.

Each shingle is hashed once: the top bits of its hash choose a bin, the rest is its
value, and a bin keeps its least value. An empty bin takes the value of a bin
that is drawn by a hash of its own number and the attempt, the same for every text
(optimal densification), until that bin isn't empty. Of each value the low ``KEPT_BITS``
bits are stored; two fingerprints agree in a bin by chance with probability
2 ** -KEPT_BITS, and the likeness is corrected for it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import local, map_arrow, shuffle_partitions, table, text_of
from .textbytes import Texts, chunks, mix, shingles

WIDTH = 5
BIN_BITS = 9
BINS = 1 << BIN_BITS
KEPT_BITS = 4
#: Bytes of text that are fingerprinted at once.
CHUNK = 1 << 21
MOST_BUCKETS = 1 << 12

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def bins(texts: Texts, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(values, filled): densified bins of each text, and whether it has any word."""
    starts, ends, firsts = texts.words()
    hashes, owner = shingles(texts.hashes(starts, ends), firsts, width)
    values = np.full(len(texts) * BINS, _EMPTY)
    place = owner * BINS + (hashes >> np.uint64(64 - BIN_BITS)).astype(np.int64)
    np.minimum.at(values, place, hashes & np.uint64((1 << (64 - BIN_BITS)) - 1))
    values = values.reshape(-1, BINS)
    filled = np.diff(firsts) > 0
    own = values.copy()
    row, bin_ = np.nonzero((values == _EMPTY) & filled[:, None])
    attempt = 0
    while len(row):
        attempt += 1
        drawn = mix(np.arange(BINS, dtype=np.uint64) * np.uint64(0x100000001B3) + np.uint64(attempt * 0x9E3779B1)) % np.uint64(BINS)
        donor = own[row, drawn[bin_].astype(np.int64)]
        values[row, bin_] = donor
        left = donor == _EMPTY
        row, bin_ = row[left], bin_[left]
    return values, filled


def low_bits(values: np.ndarray) -> np.ndarray:
    """The stored bits of each bin. They are hashed with the bin's number: else texts of few
    shingles, whose bins hold few values, would agree by chance in many bins at once."""
    own = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BIN_BITS)
    return (mix(values ^ own) & np.uint64((1 << KEPT_BITS) - 1)).astype(np.uint8)


def pack(low: np.ndarray) -> np.ndarray:
    """Two bins a byte."""
    return (low[:, 0::2] << 4) | low[:, 1::2]


def likeness(a: np.ndarray, b: np.ndarray, has_a: np.ndarray, has_b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of texts by their low bits; two texts without words are alike, one and another are not."""
    chance = 2.0**-KEPT_BITS
    found = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0.0, 1.0)
    return np.where(has_a & has_b, found, (~has_a & ~has_b).astype(float))


def fingerprints(docs: DataFrame, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint) for every row: BINS * KEPT_BITS / 8 bytes, or none for a text without words or null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                values, filled = bins(Texts.arrow(part.column("text")), width)
                prints = [x.tobytes() if full else b"" for x, full in zip(pack(low_bits(values)), filled, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(prints, pa.binary())], ["doc_id", "fingerprint"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_arrow(docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text")), run, f"doc_id {kind}, fingerprint binary")


def _bucket(bounds: list[int], key: Column) -> Column:
    """How many of the sorted bounds are at most ``key``, in two steps of about the root of their number."""
    step = max(1, int(len(bounds) ** 0.5))
    coarse = F.array(*[F.lit(x).cast("bigint") for x in bounds[::step]])
    fine = F.array(*[F.lit(x).cast("bigint") for x in bounds])
    skipped = F.greatest(F.size(F.filter(coarse, lambda b: b <= key)) - 1, F.lit(0)) * step
    return skipped + F.size(F.filter(F.slice(fine, skipped + 1, F.lit(step)), lambda b: b <= key))


def in_order(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (bucket, sentinel, doc_id, text) dealt so that a task meets each document right before its successor.

    Ids in ascending order, null first, ties by text; the first follows the last. Buckets
    are ranges of ids; the first row of the next bucket is also sent to a bucket, as
    sentinel, so the texts cross the network once and no window spans the table.
    """
    spark = docs.sparkSession
    n = min(MOST_BUCKETS, 4 * shuffle_partitions(spark))
    base = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))
    bounds = base.agg(F.percentile_approx(key, [i / n for i in range(1, n)] or [0.5], 10 * n)).first()[0] or []
    bounds = sorted(set(bounds))
    if not bounds:
        return base.select(F.lit(0).alias("bucket"), F.lit(False).alias("sentinel"), "doc_id", "text")
    base = base.withColumn("key", key).withColumn("bucket", _bucket(bounds, F.col("key")))
    firsts = sorted((r.bucket, r.first) for r in base.groupBy("bucket").agg(F.min("key").alias("first")).collect())
    to = [(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)]
    to = F.broadcast(local(spark, {"key": pa.array([k for k, _ in to], pa.int64()), "before": pa.array([b for _, b in to], pa.int32())}))  # a row a bucket
    places = F.array(F.struct(F.col("bucket"), F.lit(False).alias("sentinel")))
    places = F.when(F.col("before").isNull(), places).otherwise(F.concat(places, F.array(F.struct(F.col("before").alias("bucket"), F.lit(True).alias("sentinel")))))
    dealt = base.join(to, "key", "left").select(F.inline(places), "key", "doc_id", "text")
    return dealt.repartition(shuffle_partitions(spark), "bucket").sortWithinPartitions("bucket", "sentinel", "key", "text").drop("key")


def edited(docs: DataFrame) -> DataFrame:
    """For each row its fingerprint, its edited text's, and how like it is to that and to the next document.

    The edited text has the last floor(n / 2) code points replaced by the first as
    many, or all, of the next document. A null text counts as empty.
    """

    def finish(rows: list, following: list) -> pa.RecordBatch:
        ids, texts = [r[0] for r in rows], [r[1] for r in rows]
        changed = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(texts, following, strict=True)]
        coded = [t.encode() for t in changed]
        n = len(texts)
        values, filled = bins(Texts.of([t.encode() for t in texts] + [following[-1].encode()] + coded))
        low = low_bits(values)
        prints = [x.tobytes().hex() if full else "" for x, full in zip(pack(low), filled, strict=True)]
        mine, has = low[:n], filled[:n]
        columns = {
            "doc_id": pa.array(ids, pa.int64()),
            "n_chars": pa.array([len(t) for t in texts], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in coded]),
            "fingerprint": pa.array(prints[:n]),
            "edited_fingerprint": pa.array(prints[n + 1 :]),
            "near_edited": pa.array(likeness(mine, low[n + 1 :], has, filled[n + 1 :])),
            "near_next": pa.array(likeness(mine, low[1 : n + 1], has, filled[1 : n + 1])),
        }
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows wait here until their successor has come; all rows in wait are of one bucket.
        wait, size, closed = [], 0, None
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(4)]
            for bucket, sentinel, doc_id, text in zip(*columns, strict=True):
                if bucket == closed:
                    continue  # a further row that ties with the sentinel
                if sentinel or size > CHUNK:
                    if wait:
                        yield finish(wait, [r[1] for r in wait[1:]] + [text])
                    wait, size = [], 0
                if sentinel:
                    closed = bucket
                    continue
                wait.append((doc_id, text))
                size += len(text)

    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return map_arrow(in_order(docs), run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return edited(table(spark, sf_dir, "documents"))
