"""Quality classifier: regularised quadratic discriminant over document statistics.

Statistics of the whole text are transformed to be roughly normal. Each class has a mean
and a covariance, shrunk towards the pooled covariance and its diagonal; their
Cholesky factors are computed once and cached with the model. A document's raw
score is the difference of the classes' log densities, by Mahalanobis distances
that triangular solves give; a logistic curve fitted to the learnt rows turns it into a
probability.

All labelled rows outside the held-out fold are learnt from. Only moments and a histogram of
bounded size reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_arrow, materialise, table, text_of
from .textbytes import Texts, chunks

#: predicted is 1 from this score on.
THRESHOLD = 0.3
#: Shares of the pooled covariance and of its diagonal in each class's covariance.
POOLED_SHARE, DIAGONAL_SHARE = 0.1, 0.05
#: Least variance of a statistic that is scaled to variance 1 over all learnt rows.
FLOOR = 1e-3
#: Raw scores are binned to these for the logistic curve.
MOST_RAW, RAW_BINS = 200.0, 2000

NAMES = ("words", "word_bytes", "upper", "digits", "marks", "symbols", "bangs", "pipes", "wide", "distinct", "repeats", "lines", "longest")
D = len(NAMES)


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_UPPER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = _class("0123456789")
_MARK = _class(".,;:?'\"()-")
_SYMBOL = _class("#$%&*@^~+=<>{}[]\\/_`")


def statistics(texts: Texts) -> np.ndarray:
    """A row of transformed statistics for each text; an empty text has the values of no words."""
    n = len(texts)
    starts, ends, firsts = texts.words()
    hashes = texts.hashes(starts, ends)
    count = np.diff(firsts)
    owner = np.repeat(np.arange(n), count)
    size = np.diff(texts.offsets)
    some, words = np.maximum(size, 1), np.maximum(count, 1)
    share = lambda flags: np.log(texts.sums(flags) / some + 1e-3)
    order = np.lexsort((hashes, owner))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order][new], minlength=n)
    again = np.zeros(len(owner), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    longest = np.zeros(n)
    np.maximum.at(longest, owner, ends - starts)
    columns = (
        np.log1p(count),
        np.log1p(np.bincount(owner, weights=ends - starts, minlength=n) / words),
        share(_UPPER[texts.data]),
        share(_DIGIT[texts.data]),
        share(_MARK[texts.data]),
        share(_SYMBOL[texts.data]),
        share(texts.data == ord("!")),
        share(texts.data == ord("|")),
        share(texts.data >= 0x80),
        # Distinct words grow as a root of all words; against it, the length of a text matters less.
        np.log((distinct + 1) / (words + 1) ** 0.8),
        np.log(np.bincount(owner[again], minlength=n) / words + 1e-3),
        np.log(texts.sums(texts.data == 0x0A) / words + 1e-3),
        np.log1p(longest),
    )
    return np.stack(columns, axis=1)


def _forward(factor: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Solve ``factor @ y = row`` for each row by forward substitution; the factor is lower triangular."""
    solved = np.empty_like(rows)
    for i in range(len(factor)):
        solved[:, i] = (rows[:, i] - solved[:, :i] @ factor[i, :i]) / factor[i, i]
    return solved


@dataclass
class Model:
    """Means and cached Cholesky factors of both classes on scaled statistics, and the logistic curve."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray] = field(default_factory=list)
    factors: list[np.ndarray] = field(default_factory=list)
    logs: list[float] = field(default_factory=list)  # log determinants
    curve: tuple[float, float] = (1.0, 0.0)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log density as class 1 less that as class 0."""
        if not self.factors:
            return np.zeros(len(x))
        z = (x - self.centre) / self.scale
        logs = []
        for mean, factor, log in zip(self.means, self.factors, self.logs, strict=True):
            logs.append(-0.5 * (_forward(factor, z - mean) ** 2).sum(axis=1) - 0.5 * log)
        return np.clip(logs[1] - logs[0], -MOST_RAW, MOST_RAW)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.curve[0] * self.raw(x) + self.curve[1])))


def _moments(learnt: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """{class: (rows, sums, sums of products)} over rows (label, x)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, D + 1, D + 1))
        for batch in batches:
            label = batch.column(0).to_numpy()
            x = np.hstack([np.ones((len(label), 1)), batch.column(1).flatten().to_numpy().reshape(-1, D)])
            for c in (0, 1):
                sums[c] += x[label == c].T @ x[label == c]
        where = np.indices(sums.shape).reshape(3, -1)
        yield pa.RecordBatch.from_arrays([*[pa.array(k) for k in where], pa.array(sums.ravel())], ["label", "i", "j", "value"])

    parts = map_arrow(learnt, run, "label bigint, i bigint, j bigint, value double")
    full = np.zeros((2, D + 1, D + 1))
    for r in parts.groupBy("label", "i", "j").agg(F.sum("value").alias("value")).collect():  # 2 * (D + 1) ** 2 rows
        full[r.label, r.i, r.j] = r.value
    return {c: (full[c, 0, 0], full[c, 0, 1:], full[c, 1:, 1:]) for c in (0, 1)}


def fit(learnt: DataFrame) -> Model:
    """Fit rows (label 0 or 1, x). With too few rows of either class every score is 0.5."""
    moments = _moments(learnt)
    total = sum(n for n, _, _ in moments.values())
    if min(n for n, _, _ in moments.values()) < 2:
        return Model(np.zeros(D), np.ones(D))
    centre = sum(s for _, s, _ in moments.values()) / total
    spread = np.diag(sum(p for _, _, p in moments.values())) / total - centre**2
    model = Model(centre, np.sqrt(np.maximum(spread, 1e-12)))
    scaled = {}
    for c, (n, s, p) in moments.items():
        mean = s / n
        scaled[c] = (n, (mean - centre) / model.scale, (p / n - np.outer(mean, mean)) / np.outer(model.scale, model.scale))
    pooled = sum(n * cov for n, _, cov in scaled.values()) / total
    for c in (0, 1):
        _, mean, cov = scaled[c]
        cov = (1 - POOLED_SHARE - DIAGONAL_SHARE) * cov + POOLED_SHARE * pooled + DIAGONAL_SHARE * np.diag(np.diag(pooled)) + FLOOR * np.eye(D)
        factor = np.linalg.cholesky(cov)
        model.means.append(mean)
        model.factors.append(factor)
        model.logs.append(2 * float(np.log(np.diag(factor)).sum()))
    model.curve = _curve(learnt, model)
    return model


def _curve(learnt: DataFrame, model: Model) -> tuple[float, float]:
    """Slope and offset of the logistic curve, by Newton steps on a histogram of raw scores."""
    step = 2 * MOST_RAW / RAW_BINS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = model.raw(batch.column(1).flatten().to_numpy().reshape(-1, D))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.floor((raw + MOST_RAW) / step).astype(np.int64))], ["label", "bin"])

    rows = map_arrow(learnt, run, "label int, bin bigint").groupBy("label", "bin").count().collect()  # at most 2 * RAW_BINS rows
    x = np.array([[r.bin * step - MOST_RAW + step / 2, 1.0] for r in rows])
    y, n = np.array([r.label for r in rows], float), np.array([r["count"] for r in rows], float)
    w = np.array([0.1, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        slope = x.T @ (n * (y - p)) - np.array([1e-3, 0]) * w
        bend = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-6])
        move = np.linalg.solve(bend, slope)
        w = w + move * min(1.0, 1.0 / max(1e-9, np.abs(move).max()))
        if np.abs(move).max() < 1e-8:
            break
    return max(float(w[0]), 1e-4), float(w[1])


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, x) for every row: statistics of the whole text, null as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                x = statistics(Texts.arrow(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "x"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_arrow(docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text")), run, f"doc_id {kind}, x array<double>")


def learn(rows: DataFrame, labels: DataFrame) -> Model:
    """Fit on the measured rows that have a label and aren't held out."""
    known = labels.where("quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("label"))
    return fit(materialise(rows.where(~held_out()).join(known, "doc_id").select("label", "x"), "learnt"))


def judge(rows: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row of ``measured``, repeated rows too; an empty table gives no rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(batch.column(1).flatten().to_numpy().reshape(-1, D))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, run, f"doc_id {kind}, score double")


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is at least ``threshold``.

    A null text is scored as an empty one; rows that repeat share their fate. Other columns, whatever their
    names, are carried along unread; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                yield part.filter(pa.array(model.score(statistics(Texts.arrow(part.column(text)))) >= threshold))

    return map_arrow(docs, run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    rows = materialise(measured(table(spark, sf_dir, "documents")), "statistics")
    scored = judge(rows, learn(rows, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
