"""Personal data by patterns and a skip-chain conditional random field.

Patterns find the base spans. The field then labels the tokens of each document that look
like personal data but match no pattern, such as a phone number written again
without its plus. Its nodes are the base spans and those tokens in text order. A chain edge joins
neighbours, a skip edge joins tokens of the same or similar characters however far
apart. Loopy sum-product passing spreads labels along both; a token whose
marginal for a kind reaches ``LEAST_MARGINAL`` becomes a further span. Base spans are
observed and keep their labels.

Token, chain and skip weights are learnt together from all documents by pseudo-likelihood: each
labelled node is predicted from what it says and its neighbours' labels. What it says is masked,
its punctuation left out, as that tells a base span from any other token. Tokens that a skip edge
joins to a base span have no label to learn from: whether they share it is what the field is for.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, table, text_of

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)  # the label of a token that is none of them
LABELS = OTHER + 1

# The base patterns, found here in time linear in the text.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_DIGITS = re.compile(r"[0-9]+")
_SPACED = re.compile(r"[0-9][0-9\x20-]*")
_GAP = re.compile(r"[\x20-]{2,}")
_ANY_DIGIT = re.compile("[0-9]")

#: A run of the characters that an address may have; an address lies within one run.
_RUN = re.compile(r"[A-Za-z0-9._%+@-]+")
_AT = re.compile("[A-Za-z0-9]@[A-Za-z0-9]")
_NUMBER = re.compile(r"\(?[0-9][\x20().0-9-]{5,}[0-9]")
_PART = re.compile(r"[().0-9-]+")

#: Digits of a token at least, and at most, as no kind has more.
LEAST_DIGITS, MOST_DIGITS = 7, 19
ROUNDS, DAMPING = 30, 0.5
LEAST_MARGINAL = 0.9
#: A token is like another if its characters are the same, or begin or end with all of the other's, of which there are at least so many.
LEAST_SHARED = 7
#: Lengths of what a token says are told apart up to these.
_LENGTHS = (6, 8, 11, 15, 19)
SHAPES = 3 + len(_LENGTHS) + 1
#: Skip neighbours of one label that count.
MOST_NEAR = 3

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        # A local part and the text after its @ don't depend on where in a run of its characters it starts: the leftmost start decides.
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, 0, done
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[Span]:
    for run in _DOTTED.finditer(text):
        if text.count(".", run.start(), run.end()) < 3:
            continue
        parts: list[re.Match] = []
        for part in _DIGITS.finditer(text, run.start(), run.end()):
            if parts and part.start() != parts[-1].end() + 1:
                parts = []  # two dots in a row
            parts.append(part)
            if len(parts) == 4:
                if all(len(x := p.group().lstrip("0")) <= 3 and int(x or 0) <= 255 for p in parts):
                    yield parts[0].start(), 1, part.end()
                parts = []


def _cards(text: str) -> Iterator[Span]:
    for run in _SPACED.finditer(text):
        low = run.start()
        if run.end() - low < 12:
            continue
        for high, after in [*((g.start(), g.end()) for g in _GAP.finditer(text, low, run.end())), (run.end(), run.end())]:
            stop = high - (high > low and text[high - 1] in " -")
            if stop - low >= 12:
                digits = digits_of(text[low:stop])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    yield low, 2, stop
            low = after


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the base spans in order; places are code points, end exclusive."""
    found = list(_emails(text)) if "@" in text else []
    if _ANY_DIGIT.search(text):
        found += [*_ips(text), *_cards(text)]
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    return sorted(found)


def tokens(text: str, base: list[Span]) -> list[Span]:
    """(start, label, end) of the field's nodes in order: base spans, and other runs with an @ or of as many digits as a kind may have."""
    nodes, free, at = list(base), [], 0
    # Base spans may overlap each other; what none of them covers is searched for other tokens.
    for start, _, end in base:
        if start > at:
            free.append((at, start))
        at = max(at, end)
    free.append((at, len(text)))
    for low, high in free:
        if text.find("@", low, high) >= 0:
            nodes += [(m.start(), OTHER, m.end()) for m in _RUN.finditer(text, low, high) if _AT.search(m.group())]
        for m in _NUMBER.finditer(text, low, high):
            # More digits than any kind has are several numbers in a row.
            parts = [m] if len(digits_of(m.group())) <= MOST_DIGITS else _PART.finditer(text, m.start(), m.end())
            nodes += [(x.start(), OTHER, x.end()) for x in parts if LEAST_DIGITS <= len(digits_of(x.group())) <= MOST_DIGITS]
    return sorted(nodes)


def content(token: str) -> str:
    """What a token says without its punctuation."""
    return re.sub("[^a-z0-9]", "", token.lower())


def shape(said: str) -> list[int]:
    """Features of what a token says."""
    number = said.isdigit()
    length = sum(len(said) > n for n in _LENGTHS)
    return [1, int(number), int(number and 12 <= len(said) <= 19 and luhn(said)), *(int(length == k) for k in range(len(_LENGTHS) + 1))]


def similar(said: list[str], labels: list[int]) -> list[tuple[int, int]]:
    """Skip edges, a number that grows with the nodes and not with their pairs.

    Equal tokens are joined in a chain from one to the next, and each to the first of them
    that is a base span. A longer token is joined to the longest of the others that it begins with, to the longest base
    span among those, and likewise to what it ends with.
    """
    edges, seen = [], {}
    first = {s: i for i, s in reversed(list(enumerate(said))) if labels[i] != OTHER}
    for i, s in enumerate(said):
        if s in seen:
            edges.append((seen[s], i))
        if labels[i] == OTHER and s in first and seen.get(s) != first[s]:
            edges.append((first[s], i))
        seen[s] = i
    at = {s: first.get(s, i) for s, i in seen.items() if len(s) >= LEAST_SHARED}
    for turn in (1, -1):
        stack: list[str] = []  # in sorted order, those that the present one begins with
        for s in sorted(x[::turn] for x in at):
            while stack and not s.startswith(stack[-1]):
                stack.pop()
            if stack:
                near = {at[stack[-1][::turn]]} | {at[b[::turn]] for b in next(([x] for x in reversed(stack) if x[::turn] in first), [])}
                edges += [(i, at[s[::turn]]) for i in sorted(near)]
            stack.append(s)
    return edges


def marginals(unary: np.ndarray, groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Loopy sum-product passing over log potentials; a row of label probabilities for each node.

    A group has the first and the second node of its edges, and the potential that they share, by label of each.
    """
    groups = [g for g in groups if len(g[0])]
    passed = [(np.zeros((len(a), LABELS)), np.zeros((len(a), LABELS))) for a, _, _ in groups]

    def beliefs() -> np.ndarray:
        out = unary.copy()
        for (a, b, _), (forth, back) in zip(groups, passed, strict=True):
            np.add.at(out, b, forth)
            np.add.at(out, a, back)
        return out

    for _ in range(ROUNDS if groups else 0):
        belief, moved, now = beliefs(), 0.0, []
        for (a, b, pair), (forth, back) in zip(groups, passed, strict=True):
            new_forth = _log_sum((belief[a] - back)[:, :, None] + pair, 1)
            new_back = _log_sum((belief[b] - forth)[:, None, :] + pair, 2)
            moved = max(moved, np.abs(new_forth - forth).max(), np.abs(new_back - back).max())
            now.append((DAMPING * forth + (1 - DAMPING) * new_forth, DAMPING * back + (1 - DAMPING) * new_back))
        passed = now
        if moved < 1e-4:
            break
    return _normal(beliefs())


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    out = np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)
    return out - out.max(axis=1, keepdims=True)


def _normal(logs: np.ndarray) -> np.ndarray:
    p = np.exp(logs - logs.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


@dataclass
class Field:
    weights: np.ndarray  # SHAPES x LABELS
    chain: np.ndarray  # LABELS x LABELS: of the first node of an edge, of the second
    skip: np.ndarray  # LABELS x LABELS, symmetric

    def spans(self, text: str, base: list[Span]) -> list[Span]:
        """Base spans and those that the field adds, in order."""
        nodes = tokens(text, base)
        if len(nodes) == len(base):
            return base
        said = [content(text[a:b]) for a, _, b in nodes]
        unary = np.array([shape(s) for s in said], float) @ self.weights
        seen = np.array([label for _, label, _ in nodes])
        unary[seen != OTHER] = -50.0
        unary[seen != OTHER, seen[seen != OTHER]] = 0.0
        line = np.arange(len(nodes) - 1)
        skips = np.array(similar(said, seen.tolist()), int).reshape(-1, 2)
        found = marginals(unary, [(line, line + 1, self.chain), (skips[:, 0], skips[:, 1], self.skip)])
        kind = found.argmax(axis=1)
        more = np.flatnonzero((seen == OTHER) & (kind != OTHER) & (found.max(axis=1) >= LEAST_MARGINAL))
        return sorted(base + [(nodes[i][0], int(kind[i]), nodes[i][2]) for i in more.tolist()])


def examples(text: str) -> list[tuple[int, ...]]:
    """A row for each node of a text whose label is known: its shape, the label before it, the label after it (LABELS for none
    or one that isn't known), how many skip neighbours have each label, and its own."""
    nodes = tokens(text, base_spans(text))
    if not nodes:
        return []
    said, labels = [content(text[a:b]) for a, _, b in nodes], [label for _, label, _ in nodes]
    near: list[list[int]] = [[] for _ in nodes]
    for i, j in similar(said, labels):
        near[i].append(j)
        near[j].append(i)
    known = [label != OTHER or all(labels[j] == OTHER for j in near[i]) for i, label in enumerate(labels)]
    told = lambda i: labels[i] if 0 <= i < len(nodes) and known[i] else LABELS
    rows = []
    for i in range(len(nodes)):
        if known[i]:
            counts = [0] * (LABELS + 1)
            for j in near[i]:
                counts[told(j)] += 1
            rows.append((*shape(said[i]), told(i - 1), told(i + 1), *(min(c, MOST_NEAR) for c in counts[:LABELS]), labels[i]))
    return rows


def learn(docs: DataFrame, text: str = "text") -> Field:
    """Learn the field from all documents. What reaches the driver is a count for each different row of ``examples``, of which
    the features allow a bounded number; without any, all weights are 0 and no span is added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, int] = {}
        for batch in batches:
            for one in batch.column(0):
                for row in examples(one.as_py()):
                    groups[row] = groups.get(row, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(map(list, groups)), pa.list_(pa.int32())), pa.array(list(groups.values()), pa.int64())], ["row", "n"])

    some = docs.select(text_of(text).alias("text")).where(F.col("text").rlike("[@0-9]"))
    rows = map_arrow(some, run, "row array<int>, n bigint").groupBy("row").agg(F.sum("n").alias("n")).collect()
    rows.sort(key=lambda r: r.row)
    return fit(np.array([r.row for r in rows], int).reshape(-1, SHAPES + LABELS + 3), np.array([r.n for r in rows], float))


def fit(rows: np.ndarray, n: np.ndarray, ridge: float = 1.0, steps: int = 600) -> Field:
    """Maximise the pseudo-likelihood of the rows of ``examples``, each n times, by accelerated gradient steps; a ridge keeps weights small."""
    eye = np.vstack([np.eye(LABELS), np.zeros(LABELS)])
    x, before, after, near, y = rows[:, :SHAPES].astype(float), eye[rows[:, SHAPES]], eye[rows[:, SHAPES + 1]], rows[:, SHAPES + 2 : -1].astype(float), eye[rows[:, -1]]
    inputs = np.hstack([x, before, after, near])
    cut = np.cumsum([SHAPES, LABELS, LABELS])
    now = [np.zeros((SHAPES, LABELS)), np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS))]
    if len(rows):
        ahead, last = [w.copy() for w in now], [w.copy() for w in now]
        rate = 1.0 / (2.0 * np.linalg.norm(inputs.T * n @ inputs, 2) + ridge)
        for k in range(steps):
            weights, chain, skip = ahead
            p = _normal(x @ weights + before @ chain + after @ chain.T + near @ skip)
            slope = np.split(inputs.T @ (n[:, None] * (p - y)), cut)
            slopes = [slope[0], slope[1] + slope[2].T, (slope[3] + slope[3].T) / 2]
            now = [a - rate * (s + ridge * a) for a, s in zip(ahead, slopes, strict=True)]
            ahead = [w + k / (k + 3) * (w - v) for w, v in zip(now, last, strict=True)]
            last = now
    return Field(*now)


def spell(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find(docs: DataFrame, field: Field, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row, repeated ones too: doc_id, the number of base spans of each kind, their digest, and all spans spelt out and joined.

    A null text counts as empty, a null id stays null. Spans that start together are in the order of KINDS. Other
    columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, base, spans = [[] for _ in KINDS], [], []
            for one in batch.column(1):
                found = base_spans(one := one.as_py())
                for kind, column in enumerate(counts):
                    column.append(sum(k == kind for _, k, _ in found))
                base.append(hashlib.sha256(spell(found).encode()).hexdigest())
                spans.append(spell(field.spans(one, found)))
            columns = [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(base, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"
    return map_arrow(docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text")), run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, learn(docs))
