"""Vectorised views of a batch of texts as UTF-8 bytes.

Splitting 100 TB of text into Python words costs more than what any operator does
with them, so the operators here find words and hash them with numpy over the
Arrow buffer: some nanoseconds a byte, with no object per word.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes that are hashed at once; what bounds memory, however long a text or a word is.
BLOCK = 1 << 18


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse; a worker makes them once, so no plan carries them."""
    store = sys.modules.setdefault("_gridloom_worker", types.ModuleType("_gridloom_worker"))
    if not hasattr(store, "powers"):
        steps = [np.full(2 * BLOCK + 1, base, np.uint64) for base in (_MULTIPLIER, _INVERSE)]
        for x in steps:
            x[0] = 1
        store.powers = tuple(np.cumprod(x, dtype=np.uint64) for x in steps)
    return store.powers


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Texts:
    """Texts laid end to end: text ``i`` is ``data[offsets[i]:offsets[i + 1]]``."""

    data: np.ndarray
    offsets: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> Texts:
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        return cls(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum(lengths)]))

    @classmethod
    def arrow(cls, column: pa.Array) -> Texts:
        column = column.fill_null("") if column.null_count else column
        wide = pa.types.is_large_string(column.type)
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        return cls(data, offsets - offsets[0])

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def code_points(self) -> np.ndarray:
        """The number of code points of each text."""
        return self.sums((self.data & 0xC0) != 0x80)

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """For each text the sum of a boolean or small integer array over its bytes."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, firsts): byte spans of all words; text i has words firsts[i] to firsts[i + 1]."""
        n = len(self.data)
        inside = ~IS_SPACE[self.data]
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        cuts = self.offsets[(self.offsets > 0) & (self.offsets < n)]
        begins[cuts] = inside[cuts]
        stops[cuts - 1] = inside[cuts - 1]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the bytes of each span; spans are in order and don't overlap.

        Works through BLOCK bytes at once, and longer spans piece by piece.
        """
        out = np.empty(len(starts), np.uint64)
        powers, inverse = _power_tables()
        long = ends - starts > BLOCK
        for i in np.flatnonzero(long).tolist():
            total, shift = 0, 1
            for low in range(int(starts[i]), int(ends[i]), BLOCK):
                high = min(low + BLOCK, int(ends[i]))
                part = (self.data[low:high].astype(np.uint64) + np.uint64(1)) * powers[: high - low]
                total = (total + int(part.sum(dtype=np.uint64)) * shift) % (1 << 64)
                shift = shift * pow(_MULTIPLIER, high - low, 1 << 64) % (1 << 64)
            out[i] = np.uint64(total)
        rest = np.flatnonzero(~long)
        if len(rest):
            a, b = starts[rest], ends[rest]
            cuts = np.unique(np.append(np.searchsorted(a, np.arange(a[0], b[-1], BLOCK)), len(a)))
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                low, high = a[i], b[i:j].max()
                prefix = np.zeros(high - low + 1, np.uint64)
                np.cumsum((self.data[low:high].astype(np.uint64) + np.uint64(1)) * powers[: high - low], out=prefix[1:])
                out[rest[i:j]] = (prefix[b[i:j] - low] - prefix[a[i:j] - low]) * inverse[a[i:j] - low]
        return mix(out)


def shingles(hashes: np.ndarray, firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, text of each) for runs of ``width`` words; a text of fewer words has one shingle, of no words none."""
    counts = np.diff(firsts)
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    combined = np.zeros(n, np.uint64)
    steps = [np.uint64((k + 1) * 0xD6E8FEB86659FD93 % (1 << 64)) for k in range(width)]
    for k in range(min(width, n)):
        combined[: n - k] += mix(hashes[k:] + steps[k])
    owner = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(n) - firsts[owner]
    whole = counts[owner] >= width
    keep = whole & (place <= counts[owner] - width)
    short = np.flatnonzero((counts > 0) & (counts < width))
    for i in short:  # at most width - 1 words each
        a, b = firsts[i], firsts[i + 1]
        combined[a] = np.sum([mix(hashes[a + k : a + k + 1] + steps[k])[0] for k in range(b - a)], dtype=np.uint64) + np.uint64(b - a)
        keep[a] = True
    return mix(combined[keep]), owner[keep]


def chunks(batch: pa.RecordBatch, column: str, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Cut a batch where its texts pass ``most`` bytes; a longer text is a batch of its own."""
    texts = batch.column(column)
    lengths = np.diff(Texts.arrow(texts).offsets)
    at, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > most:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < len(lengths):
        yield batch.slice(at)
