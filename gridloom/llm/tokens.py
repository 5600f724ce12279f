"""Token ids of whole texts, by a public tokenizer with a cache of units.

The vocabulary's pre-tokenizer never joins across ASCII white space, and within a word it
parts letters, digits and signs. A unit is such a part where bytes alone tell the
parts: words of ASCII and Latin-1 letters, digits and signs. Any other word (with an
apostrophe, a control character, another script, the start of a special token) is a
unit as a whole. A text's ids are the ids of its units in turn, so only units that a
worker has not met go through the tokenizer.

Units are told apart by their bytes, never by a hash alone: up to 15 bytes are a pair of
integers that hold the bytes and their number, which the table keeps and compares; longer
units are looked up by the bytes themselves.
"""

from __future__ import annotations

import os
import sys
import types

import numpy as np

from .textbytes import IS_SPACE, Texts, mix

#: Units whose ids a worker keeps; beyond it the cache starts anew.
MOST_UNITS = 1 << 18
#: Units that are looked up together: what bounds memory, however long a text is.
BLOCK = 1 << 16
#: Units that go through the tokenizer as one string.
AT_ONCE = 512
PACKED = 15

_LETTER, _DIGIT, _SIGN, _ODD = 1, 2, 3, 4
_KIND = np.full(256, _ODD, np.uint8)  # of a byte; non-ASCII bytes, control characters and the apostrophe are odd
_KIND[0x21:0x7F] = _SIGN
_KIND[ord("0") : ord("9") + 1] = _DIGIT
_KIND[ord("A") : ord("Z") + 1] = _KIND[ord("a") : ord("z") + 1] = _LETTER
_KIND[ord("'")] = _ODD
_KIND[IS_SPACE] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def units(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, whole): byte spans of all units in order, and which of them are whole words."""
    data = texts.data
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    kind = _KIND[data]
    # Two bytes C3 80 to C3 BF are Latin-1 letters, but for the signs of multiplication and division.
    lead = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7))
    kind[lead] = kind[lead + 1] = _LETTER
    bars = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
    kind[bars] = _ODD
    starts, ends, _ = texts.words()
    odd = np.concatenate([[0], np.cumsum(kind == _ODD, dtype=np.int32)])
    is_odd = odd[ends] > odd[starts]
    begins = np.empty(len(data), bool)
    begins[0] = True
    begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    begins &= kind != 0
    if is_odd.any():  # no cuts within these words
        a, b = starts[is_odd], ends[is_odd]
        inside = np.zeros(len(data) + 1, np.int8)
        inside[a], inside[b] = 1, -1  # words never touch but where texts do
        inside[np.intersect1d(a, b)] = 0
        begins[np.cumsum(inside[:-1], dtype=np.int8) == 1] = False
    begins[starts] = True
    cuts = np.flatnonzero(begins)
    word = np.searchsorted(starts, cuts, side="right") - 1
    stops = np.minimum(np.append(cuts[1:], len(data)), ends[word])
    return cuts, stops, is_odd[word]


class Encoder:
    """Ids by units."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a pre-token
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        size = 2 * MOST_UNITS
        self.low, self.high, self.entry = np.zeros(size, np.uint64), np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        self.long: dict[bytes, int] = {}
        self.at, self.count, self.known = np.zeros(MOST_UNITS + 1, np.int64), np.zeros(MOST_UNITS + 1, np.int64), 0
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): ids of all texts end to end; text i has ids[offsets[i]:offsets[i + 1]]."""
        starts, ends, whole = units(texts)
        data = np.concatenate([texts.data, np.zeros(16, np.uint8)])
        folded = _LOWER[data]
        found, counts = [], []
        for k in range(0, len(starts), BLOCK):
            entry = self._entries(data, folded, starts[k : k + BLOCK], ends[k : k + BLOCK], whole[k : k + BLOCK])
            count = self.count[entry]
            total = np.cumsum(count)
            found.append(self.ids[np.arange(total[-1]) + np.repeat(self.at[entry] - total + count, count)])
            counts.append(count)
        if not found:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        total = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        return np.concatenate(found), total[np.searchsorted(starts, texts.offsets)]

    def _entries(self, data: np.ndarray, folded: np.ndarray, starts: np.ndarray, ends: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """The cache's entry of each unit."""
        size = ends - starts
        short = size <= PACKED
        low, high = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
        for source, rows in ((folded, np.flatnonzero(short & ~whole)), (data, np.flatnonzero(short & whole))):
            eight = np.lib.stride_tricks.as_strided(source[: len(source) - 8].view(np.uint8), (len(source) - 8, 8), (1, 1))
            at, n = starts[rows], size[rows]
            low[rows] = eight[at].reshape(-1).view("<u8") & _MASKS[np.minimum(n, 8)]
            high[rows] = (eight[at + 8].reshape(-1).view("<u8") & _MASKS[np.maximum(n - 8, 0)]) | (n.astype(np.uint64) << np.uint64(56))
        spelt = {i: (data if whole[i] else folded)[starts[i] : ends[i]].tobytes() for i in np.flatnonzero(~short).tolist()}
        entry = np.full(len(starts), -1, np.int64)
        entry[short] = self._find(low[short], high[short])
        for i, word in spelt.items():
            entry[i] = self.long.get(word, -1)
        if (entry < 0).any():
            if self.known + np.count_nonzero(entry < 0) > MOST_UNITS:
                self.clear()
                entry[:] = -1
            new = np.flatnonzero((entry < 0) & short)
            order = new[np.lexsort((low[new], high[new]))]
            first = np.ones(len(order), bool)
            first[1:] = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])
            ones = order[first]
            more = {}
            for i in np.flatnonzero((entry < 0) & ~short).tolist():
                more.setdefault(spelt[i], i)
            rows = np.concatenate([ones, np.array(list(more.values()), np.int64)])
            base = self.known
            self._learn([(data if w else folded)[a:b].tobytes() for a, b, w in zip(starts[rows].tolist(), ends[rows].tolist(), whole[rows].tolist(), strict=True)], whole[rows])
            self._insert(low[ones], high[ones], base + np.arange(len(ones)))
            self.long.update(zip(more, range(base + len(ones), base + len(rows)), strict=True))
            entry[order] = base + np.cumsum(first) - 1
            for i in np.flatnonzero((entry < 0) & ~short).tolist():
                entry[i] = self.long[spelt[i]]
        return entry

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (mix(low + mix(high)) & np.uint64(len(self.low) - 1)).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        found = np.full(len(low), -1, np.int64)
        left, slot = np.arange(len(low)), self._slot(low, high)
        while len(left):
            entry = self.entry[slot]
            same = (entry >= 0) & (self.low[slot] == low[left]) & (self.high[slot] == high[left])
            found[left[same]] = entry[same]
            on = (entry >= 0) & ~same
            left, slot = left[on], (slot[on] + 1) & (len(self.low) - 1)
        return found

    def _insert(self, low: np.ndarray, high: np.ndarray, entry: np.ndarray) -> None:
        slot = self._slot(low, high)
        while len(low):
            free = np.flatnonzero(self.entry[slot] < 0)
            self.entry[slot[free]] = entry[free]
            got = self.entry[slot] == entry  # of several that want a free slot one gets it
            self.low[slot[got]], self.high[slot[got]] = low[got], high[got]
            low, high, entry, slot = low[~got], high[~got], entry[~got], (slot[~got] + 1) & (len(self.low) - 1)

    def _learn(self, words: list[bytes], whole: np.ndarray) -> None:
        """Encode new units; their entries follow those that are there."""
        parts, alone = np.flatnonzero(~whole), [np.flatnonzero(whole)]
        order, counts, ids = [], [], []
        for k in range(0, len(parts), AT_ONCE):
            run = parts[k : k + AT_ONCE]
            flat = np.array(self._encode([b" ".join([words[i] for i in run.tolist()])])[0], np.uint32)
            # Each part of a word is one pre-token, whose last id alone ends with the mark of a word's end.
            stops = np.flatnonzero(self.closes[flat]) + 1
            if len(stops) != len(run):
                alone.append(run)
                continue
            order.append(run)
            counts.append(np.diff(stops, prepend=0))
            ids.append(flat)
        rest = np.concatenate(alone)
        for k in range(0, len(rest), AT_ONCE):
            found = self._encode([words[i] for i in rest[k : k + AT_ONCE].tolist()])
            order.append(rest[k : k + AT_ONCE])
            counts.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.array([i for x in found for i in x], np.uint32))
        entry, count, flat = self.known + np.concatenate(order), np.concatenate(counts), np.concatenate(ids)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.at[entry] = self.used + np.cumsum(count) - count
        self.count[entry] = count
        self.used, self.known = self.used + len(flat), self.known + len(words)

    def _encode(self, strings: list[bytes]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast([s.decode("utf-8", "replace") for s in strings], add_special_tokens=False)]


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary; it outlives the task, so later tasks meet a warm cache."""
    store = sys.modules.setdefault("_gridloom_worker", types.ModuleType("_gridloom_worker"))
    if getattr(store, "path", None) != path:
        store.path, store.encoder = path, Encoder(path)
    return store.encoder
