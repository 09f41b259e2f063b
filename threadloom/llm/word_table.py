"""An exact, array-wise cache from words to token ids.

Words (runs of bytes between ASCII white space, or as `bounds` says) of up to LONGEST bytes are packed into two 64-bit numbers, which
stand for just that word, and looked up in an open-addressing table, all words of a chunk of texts at
once. Only words that the table doesn't hold go through Python, each distinct one once a chunk. A full table
is emptied, so memory is bounded; longer words are never kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np

LONGEST = 15
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def bounds(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words of data, which also end at cuts."""
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(_SPACE[data], out=inside[1:-1])
    step = inside[1:] != inside[:-1]
    starts, ends = np.flatnonzero(step & inside[1:]), np.flatnonzero(step & inside[:-1])
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    cuts = cuts[inside[cuts] & inside[cuts + 1]]  # a word on both sides
    if len(cuts):
        cuts = np.unique(cuts)
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return starts, ends


def _packed(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of up to LONGEST bytes as two numbers; data has 16 bytes more than the words need."""
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    a = eight[starts] & _MASK[np.minimum(lengths, 8)]
    b = eight[starts + 8] & _MASK[np.maximum(lengths - 8, 0)] | lengths.astype(np.uint64) << _U(56)
    return a, b


class WordTable:
    """`ids_of` gives the ids of distinct words as little-endian bytes, in the order given; `bounds` where words start and end."""

    def __init__(self, ids_of: Callable[[list[bytes]], Iterable[bytes]], most: int = 1_000_000, bounds=bounds):
        self.ids_of, self.most, self.bounds = ids_of, most, bounds
        self.bits = (2 * most - 1).bit_length()
        self.clear()

    def clear(self):
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys = np.empty((2, self.most), np.uint64)
        self.first = np.empty(self.most, np.uint32)
        self.count = np.empty(self.most, np.uint16)
        self.pool = np.empty(8 * self.most, "<u4")
        self.n = self.used = 0

    def _slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = (a ^ b * _U(0x9E3779B97F4A7C15)) * _U(0xBF58476D1CE4E5B9)
        h ^= h >> _U(29)
        return ((h * _U(0x94D049BB133111EB)) >> _U(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The entry of each word, or -1."""
        slot = self._slot(a, b)
        out = self.slots.take(slot)
        there = out.clip(0)
        open_ = np.flatnonzero((out >= 0) & ((self.keys[0].take(there) != a) | (self.keys[1].take(there) != b)))
        while len(open_):
            slot[open_] = slot[open_] + 1 & (1 << self.bits) - 1
            got = self.slots.take(slot[open_])
            out[open_] = got
            there = got.clip(0)
            open_ = open_[(got >= 0) & ((self.keys[0].take(there) != a[open_]) | (self.keys[1].take(there) != b[open_]))]
        return out

    def add(self, a: np.ndarray, b: np.ndarray, ids: list[bytes]) -> np.ndarray:
        """Enters distinct new words; returns their entries. There must be room."""
        entries = np.arange(self.n, self.n + len(a), dtype=np.int64)
        self.keys[0, entries], self.keys[1, entries] = a, b
        flat = np.frombuffer(b"".join(ids), "<u4")
        counts = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty(max(len(flat), self.most), "<u4")])
        self.pool[self.used : self.used + len(flat)] = flat
        self.first[entries], self.count[entries] = self.used + np.cumsum(counts) - counts, counts
        self.used += len(flat)
        self.n += len(a)
        slot, todo = self._slot(a, b), np.arange(len(a))
        while len(todo):
            at = slot[todo]
            free = self.slots[at] < 0
            self.slots[at[free]] = entries[todo[free]]
            todo = todo[self.slots[at] != entries[todo]]  # taken before, or by another of these words
            slot[todo] = slot[todo] + 1 & (1 << self.bits) - 1
        return entries

    def encode(self, data: np.ndarray, cuts: np.ndarray, end: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each text) of the texts data[cuts[k]:cuts[k + 1]]; each text ends with the ids `end`."""
        starts, ends = self.bounds(data, cuts)
        lengths = ends - starts
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        short = lengths <= LONGEST
        a, b = _packed(padded, starts, np.minimum(lengths, LONGEST))
        entry = self.find(a, b).astype(np.int64)
        entry[~short] = -1
        missing, full = np.flatnonzero(entry < 0), False
        extra: list[bytes] = [end]
        if len(missing):
            raw, numbers = data.tobytes(), {}
            which = np.fromiter((numbers.setdefault(raw[s:e], len(numbers)) for s, e in zip(starts[missing].tolist(), ends[missing].tolist(), strict=True)), np.int64, len(missing))
            got = list(self.ids_of(list(numbers)))
            lead = np.empty(len(numbers), np.int64)
            lead[which[::-1]] = missing[::-1]
            kept = np.flatnonzero(short[lead])
            full = self.n + len(kept) > self.most
            if full:  # what was found stays usable for this chunk; the table starts anew with the next one
                kept = kept[:0]
            place = np.full(len(numbers), -1, np.int64)
            if len(kept):
                place[kept] = self.add(a[lead[kept]], b[lead[kept]], [got[k] for k in kept.tolist()])
            rest = np.flatnonzero(place < 0)
            place[rest] = -2 - np.arange(1, len(rest) + 1)
            extra += [got[k] for k in rest.tolist()]
            entry[missing] = place[which]
        # the end of each text is a word of its own, entry -2
        entry = np.insert(entry, np.searchsorted(starts, cuts[1:]), -2)
        flat = np.frombuffer(b"".join(extra), "<u4")
        counts = np.fromiter(map(len, extra), np.int64, len(extra)) // 4
        first = self.used + np.cumsum(counts) - counts
        own = entry < 0
        known = np.where(own, 0, entry)
        count = np.where(own, counts.take(-2 - entry, mode="clip"), self.count.take(known))
        start = np.where(own, first.take(-2 - entry, mode="clip"), self.first.take(known))
        stops = np.cumsum(count)
        total = int(stops[-1]) if len(stops) else 0
        at = np.repeat(start - stops + count, count) + np.arange(total)
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty(max(len(flat), self.most), "<u4")])
        self.pool[self.used : self.used + len(flat)] = flat  # beyond the entries; overwritten by the next ones
        ids = self.pool.take(at)
        marks = stops[entry == -2]
        if full:
            self.clear()
        return ids, np.diff(marks, prepend=0)
