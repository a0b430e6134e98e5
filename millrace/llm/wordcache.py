"""Tokens of words by a table that a task keeps: each different word is tokenized once, all others are looked up.

Words are found by 64-bit hashes of their bytes in an open-addressing table of bounded size, and the bytes found are
compared with the word's; of two words with one hash the later is tokenized where it stands. A full table is emptied but
for the words that were met again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from .common import NOT_SPACE, buffer_of, mix, word_spans

#: Slots of the table, words and bytes of words at which it is emptied.
BITS, MOST, MOST_BYTES = 21, 800_000, 16 << 20
#: Words of more bytes are hashed and compared one by one, others eight bytes at a time.
LONG = 64
#: The bytes of an eight that belong to a word with 0 to 8 bytes left.
LEFT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _gather(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of spans one after the other, and where each begins (n + 1 numbers)."""
    off = np.concatenate([[0], np.cumsum(size)])
    return data[np.repeat(starts - off[:-1], size) + np.arange(int(off[-1]))], off


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at each byte as a number."""
    return np.ndarray((len(data),), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    size, eights = ends - starts, _eights(data)
    out = size.astype(np.uint64)
    some, k = np.flatnonzero(size <= LONG), 0
    while len(some):
        out[some] = mix(out[some] * np.uint64(0x9E3779B97F4A7C15) + (eights[starts[some] + k] & LEFT[np.minimum(size[some] - k, 8)]))
        k += 8
        some = some[size[some] > k]
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest())
    return out


class WordTable:
    """make: from a LargeStringArray of different words to values (numbers) and how many each word has."""

    def __init__(self, make):
        self.make = make
        self.reset()

    def reset(self) -> None:
        self.keys = np.zeros(1 << BITS, np.uint64)
        self.place = np.zeros(1 << BITS, np.int32)
        self.n = self.used = self.spelled = 0
        self.size = np.zeros(1 << 14, np.int32)  # values of each word
        self.begin = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int32)  # bytes of each word
        self.first = np.zeros(1 << 14, np.int64)
        self.met = np.zeros(1 << 14, np.int64)  # how often each word was met
        self.values = np.zeros(1 << 16, np.uint32)
        self.bytes = np.zeros(1 << 18, np.uint8)

    def renew(self) -> None:
        """Empty the table but for the words met twice or more, half of it at most."""
        often = np.flatnonzero(self.met[: self.n] > 1)
        if len(often) > MOST // 2:
            often = often[np.argsort(self.met[often], kind="stable")[-(MOST // 2) :]]
        sums = lambda n: np.cumsum(n, dtype=np.int64)
        n, size = self.size[often], self.length[often]
        if int(sums(n)[-1:].sum()) > MOST_BYTES // 2 or int(sums(size)[-1:].sum()) > MOST_BYTES // 2:
            often = n = size = np.zeros(0, np.int64)
        values, raw = _gather(self.values, self.begin[often], n)[0], _gather(self.bytes, self.first[often], size)[0]
        self.reset()
        if len(often):
            ends = sums(size)
            h = np.maximum(word_hashes(raw, ends - size, ends), np.uint64(1))
            new = self.put(raw, np.concatenate([[0], ends]), values, n)
            _, one = np.unique(h, return_index=True)
            self.link(h[one], new[one])

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        out = np.full(len(h), -1, np.int32)
        at, slot = np.arange(len(h)), (h >> np.uint64(64 - BITS)).astype(np.int64)
        while len(at):
            key = self.keys[slot]
            hit = key == h[at]
            out[at[hit]] = self.place[slot[hit]]
            more = ~hit & (key != 0)
            at, slot = at[more], (slot[more] + 1) & ((1 << BITS) - 1)
        return out

    def append(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokenize words and put them in, without a slot; their places."""
        raw, off = _gather(data, starts, size)
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes()))
        return self.put(raw, off, *self.make(words))

    def put(self, raw: np.ndarray, off: np.ndarray, values: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Put words in by their bytes and values, without a slot; their places."""
        size = np.diff(off)
        while self.n + len(size) > len(self.size):
            self.size, self.begin, self.length, self.first, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.size, self.begin, self.length, self.first, self.met))
        while self.used + len(values) > len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        while self.spelled + len(raw) + 8 > len(self.bytes):
            self.bytes = np.concatenate([self.bytes, np.zeros_like(self.bytes)])
        new = np.arange(self.n, self.n + len(size))
        self.size[new], self.begin[new] = n, self.used + np.cumsum(n) - n
        self.length[new], self.first[new] = size, self.spelled + off[:-1]
        self.values[self.used : self.used + len(values)] = values
        self.bytes[self.spelled : self.spelled + len(raw)] = raw
        self.n, self.used, self.spelled = self.n + len(size), self.used + len(values), self.spelled + len(raw)
        return new

    def link(self, h: np.ndarray, new: np.ndarray) -> None:
        """Give different new hashes slots that lead to places."""
        at, slot = np.arange(len(h)), (h >> np.uint64(64 - BITS)).astype(np.int64)
        while len(at):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[at[free]]  # of several on one slot the last stays
            won = self.keys[slot] == h[at]
            self.place[slot[won]] = new[at[won]]
            at, slot = at[~won], (slot[~won] + 1) & ((1 << BITS) - 1)

    def differ(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which words are not, byte by byte, those at the places."""
        other = self.length[at] != size
        mine, theirs = _eights(data), np.ndarray((len(self.bytes) - 7,), "<u8", self.bytes, strides=(1,))
        some, k = np.flatnonzero(~other & (size <= LONG)), 0
        while len(some):
            other[some] |= ((mine[starts[some] + k] ^ theirs[self.first[at[some]] + k]) & LEFT[np.minimum(size[some] - k, 8)]) != 0
            k += 8
            some = some[size[some] > k]
        for i in np.flatnonzero(~other & (size > LONG)).tolist():
            other[i] = not np.array_equal(data[starts[i] : starts[i] + size[i]], self.bytes[self.first[at[i]] :][: size[i]])
        return np.flatnonzero(other)

    def places(self, arr: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all the texts' words in order, and each text's first word."""
        data, offsets = buffer_of(arr)
        starts, ends, first = word_spans(data, offsets, NOT_SPACE)
        size = ends - starts
        h = np.maximum(word_hashes(data, starts, ends), np.uint64(1))  # 0 is an empty slot
        if self.n > MOST or self.spelled > MOST_BYTES or self.used > MOST_BYTES:
            self.renew()
        at = self.find(h)
        if len(miss := np.flatnonzero(at < 0)):
            _, one = np.unique(h[miss], return_index=True)
            for a in range(0, len(one), MOST // 4):  # the slots never run out
                some = miss[one[a : a + MOST // 4]]
                if self.n > 2 * MOST:
                    break
                self.link(h[some], self.append(data, starts[some], size[some]))
            at[miss] = self.find(h[miss])
        if len(bad := np.flatnonzero(at < 0)):  # a batch of more words than the table takes
            at[bad] = self.append(data, starts[bad], size[bad])
        if len(bad := self.differ(data, starts, size, at)):
            at[bad] = self.append(data, starts[bad], size[bad])
        self.met[: self.n] += np.bincount(at, minlength=self.n)
        return at, first

    def sizes(self, arr: pa.LargeStringArray) -> np.ndarray:
        """How many values each text has."""
        at, first = self.places(arr)
        return np.diff(np.concatenate([[0], np.cumsum(self.size[at], dtype=np.int64)])[first])

    def all_values(self, arr: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """Values of all texts, one after the other, and where each text's begin (n + 1 numbers)."""
        at, first = self.places(arr)
        each = self.size[at].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(each)])
        where = np.repeat(self.begin[at] - total[:-1], each)
        where += np.arange(len(where))
        return self.values[where], total[first]
