"""Vectorised text kernels shared by the Arrow-batched operators.

Everything works on the UTF-8 bytes of a whole Arrow string column: word
boundaries, 64-bit word hashes and n-gram hashes come out of a fixed number of
numpy passes, so no Python object is made for a word.  Batches are cut into
pieces of a bounded number of bytes (a single longer text is one piece), so a
worker holds some arrays of a few megabytes, and gives them back after its task.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 18

#: The separators of the word pattern [^\x20\x09-\x0D]+
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LANE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of _STEP and of its inverse modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, PIECE_BYTES + 4096)
        inverse = np.uint64(pow(int(_STEP), -1, 1 << 64))
        both = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x)])) for x in (_STEP, inverse))
        if size > 4 * PIECE_BYTES:
            return both  # for one very long text; too large to keep
        _powers = both
    return _powers


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end), all of length one or more.

    A span's polynomial is a difference of prefix sums over the whole array,
    brought back to the span's start by the inverse power, all modulo 2**64.
    """
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _power(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    v = np.take(_BYTE, data)
    v *= up[: len(data)]
    np.cumsum(v, out=sums[1:])
    size = end - start
    return mix((sums[end] - sums[start]) * down[start] + size.astype(np.uint64) * _LANE[63])


@dataclass
class Words:
    """Words of some texts: byte spans, and the row that each belongs to."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray  # first[r]:first[r + 1] are the words of row r

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and row offsets of a string column; null is the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, off, buf = texts.buffers()
    offsets = np.frombuffer(off, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def split_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> Words:
    """Maximal runs of bytes that are no separator, never across rows."""
    inside = ~separator[data]
    n = len(data)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    if n:
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
        edges = offsets[(offsets > 0) & (offsets < n)]
        before[edges] = False
        after[edges - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, offsets, start, end, row, first)


def words_of(texts: pa.Array, lower: bool) -> Words:
    data, offsets = text_bytes(texts)
    return split_spans(LOWER[data] if lower else data, offsets, SPACE)


def ngrams(hashes: np.ndarray, first: np.ndarray, n: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words, and the bounds of each row's.

    A row of fewer words has none, or with ``short`` (and a word) one that
    stands for its whole sequence.
    """
    counts = np.diff(first)
    total = len(hashes)
    k = np.maximum(counts - n + 1, 0)
    bounds = np.zeros(len(k) + 1, np.int64)
    few = np.flatnonzero((counts > 0) & (counts < n)) if short else np.zeros(0, np.int64)
    k[few] = 1
    np.cumsum(k, out=bounds[1:])
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1], k) + np.repeat(first[:-1], k)
    padded = np.concatenate([hashes, np.zeros(n, np.uint64)])
    out = np.zeros(len(at), np.uint64)
    for j in range(n):
        out += padded[at + j] * _LANE[j]
    if len(few):
        whole = np.zeros(len(few), np.uint64)
        for j in range(n - 1):
            there = counts[few] > j
            whole[there] += hashes[first[few][there] + j] * _LANE[j]
        out[bounds[few]] = whole + counts[few].astype(np.uint64) * _LANE[62]
    del total
    return mix(out), bounds


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of about ``limit`` bytes of ``column``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = (np.cumsum(size) - size) // limit
        cuts = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(int(a), int(b - a))
    give_back()


def give_back() -> None:
    """Return freed memory to the system: a reused worker would keep its peak beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """int32 numbers of the keys by first appearance, and the distinct keys."""
    coded = pc.dictionary_encode(pa.array(keys), memory_pool=pa.system_memory_pool())
    return coded.indices.to_numpy(), coded.dictionary.to_numpy()


def gather(values: np.ndarray, first: np.ndarray, size: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The concatenated slices values[first[i] : first[i] + size[i]] for i in which."""
    n = size[which]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(first[which] - (ends - n), n)]


class HashIndex:
    """64-bit keys to int32 values in flat arrays, looked up a batch at a time."""

    def __init__(self, bits: int = 16):
        self.bits, self.count = bits, 0
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none."""
        out, slot = np.full(len(keys), -1, np.int32), self._slots(keys)
        todo = np.arange(len(keys))
        while len(todo):
            at = slot[todo]
            value = self.values[at]
            hit = (self.keys[at] == keys[todo]) & (value >= 0)
            out[todo[hit]] = value[hit]
            todo = todo[~hit & (value >= 0)]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that are not in yet."""
        if 2 * (self.count + len(keys)) > 1 << self.bits:
            full = self.values >= 0
            old = self.keys[full], self.values[full]
            self.__init__(max(self.bits + 1, int(np.ceil(np.log2(2 * (self.count + len(keys)) + 2)))))
            self.add(*old)
        self.count += len(keys)
        slot = self._slots(keys)
        todo = np.arange(len(keys))
        while len(todo):
            at = slot[todo]
            free = self.values[at] < 0
            self.keys[at[free]], self.values[at[free]] = keys[todo[free]], values[todo[free]]
            lost = (self.keys[at] != keys[todo]) | ~free
            todo = todo[lost]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
