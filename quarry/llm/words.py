"""Words of Arrow text columns as numpy arrays.

A word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage
return, taken from the UTF-8 bytes unchanged. A null text has no words. All functions work on one chunk
of documents at a time, so memory is bounded by the chunk, or by the largest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Text bytes that are worked on at a time.
CHUNK_BYTES = 6_000_000
#: Any odd numbers do.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about `limit` bytes, and one row at least."""
    sizes = np.array(pc.binary_length(batch.column(text)).fill_null(0), np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right"))
        to = max(to, at + 1)
        yield batch.slice(at, to - at)
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over all 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Words:
    """The words of a column of texts.

    text: all words, each followed by one space. at, length: a word's place there. first: each document's
    first word, and at the end the number of words. h: a 64-bit hash of each word's bytes.
    """

    def __init__(self, column: pa.Array, hashes: bool = True):
        column = column.fill_null("").cast(pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        buffer = column.buffers()[2]
        data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None and len(column) else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        inside = ~SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.empty(len(data), bool)
        before[:1] = True
        before[1:] = ~inside[:-1]
        starts = np.flatnonzero(inside & (before | edge[:-1]))
        after = np.empty(len(data), bool)
        after[-1:] = True
        after[:-1] = ~inside[1:]
        ends = np.flatnonzero(inside & (after | edge[1:])) + 1
        self.n = len(starts)
        self.length = ends - starts
        self.first = np.searchsorted(starts, offsets)
        sums = np.zeros(self.n + 1, np.int64)
        np.cumsum(self.length, out=sums[1:])
        self.at = sums[:-1] + np.arange(self.n)
        bytes_ = data[inside]
        self.text = np.full(len(bytes_) + self.n, 32, np.uint8)
        order = np.arange(len(bytes_))
        self.text[order + np.repeat(np.arange(self.n), self.length)] = bytes_
        self.doc = np.repeat(np.arange(len(column)), np.diff(self.first))
        if hashes:
            within = order - np.repeat(sums[:-1], self.length)
            weight = powers(BASE, int(self.length.max(initial=0)) + 1)
            self.h = mix(np.add.reduceat((bytes_.astype(np.uint64) + np.uint64(1)) * weight[within], sums[:-1]) if self.n else np.zeros(0, np.uint64))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def span(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte ranges in text of the words from a to before b, without the last space."""
        return self.at[a], self.at[b - 1] + self.length[b - 1]


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """For each word the hash of the `size` words from there on; what runs past the end isn't of use."""
    n = len(h)
    if n < size:
        return np.zeros(n, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * powers(BASE, n), out=sums[1:])
    out = np.zeros(n, np.uint64)
    out[: n - size + 1] = (sums[size:] - sums[: n - size + 1]) * powers(INVERSE, n - size + 1)
    return mix(out)


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """The least of the `size` values from each place on, by doubling."""
    out, have = x.copy(), 1
    while have < size:
        step = min(have, size - have)
        out[: len(out) - step] = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def whole(words: Words, size: int) -> np.ndarray:
    """Starts of the windows of `size` words that lie in one document."""
    end = np.repeat(words.first[1:], words.counts())
    return np.flatnonzero(np.arange(words.n) + size <= end)
