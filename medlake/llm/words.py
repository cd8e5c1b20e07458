"""Vectorised word splitting and hashing over Arrow string buffers.

Words are maximal runs of bytes other than space and 0x09-0x0D, which on UTF-8 equals
the pattern ``[^\\x20\\x09-\\x0D]+`` on code points.  A word's hash goes through its bytes
eight at a time, all words in step, with a non-linear mix behind each; a window's hash is
a tree of such mixes of its words' hashes.  Both depend on the bytes alone, so any worker
gives the same value; no regular sequence of letters or words cancels out in them.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps
from hashlib import blake2b

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE_BYTES, LONG = 256 << 10, 512


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finisher (xor-shift and multiply), different for each salt."""
    x = x + U((0x632BE59BD9B4E019 * (salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def combine(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """One hash of two, in this order."""
    return mix(mix(a, salt) * U(0x9E3779B97F4A7C15) + (b ^ (b >> U(29))) * U(0xD6E8FEB86659FD93), salt)


_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


@dataclass
class Words:
    """Words of consecutive texts: byte bounds and two independent hashes of each, and where each text's words begin."""

    data: np.ndarray
    text_at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    other: np.ndarray
    first: np.ndarray  # texts + 1

    def count(self) -> np.ndarray:
        return np.diff(self.first)


def window_starts(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.maximum(np.diff(first) - k + 1, 0)
    text = np.repeat(np.arange(len(n)), n)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return first[:-1][text] + inside, text


def window_hash(hashes: np.ndarray, at: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of the ``k`` words from each place in ``at``: windows of 1, 2, 4, ... words are
    combined from halves, and a window from those that make up its length."""
    if not len(at):
        return np.zeros(0, U)
    level, size, done, out = hashes, 1, 0, None
    while True:
        if k & size:
            part = level[at + done]
            out = mix(part, salt + 100 + k) if out is None else combine(out, part, salt + 200)
            done += size
        if done == k:
            return out
        level = combine(level[:-size], level[size:], salt + 300)
        size *= 2


def word_bounds(data: np.ndarray, text_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which bytes belong to words, and where each word starts and ends."""
    word = ~SEPARATOR[data]
    before, after = np.empty_like(word), np.empty_like(word)
    if len(word):
        before[0], before[1:], after[-1], after[:-1] = False, word[:-1], False, word[1:]
        inner = text_at[1:-1]
        before[inner[inner < len(word)]] = False
        after[inner[inner > 0] - 1] = False
    return word, np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1


def hash_runs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each run of bytes; very long runs are digested, the others go in step."""
    size = end - start
    one, two = mix(size.astype(U), 1), mix(size.astype(U), 2)
    eight = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))  # at every byte
    live, done = np.flatnonzero(size <= LONG), 0
    while len(live):
        x, rest = eight[start[live] + done], size[live] - done
        x &= (U(2) << (np.minimum(rest, 8) * 8 - 1).astype(U)) - U(1)  # 2 << 63 is 0, less 1 all ones
        one[live], two[live] = combine(one[live], x, 3), combine(two[live], x, 4)
        done += 8
        live = live[rest > 8]
    for i in np.flatnonzero(size > LONG):
        one[i], two[i] = np.frombuffer(blake2b(data[start[i] : end[i]].tobytes(), digest_size=16).digest(), U)
    return one, two


def split_words(data: np.ndarray, text_at: np.ndarray, lower: bool = False) -> Words:
    """``text_at`` holds the byte bounds of the texts in ``data``, one more than texts."""
    _, start, end = word_bounds(data, text_at)
    return Words(data, text_at, start, end, *hash_runs(_lower[data] if lower else data, start, end), np.searchsorted(start, text_at))


def digests(rows: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit digest, as two longs, of the bytes of each run of rows."""
    raw, width = memoryview(rows.reshape(-1).view(np.uint8)), rows.dtype.itemsize * (rows.shape[1] if rows.ndim > 1 else 1)
    at = (bounds * width).tolist()
    both = np.zeros((len(at) - 1, 2), np.int64)
    for i, (s, e) in enumerate(zip(at[:-1], at[1:])):
        both[i] = np.frombuffer(blake2b(raw[s:e], digest_size=16).digest(), np.int64)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


class Memo(dict):
    """Results of ``make`` for short strings, in two generations of ``most`` each: the older one goes when the younger is full."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key: str) -> bytes:
        got = self.older.get(key)
        if got is None:
            got = self.make(key)
        if len(key) < 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = got
        return got


def tidy(work: Callable) -> Callable:
    """A function over batches that hands freed memory back when its task ends, as workers live on."""

    @wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return run


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the bounds of each value; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]


def text_slices(data: np.ndarray, at: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``limit`` bytes: first and last text, bytes, bounds."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j
