"""Vectorised word splitting and hashing of Arrow text columns.

Words are the maximal runs of bytes outside ``\\x20 \\x09-\\x0D``.  In UTF-8 these
bytes never occur inside a longer character, so splitting bytes and splitting code
points give the same words.  A word's hash is a polynomial over a random byte table
modulo 2**64, read off one running sum and then mixed; the hash of n consecutive words
is the same construction over word hashes.  Nothing here looks at one word at a time.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa

PIECE = 1 << 17  # bytes hashed at a time: the 8-byte temporaries stay in cache
SLICE = 1 << 20  # bytes of text handled at a time by the operators

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_U = np.uint64


@lru_cache(maxsize=1)
def one_blas_thread() -> None:
    """Keeps matrix products in a worker to its task's core: more threads would wait for the cores of other tasks."""
    try:
        found = set(re.findall(r"/\S*openblas\S*", Path("/proc/self/maps").read_text()))
    except OSError:
        return
    for path in found:
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (multiply, shift, xor)."""
    x = x ^ (x >> _U(32))
    x = x * _U(0x9E6C63D0876A9A47)
    x ^= x >> _U(29)
    x = x * _U(0xD1B54A32D192ED03)
    x ^= x >> _U(32)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xA24BAED4963EE407))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    @staticmethod
    def _grow(have: np.ndarray, base: int, n: int) -> np.ndarray:
        while len(have) < n:
            have = np.concatenate([have, have * _U(pow(base, len(have), 1 << 64))])
        return have

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up = self._grow(self.up, self.base, n)
            self.down = self._grow(self.down, self.inverse, n)
        return self.up[:n], self.down[:n]


_CHARS = _Powers(0x9FB21C651E98DF25)
_WORDS = _Powers(0xD6E8FEB86659FD93)


@dataclass
class Words:
    """Words of consecutive texts: ``first[d]:first[d + 1]`` are those of text d."""

    data: np.ndarray  # uint8, all texts end to end
    bounds: np.ndarray  # int64, byte offsets of the texts
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without copying; null counts as empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    if data is None or n == 0 or bounds[-1] == bounds[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
    return raw, bounds - bounds[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Consecutive row ranges of a batch with about ``limit`` bytes of text each; a longer text stays whole."""
    _, bounds = text_buffer(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        to = int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1
        to = min(n, max(at + 1, to))
        yield batch.slice(at, to - at)
        at = to


def split(column: pa.Array, separators: np.ndarray = _SPACE) -> Words:
    """The words between the bytes that ``separators`` marks."""
    return split_bytes(*text_buffer(column), separators)


def split_bytes(data: np.ndarray, bounds: np.ndarray, separators: np.ndarray = _SPACE) -> Words:
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, bounds, none, none, np.zeros(len(bounds), np.int64))
    space = separators[data]
    begin = ~space
    begin[1:] &= space[:-1]
    end = ~space
    end[:-1] &= space[1:]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    begin[inner] |= ~space[inner]
    end[inner - 1] |= ~space[inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return Words(data, bounds, starts, ends, np.searchsorted(starts, bounds))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """uint64 hash of each byte span (ascending, not overlapping); an empty span gets 0's mix."""
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + PIECE, "right")))
        to = min(to, len(starts))
        n = int(ends[to - 1] - base)
        up, down = _CHARS.get(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data[base : base + n]] * up[:n], out=sums[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        at = to
    return mix(out)


def word_hashes(words: Words) -> np.ndarray:
    return span_hashes(words.data, words.starts, words.ends)


def run_hashes(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``n`` consecutive entries (runs may cross texts; see ``inside``)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    if seed:
        hashes = mix(hashes ^ _U(seed))
    out = np.empty(len(hashes) - n + 1, np.uint64)
    step = max(PIECE, 4 * n)
    for at in range(0, len(out), step):
        part = hashes[at : at + step + n - 1]
        up, down = _WORDS.get(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        k = len(part) - n + 1
        out[at : at + k] = (sums[n:] - sums[:k]) * down[:k]
    return mix(out)


def inside(words: Words, n: int) -> np.ndarray:
    """For each run of ``n`` consecutive words, whether it stays within one text."""
    total = int(words.first[-1])
    if total < n:
        return np.zeros(0, bool)
    good = np.zeros(total + 1, np.int32)
    lo, hi = words.first[:-1], words.first[1:]
    has = hi - lo >= n
    np.add.at(good, lo[has], 1)
    np.add.at(good, hi[has] - n + 1, -1)
    return np.cumsum(good[: total - n + 1]) > 0


def covered(flags: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of ``total`` positions lie in a run of length ``n`` that starts at a flagged position."""
    diff = np.zeros(total + 1, np.int32)
    at = np.flatnonzero(flags)
    diff[at] += 1
    np.subtract.at(diff, np.minimum(at + n, total), 1)
    return np.cumsum(diff[:total]) > 0
