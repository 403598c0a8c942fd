"""Vectorised word scanning over Arrow text columns.

Texts are handled in slices of about half a megabyte: the bytes of many documents lie in
one numpy array, words are runs of bytes of a class, and every word gets a 64-bit
fingerprint from prefix sums of a polynomial (arithmetic modulo 2**64, then a mixing step).
All word classes used here treat each byte of a multi-byte UTF-8 character alike, so byte
scanning and character scanning find the same words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 19
_BASE = 0x9F2B_60F3_5D1C_A4E7
_GRAM = 0xC6A4_A793_5BD1_E995

#: Everything but space and the control characters 09-0D: the class [^\x20\x09-\x0D].
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: 0-9, a-z and all beyond ASCII: the class [^\x00-\x2F\x3A-\x60\x7B-\x7F].
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand; give_back() forgets what only a long text needed."""

    KEPT = 1 << 20

    def __init__(self, base: int) -> None:
        self.base, self.inv = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, b in (("up", self.base), ("down", self.inv)):
                p = np.full(size, b, U64)
                p[0] = 1
                setattr(self, name, np.cumprod(p))
        return self.up[:n], self.down[:n]

    def trim(self) -> None:
        if len(self.up) > self.KEPT:
            self.up, self.down = self.up[: self.KEPT].copy(), self.down[: self.KEPT].copy()


_bytes, _grams = _Powers(_BASE), _Powers(_GRAM)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _prefix(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x) + 1, U64)
    np.cumsum(x, out=out[1:])
    return out


@dataclass
class Words:
    data: np.ndarray  #: bytes of the slice (lower-cased if asked for)
    offs: np.ndarray  #: byte offset of each document, and the end
    start: np.ndarray  #: byte where each word starts
    end: np.ndarray
    first: np.ndarray  #: index of each document's first word, and the number of words
    hash: np.ndarray  #: fingerprint of each word

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offs) - 1), self.counts)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(fingerprint, index of the first word, document) of every run of k words."""
        n = len(self.hash)
        if n < k:
            z = np.zeros(0, np.int64)
            return np.zeros(0, U64), z, z
        doc = self.doc_of_word()
        at = np.flatnonzero(np.arange(n) + k <= self.first[1:][doc])
        up, down = _grams.get(n)
        p = _prefix(self.hash * up)
        return mix((p[at + k] - p[at]) * down[at] + U64(k)), at, doc[at]

    def whole(self, docs: np.ndarray) -> np.ndarray:
        """Fingerprint of the whole word sequence of the given documents."""
        up, down = _grams.get(max(1, len(self.hash)))
        p = _prefix(self.hash * up[: len(self.hash)])
        a, b = self.first[docs], self.first[docs + 1]
        down = np.append(down[: len(self.hash)], U64(0))
        return mix((p[b] - p[a]) * down[a] + (b - a).astype(U64))


def scan(data: np.ndarray, offs: np.ndarray, word: np.ndarray, lower: bool = False, cuts: np.ndarray | None = None) -> Words:
    """Runs of bytes of a class, within documents; cuts: marks of bytes before which a run ends too."""
    n = len(data)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    is_word = word[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    if cuts is not None:
        edge[:n] |= cuts
    before = np.zeros(n, bool)
    before[1:] = is_word[:-1]
    start = np.flatnonzero(is_word & (~before | edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = is_word[1:]
    end = np.flatnonzero(is_word & (~after | edge[1:])) + 1
    up, down = _bytes.get(max(1, n))
    p = _prefix((data.astype(U64) + U64(1)) * up[:n])
    h = mix((p[end] - p[start]) * down[start] + (end - start).astype(U64)) if len(start) else np.zeros(0, U64)
    return Words(data, offs, start, end, np.searchsorted(start, offs), h)


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, byte offsets) of runs of rows; nulls are empty texts. A longer text is a slice of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, j, data[offs[i] : offs[j]], (offs[i : j + 1] - offs[i]).astype(np.int64)
        i = j


@lru_cache(maxsize=1)
def _libc():
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(_ARENA_MAX, 1)
        return libc
    except (OSError, AttributeError):
        return None  # not glibc


_ARENA_MAX = -8


def thrifty() -> None:
    """One heap for all threads of a worker; each thread's own would keep what it frees."""
    _libc()


def give_back() -> None:
    """Returns freed memory to the system: workers live on after a task, and an executor's memory is theirs too."""
    _bytes.trim()
    _grams.trim()
    pa.default_memory_pool().release_unused()
    if libc := _libc():
        libc.malloc_trim(0)


def segments(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    if not len(key):
        z = np.zeros(0, np.int64)
        return z, z
    cut = np.flatnonzero(key[1:] != key[:-1]) + 1
    return np.concatenate([[0], cut]), np.append(cut, len(key))


def binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def batches_of(iterator, size: int) -> Iterator[pa.Table]:
    """Joins small Arrow batches until they hold about so many bytes."""
    held, total = [], 0
    for batch in iterator:
        if batch.num_rows:
            held.append(batch)
            total += batch.nbytes
        if total >= size:
            yield pa.Table.from_batches(held)
            held, total = [], 0
    if held:
        yield pa.Table.from_batches(held)
