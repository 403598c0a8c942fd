"""Encoding text chunk by chunk, each different chunk once.

Where a tokenizer never joins characters across a boundary, a text's ids are the ids of its
chunks in turn. Chunks are told apart by their 64-bit fingerprints, which a worker remembers with their ids in
flat arrays; only chunks not met before are taken out as bytes and encoded, a few thousand as one batch.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .wordscan import U64

#: Chunks remembered unless an encoder asks for another number, and ids of them; beyond either all are forgotten and met anew.
REMEMBERED, REMEMBERED_IDS = 200_000, 8 << 20
#: Chunks that go through the tokenizer together: its answers are large objects.
TOGETHER = 4096


class Encoder:
    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], dtype, remembered: int = REMEMBERED) -> None:
        self.encode, self.dtype, self.remembered = encode, dtype, remembered
        self._forget()

    def _forget(self) -> None:
        self.keys, self.at = np.zeros(0, U64), np.zeros(0, np.int64)
        self.start, self.size, self.pool, self.count, self.used = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, self.dtype), 0, 0

    def _learn(self, chunks: list[bytes]) -> None:
        ids = self.encode(chunks)
        sizes = np.array([len(x) for x in ids], np.int64)
        n, flat = self.count, np.array([t for x in ids for t in x], self.dtype)
        while len(self.size) < n + len(chunks):
            self.start, self.size = np.concatenate([self.start, np.zeros_like(self.start)]), np.concatenate([self.size, np.zeros_like(self.size)])
        while len(self.pool) < self.used + len(flat):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        self.start[n : n + len(chunks)] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + len(chunks)] = sizes
        self.used, self.count = self.used + len(flat), n + len(chunks)

    def ids(self, keys: np.ndarray, bytes_of: Callable[[int], bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in turn, number of ids of each chunk); keys: fingerprints of the chunks, bytes_of: the bytes of the nth."""
        if not len(keys):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if self.count and (self.count + len(distinct) > self.remembered or self.used > REMEMBERED_IDS):
            self._forget()
        place = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == distinct[inside]
        new = np.flatnonzero(~known)
        if len(new):
            before = self.count
            for k in range(0, len(new), TOGETHER):
                self._learn([bytes_of(x) for x in first[new[k : k + TOGETHER]].tolist()])
            self.keys, self.at = np.insert(self.keys, place[new], distinct[new]), np.insert(self.at, place[new], before + np.arange(len(new)))
            place = np.searchsorted(self.keys, distinct)
        at = self.at[place][inverse]
        size = self.size[at]
        total = np.cumsum(size)
        where = np.arange(total[-1]) + np.repeat(self.start[at] - (total - size), size)
        return self.pool[where], size
