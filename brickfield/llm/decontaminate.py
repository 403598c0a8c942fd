"""Benchmark decontamination by Wu-Manber multi-pattern search over word sequences.

A benchmark item gives test strings: its windows of 13 consecutive words, or the whole item
if it is shorter. Strings of one length share a search table: block shift tables (blocks of
two words) tell how far the window can move without missing a string, so most positions are
never looked at; where the shift is zero, a bucket keyed by the suffix block's hash names the
strings that may end there, and these are compared word by word, bytes at last. All texts of a slice
are searched side by side, in lanes of equal length.

The benchmark is streamed to the driver in blocks of at most BLOCK_BYTES of text, whose bytes are broadcast one block at a time; a worker
builds a block's tables once, from flat arrays: about 60 bytes for each benchmark word. With more blocks than one, the marks so
far are staged in between, and items and words add up to what one search would give.

Defined results: a null or empty text has no words, no hit and is not contaminated; a null or
empty item gives no string; equal items each count under their own id; a null item_id counts
as the empty string; repeated documents are judged one by one.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import field, unused, with_columns
from .runtime import staged
from .vocab import hold
from .wordscan import ALNUM, U64, Words, mix, scan, segments, text_slices

WINDOW = 13
LANE = 256
#: Least and most bits of a shift table; between them it has eight slots for each string.
TABLE_BITS = (16, 24)
#: Benchmark text searched for at once; more is searched for in blocks of this size.
BLOCK_BYTES = 4 << 20

RESULT = [
    field("n_words", T.LongType()),
    field("n_hit", T.LongType()),
    field("n_items", T.LongType()),
    field("items_sha256", T.StringType()),
    field("contaminated", T.BooleanType()),
]


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * U64(3) + mix(b))


class _Strings:
    """Search table of the test strings with `length` words: where each starts among the benchmark's words."""

    def __init__(self, length: int, bench: Words, first: np.ndarray, item: np.ndarray) -> None:
        self.length, self.block, self.bench = length, min(2, length), bench
        self._merge(first, item)
        last = self._block(self.first + length - 1)
        order = np.argsort(last, kind="stable")
        self.first, self.suffix, self.begin, self.end = self.first[order], last[order], self.begin[order], self.end[order]
        self.bits = U64(min(TABLE_BITS[1], max(TABLE_BITS[0], int(8 * len(order)).bit_length())))
        self.shift = np.full(1 << int(self.bits), length - self.block + 1, np.int8)
        for j in range(self.block, length + 1):
            np.minimum.at(self.shift, self._slot(self._block(self.first + j - 1)), np.int8(length - j))

    def _merge(self, first: np.ndarray, item: np.ndarray) -> None:
        """Equal strings become one with all of their items: self.item[begin:end]. Those of one fingerprint are compared as bytes."""
        name = np.zeros(len(first), U64)
        for k in range(self.length):
            name = mix(name * U64(5) + self.bench.hash[first + k])
        order = np.argsort(name, kind="stable")
        first, name, self.item = first[order], name[order], item[order]
        lo, hi = segments(name)
        same = np.repeat(lo, hi - lo)
        apart = [n for n in np.flatnonzero(same != np.arange(len(same))).tolist() if not self._equal(int(first[n]), self.bench, int(first[same[n]]))]
        lo = np.union1d(lo, np.concatenate([apart, np.asarray(apart, np.int64) + 1])).astype(np.int64) if apart else lo
        lo = lo[lo < len(first)]
        self.first, self.begin, self.end = first[lo], lo, np.append(lo[1:], len(first)).astype(np.int64)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> (U64(64) - self.bits)).astype(np.int64)

    def _block(self, at: np.ndarray, words: Words | None = None) -> np.ndarray:
        """Hash of the block of words that ends at each position."""
        h = (words or self.bench).hash
        return h[at] if self.block == 1 else _pair(h[at - 1], h[at])

    def _equal(self, string: int, w: Words, at: int) -> bool:
        """Whether the words of w from `at` on are those of the benchmark from `string` on, byte by byte."""
        b, n = self.bench, self.length
        return all(w.data[i:j].tobytes() == b.data[x:y].tobytes() for i, j, x, y in zip(w.start[at : at + n], w.end[at : at + n], b.start[string : string + n], b.end[string : string + n], strict=True))

    def items(self, string: int) -> np.ndarray:
        return self.item[self.begin[string] : self.end[string]]

    def find(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(index of the last word, index of the string) of every occurrence."""
        begin, end = w.first[:-1] + self.length - 1, w.first[1:]
        lanes = np.maximum(0, -(-(end - begin) // LANE))
        doc = np.repeat(np.arange(len(begin)), lanes)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = begin[doc] + nth * LANE
        stop = np.minimum(at + LANE, end[doc])
        found_at, found = [], []
        while len(at):
            h = self._block(at, w)
            move = self.shift[self._slot(h)]
            if len(zero := np.flatnonzero(move == 0)):
                p, s = self._confirm(w, at[zero], h[zero])
                found_at.append(p)
                found.append(s)
            at = at + np.maximum(move, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        if not found:
            z = np.zeros(0, np.int64)
            return z, z
        return np.concatenate(found_at), np.concatenate(found)

    def _confirm(self, w: Words, at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = np.searchsorted(self.suffix, h), np.searchsorted(self.suffix, h, side="right")
        n = hi - lo
        p = np.repeat(at, n)
        s = np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        for back in range(self.length):
            same = w.hash[p - back] == self.bench.hash[self.first[s] + self.length - 1 - back]
            p, s = p[same], s[same]
        same = np.array([self._equal(int(self.first[k]), w, q - self.length + 1) for q, k in zip(p.tolist(), s.tolist(), strict=True)], bool)
        return p[same], s[same]


class Block:
    """A block of the benchmark: item ids, and their texts end to end."""

    def __init__(self, items: list[tuple[str, str]]) -> None:
        texts = [(text or "").encode() for _, text in items]
        self.names = ["" if item is None else str(item) for item, _ in items]
        self.raw, self.offs = b"".join(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)

    def tables(self) -> list[_Strings]:
        """Search tables, one for each length of string."""
        w = scan(np.frombuffer(self.raw, np.uint8), self.offs, ALNUM, lower=True)
        size = np.minimum(w.counts, WINDOW)
        out = []
        for length in np.unique(size[size > 0]).tolist():
            items = np.flatnonzero(size == length)
            n = w.counts[items] - length + 1
            nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out.append(_Strings(length, w, w.first[items].repeat(n) + nth, items.repeat(n)))
        return out


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[Block]:
    """The benchmark, in blocks of at most BLOCK_BYTES of text (a longer item is a block of its own); at least one."""
    items = benchmark.select(F.col(item_col).cast("string"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    held, size = [], 0
    for item, text in items.toLocalIterator():
        if held and size + len(text) > BLOCK_BYTES:
            yield Block(held)
            held, size = [], 0
        held.append((item, text))
        size += len(text)
    yield Block(held)


def _marks(tables: list[_Strings], names: list[str], column) -> tuple[list[bytes], list[set[str]], list[int]]:
    """(covered words as packed bits, none if no word is; items that occur; words) of each text."""
    cover, found, count = [], [], []
    for i, j, data, offs in text_slices(column):
        w = scan(data, offs, ALNUM, lower=True)
        step = np.zeros(len(w.hash) + 1, np.int64)
        got: dict[int, set[int]] = defaultdict(set)
        for t in tables:
            at, s = t.find(w)
            np.add.at(step, at - t.length + 1, 1)
            np.add.at(step, at + 1, -1)
            doc = np.searchsorted(w.first, at, side="right") - 1
            for d, k in {*zip(doc.tolist(), s.tolist(), strict=True)}:
                got[d].update(t.items(k).tolist())
        hit = np.cumsum(step[:-1]) > 0
        any_hit = np.concatenate([[0], np.cumsum(hit)])
        for d in range(j - i):
            a, b = w.first[d], w.first[d + 1]
            cover.append(np.packbits(hit[a:b]).tobytes() if any_hit[b] > any_hit[a] else b"")
            found.append({names[k] for k in got[d]} if d in got else set())
            count.append(int(b - a))
    return cover, found, count


def _search(df: DataFrame, block: Block, text_col: str, cover_col: str, items_col: str, earlier: bool, last: bool):
    """(df with the covered words and the items of one block added to those of earlier blocks, or after the last one with the results; the broadcast block)"""
    spread = df.sparkSession.sparkContext.broadcast(block)

    def make():
        b = spread.value
        tables = hold(("wu-manber", hashlib.sha256(b.raw + b.offs.tobytes()).digest()), b.tables)

        def work(batch: pa.RecordBatch) -> list:
            get = lambda name: batch.column(batch.schema.get_field_index(name))
            cover, found, count = _marks(tables, b.names, get(text_col))
            if earlier:
                for k, (old, had) in enumerate(zip(get(cover_col).to_pylist(), get(items_col).to_pylist(), strict=True)):
                    if old:
                        cover[k] = (np.frombuffer(old, np.uint8) | np.frombuffer(cover[k] or bytes(len(old)), np.uint8)).tobytes()
                    found[k].update(had)
            names = [sorted(x) for x in found]
            if not last:
                return [cover, names]
            hits = [int(np.unpackbits(np.frombuffer(x, np.uint8)).sum()) if x else 0 for x in cover]
            shas = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]
            return [count, hits, [len(x) for x in names], shas, [h > 0 and 20 * h >= n for h, n in zip(hits, count, strict=True)]]

        return work

    marks = [field(cover_col, T.BinaryType()), field(items_col, T.ArrayType(T.StringType()))]
    return with_columns(df, RESULT if last else marks, make), spread


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs with RESULT's columns: words, words inside occurrences of test strings, items that occur, verdict."""
    cover, items = unused(docs, "_cover", "_items")
    blocks = blocks_of(benchmark, item_col, item_text_col)
    found, block, earlier = docs, next(blocks), False
    while (after := next(blocks, None)) is not None:
        marked, spread = _search(found, block, text_col, cover, items, earlier, False)
        found = staged(marked, "decontaminate")
        spread.unpersist()
        block, earlier = after, True
    return _search(found, block, text_col, cover, items, earlier, True)[0].drop(cover, items)
