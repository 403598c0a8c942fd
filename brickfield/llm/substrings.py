"""Substring deduplication with fixed-block anchors.

Every document is cut into reference blocks of BLOCK consecutive words (25), end to end; their fingerprints
are the index. Every rolling window of BLOCK words of every document probes it. A passage of
WINDOW words (50) holds a whole reference block of any document it stands in, so two
documents that share such a passage share an anchor: a block of one that is a rolling window
of both. Hits are extended on both sides: around each anchor, all windows of WINDOW words are
fingerprinted, and a window that also stands in a document with a smaller id is a repeat.
Repeats that touch or overlap are the maximal exact repeats; their words go.

Blocks, probes and windows move as packed arrays, one bucket of the fingerprints' order in
one partition, where they are streamed. Nothing is paired: a passage in half of all documents
costs each of them one entry. Fingerprints have 64 bits where they decide.

Defined results: a null or empty text has no words; windows are judged on the input;
documents with equal ids are no smaller than each other; a document with a null id neither
loses words nor takes any from others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import field, unused, with_columns
from .packed import FOUND, Pack, Seen, Smallest, code, found_rows, gathered, scatter, stream
from .runtime import partitions
from .wordscan import NOT_SPACE, U64, Words, mix, scan, text_slices

WINDOW, BLOCK = 50, 25
_PROBE_WIDTH = 4

RESULT = [
    field("n_words", T.LongType()),
    field("n_removed", T.LongType()),
    field("kept_sha256", T.StringType()),
    field("kept_text", T.StringType()),
]


def _once(doc: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's keys without repetition: a word or passage repeated within a document travels once."""
    order = np.lexsort((keys, doc))
    doc, keys = doc[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], keys[new]


def _anchor_packs(t: pa.Table) -> Iterator[Pack]:
    """The blocks (kind 0) and rolling windows (kind 1) of documents long enough to hold a repeat."""
    ids = t.column("id").to_numpy()
    docs, keys, blocks = [], [], []
    for i, _, data, offs in text_slices(t.column("text")):
        w = scan(data, offs, NOT_SPACE)
        key, at, doc = w.grams(BLOCK)
        long = w.counts[doc] >= WINDOW
        key, at, doc = key[long], at[long], doc[long]
        blocks.append(key[(at - w.first[doc]) % BLOCK == 0])
        doc, key = _once(doc, key)
        docs.append(doc + i)
        keys.append(key)
    if not keys:
        return
    none = np.zeros(len(ids), np.uint32)
    block = np.unique(np.concatenate(blocks))
    yield ids, none, np.zeros(len(block), np.int64), block, 0
    yield ids, none, np.concatenate(docs), np.concatenate(keys), 1


def _shared_anchors(batches: Iterator[pa.RecordBatch], targets: int) -> Iterator[pa.RecordBatch]:
    """The anchors that each document shares with another one."""
    bucket, index, seen = None, np.zeros(0, U64), Seen()
    for now, kind, ids, sizes, keys in stream(batches, _PROBE_WIDTH):
        if now != bucket:
            bucket, index, seen = now, np.zeros(0, U64), Seen()
        if kind == 0:
            index = np.union1d(index, keys)
            continue
        at = np.minimum(np.searchsorted(index, keys), len(index) - 1)
        hit = index[at] == keys if len(index) else np.zeros(len(keys), bool)
        found, size, key = seen.feed(ids[hit], sizes[hit], keys[hit])
        if len(found):
            yield found_rows(found, size, key | (U64(bucket) << U64(8 * _PROBE_WIDTH)), targets)


def _of_documents(lists: pa.ChunkedArray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, code) of all codes listed in rows i to j."""
    raw = [x or b"" for x in lists.slice(i, j - i).to_pylist()]
    codes = np.frombuffer(b"".join(raw), U64)
    return np.repeat(np.arange(j - i), [len(x) // 8 for x in raw]), codes


def _listed(doc: np.ndarray, codes: np.ndarray, in_doc: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Which (document, code) pairs are among the listed ones."""
    if not len(listed):
        return np.zeros(len(codes), bool)
    salt = lambda d: mix(d.astype(U64) + U64(0x51))
    known = np.sort(mix(listed ^ salt(in_doc)))
    mine = mix(codes ^ salt(doc))
    at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
    return known[at] == mine


def _spread(w: Words, at: np.ndarray, before: int, after: int) -> np.ndarray:
    """Marks the words from at-before up to at+after (exclusive), within the slice."""
    step = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(step, np.maximum(at - before, 0), 1)
    np.add.at(step, np.minimum(at + after, len(w.hash)), -1)
    return np.cumsum(step[:-1]) > 0


def _window_packs(buckets: int, text_col: str, id_col: str, codes_col: str):
    def packs(t: pa.Table) -> Iterator[Pack]:
        """The windows around each document's anchors."""
        t = t.filter(pc.is_valid(t.column(codes_col)))
        ids = t.column(id_col).to_numpy()
        docs, keys = [], []
        for i, j, data, offs in text_slices(t.column(text_col)):
            w = scan(data, offs, NOT_SPACE)
            key, at, doc = w.grams(BLOCK)
            anchor = _listed(doc, code(key, buckets, _PROBE_WIDTH), *_of_documents(t.column(codes_col), i, j))
            near = _spread(w, at[anchor], WINDOW - BLOCK, 1)
            key, at, doc = w.grams(WINDOW)
            doc, key = _once(doc[near[at]], key[near[at]])
            docs.append(doc + i)
            keys.append(key)
        if keys:
            yield ids, np.zeros(len(ids), np.uint32), np.concatenate(docs), np.concatenate(keys), 0

    return packs


def _repeats(batches: Iterator[pa.RecordBatch], targets: int) -> Iterator[pa.RecordBatch]:
    """The windows of each document that a smaller one holds too."""
    bucket, low = None, Smallest()
    for now, _, ids, _, keys in stream(batches, 8):
        if now != bucket:
            bucket, low = now, Smallest()
        found, key = low.feed(ids, keys)
        if len(found):
            yield found_rows(found, np.zeros(len(found), np.uint32), key, targets)


def _kept(w: Words, kept: np.ndarray) -> list[bytes]:
    """Each document's kept words, joined by one space."""
    n = len(w.data)
    step = np.zeros(n + 1, np.int64)
    step[w.start[kept]] += 1
    step[w.end[kept]] -= 1
    take = np.cumsum(step[:-1]) > 0
    last = np.zeros(len(kept), bool)
    which = np.flatnonzero(kept)
    doc = w.doc_of_word()[which]
    last[which[np.append(doc[1:] != doc[:-1], True)] if len(which) else which] = True
    gap = w.end[kept & ~last]
    out = w.data.copy()
    out[gap], take[gap] = 0x20, True
    ends = np.concatenate([[0], np.cumsum(take)])[w.offs]
    joined = out[take].tobytes()
    return [joined[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """docs with word counts, the kept words' digest, and the kept words joined by spaces (null if not asked for)."""
    n = partitions(docs.sparkSession)
    id_, of, codes = unused(docs, "_id", "_of", "_codes")
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    hits = gathered(scatter(own, _anchor_packs, _PROBE_WIDTH).mapInArrow(lambda it: _shared_anchors(it, n), FOUND))
    # Both joins read one exchange of the documents: outer joins, as an inner one would put a filter below it,
    # and with all columns, as the second join needs them.
    placed = docs.withColumn(id_, F.col(id_col).cast("long")).repartition(n, id_)
    with_codes = lambda found: placed.join(found.select(F.col("id").alias(of), F.col("codes").alias(codes)).hint("shuffle_hash"), F.col(id_) == F.col(of), "left")
    repeats = gathered(scatter(with_codes(hits), _window_packs(n, text_col, id_, codes), 8).mapInArrow(lambda it: _repeats(it, n), FOUND))
    marked = with_codes(repeats).drop(id_, of)

    def make():
        def work(batch: pa.RecordBatch) -> list:
            get = lambda name: batch.column(batch.schema.get_field_index(name))
            out = [[] for _ in RESULT]
            for i, j, data, offs in text_slices(get(text_col)):
                w = scan(data, offs, NOT_SPACE)
                key, at, doc = w.grams(WINDOW)
                gone = _spread(w, at[_listed(doc, key, *_of_documents(get(codes), i, j))], 0, WINDOW)
                removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[w.first])
                for row in zip(w.counts.tolist(), removed.tolist(), _kept(w, ~gone), strict=True):
                    values = (*row[:2], hashlib.sha256(row[2]).hexdigest(), row[2].decode() if with_text else None)
                    for c, v in zip(out, values, strict=True):
                        c.append(v)
            return out

        return work

    return with_columns(marked, RESULT, make).drop(codes)
