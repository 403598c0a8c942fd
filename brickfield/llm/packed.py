"""Fingerprints on their way through a shuffle: one row for each bucket and pack of documents.

A fingerprint's top bits name its bucket, that is its range in the global order of
fingerprints. A pack holds some megabytes of text; each of its rows has the pack's
fingerprints of one bucket, grouped by document, as raw little-endian arrays. That takes a
few bytes for each fingerprint instead of a Spark row, and no fingerprint, however frequent,
makes a row or a group of its own. Rows of a bucket meet in one partition, where they are
streamed: the state kept is one entry for each distinct fingerprint of the bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import field
from .runtime import partitions
from .vocab import let_go
from .wordscan import U64, batches_of, give_back, mix, segments, thrifty

PACK_BYTES = 3 << 20
#: Fingerprints taken together while a bucket is streamed.
CHUNK = 300_000

ROW = T.StructType(
    [
        field("bucket", T.IntegerType()),
        field("kind", T.IntegerType()),
        field("ids", T.BinaryType()),
        field("sizes", T.BinaryType()),
        field("counts", T.BinaryType()),
        field("keys", T.BinaryType()),
    ]
)
ROW_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("ids", pa.binary()), ("sizes", pa.binary()), ("counts", pa.binary()), ("keys", pa.binary())])

#: (document ids, document sizes, index of the document of each key, keys, kind)
Pack = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> U64(48)) * U64(buckets)) >> U64(16)


def encode(keys: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each key."""
    if width == 8:
        return keys.tobytes()
    return np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def decode(raw: bytes, width: int) -> np.ndarray:
    if width == 8:
        return np.frombuffer(raw, U64)
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.reshape(-1).view(U64)


def code(key: np.ndarray, buckets: int, width: int) -> np.ndarray:
    """A key as it is known after the shuffle: bucket and low bytes in one number (the key itself at 8 bytes)."""
    if width == 8:
        return key
    bits = U64(8 * width)
    return (bucket_of(key, buckets) << bits) | (key & ((U64(1) << bits) - U64(1)))


def pack_rows(pack: Pack, buckets: int, width: int) -> Iterator[dict]:
    ids, sizes, doc, keys, kind = pack
    bucket = bucket_of(keys, buckets).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
    order = np.argsort(bucket, kind="stable")
    bucket, doc, keys = bucket[order], doc[order], keys[order]
    for a, b in zip(*segments(bucket), strict=True):
        lo, hi = segments(doc[a:b])
        here = doc[a:b][lo]
        yield {"bucket": int(bucket[a]), "kind": kind, "ids": ids[here].tobytes(), "sizes": sizes[here].tobytes(), "counts": (hi - lo).astype(np.uint32).tobytes(), "keys": encode(keys[a:b], width)}


def scatter(df: DataFrame, packs: Callable[[pa.Table], Iterator[Pack]], width: int) -> DataFrame:
    """df's fingerprints, partitioned by bucket, rows of a lower kind first."""
    buckets = partitions(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        thrifty()
        let_go()
        for t in batches_of(batches, PACK_BYTES):
            for pack in packs(t):
                rows = list(pack_rows(pack, buckets, width))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, ROW_ARROW)
            give_back()

    return df.mapInArrow(run, ROW).repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "kind")


def stream(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket, kind, document id, size, key) arrays of chunks of a partition's rows; a chunk has one bucket and kind."""
    thrifty()
    let_go()
    held, total, now = [], 0, None

    def joined():
        return (*now, *(np.concatenate(x) for x in zip(*held, strict=True)))

    for batch in batches:
        for bucket, kind, ids, sizes, counts, keys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (now != (bucket, kind) or total >= CHUNK):
                yield joined()
                held, total = [], 0
            now = (bucket, kind)
            n = np.frombuffer(counts, np.uint32)
            keys = decode(keys, width)
            held.append((np.repeat(np.frombuffer(ids, np.int64), n), np.repeat(np.frombuffer(sizes, np.uint32), n), keys))
            total += len(keys)
    if held:
        yield joined()
    give_back()


#: What reduced buckets say, packed by the partition that the documents are sent to.
FOUND = T.StructType([field("target", T.IntegerType()), field("ids", T.BinaryType()), field("sizes", T.BinaryType()), field("counts", T.BinaryType()), field("codes", T.BinaryType())])
FOUND_ARROW = pa.schema([("target", pa.int32()), ("ids", pa.binary()), ("sizes", pa.binary()), ("counts", pa.binary()), ("codes", pa.binary())])
#: One row for each document that has codes: as many as its own text has at most.
GATHERED = T.StructType([field("id", T.LongType()), field("size", T.LongType()), field("codes", T.BinaryType())])
_GATHERED_ARROW = pa.schema([("id", pa.int64()), ("size", pa.int64()), ("codes", pa.binary())])


def found_rows(ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray, targets: int) -> pa.RecordBatch:
    """(document, code) pairs, one row for each target."""
    target = (mix(ids.view(U64)) % U64(targets)).astype(np.int64)
    order = np.lexsort((ids, target))
    target, ids, sizes, codes = target[order], ids[order], sizes[order], codes[order]
    out = []
    for a, b in zip(*segments(target), strict=True):
        lo, hi = segments(ids[a:b])
        out.append((int(target[a]), ids[a:b][lo].tobytes(), sizes[a:b][lo].astype(np.uint32).tobytes(), (hi - lo).astype(np.uint32).tobytes(), codes[a:b].tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), FOUND_ARROW, strict=True)], schema=FOUND_ARROW)


def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    thrifty()
    let_go()
    held = []
    for batch in batches:
        for _, ids, sizes, counts, codes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n = np.frombuffer(counts, np.uint32)
            held.append((np.repeat(np.frombuffer(ids, np.int64), n), np.repeat(np.frombuffer(sizes, np.uint32), n), np.frombuffer(codes, U64)))
    if not held:
        return
    ids, sizes, codes = (np.concatenate(x) for x in zip(*held, strict=True))
    held.clear()
    order = np.argsort(ids, kind="stable")
    ids, sizes, codes = ids[order], sizes[order], codes[order]
    lo, hi = segments(ids)
    for k in range(0, len(lo), 5_000):
        a, b = lo[k : k + 5_000], hi[k : k + 5_000]
        yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(sizes[a].astype(np.int64)), pa.array([codes[x:y].tobytes() for x, y in zip(a, b, strict=True)], pa.binary())], schema=_GATHERED_ARROW)
    give_back()


def gathered(found: DataFrame, then=None, schema: T.StructType = GATHERED) -> DataFrame:
    """All codes of each document, or what `then` makes of them in the same worker. A partition holds the codes of its own documents, whose texts would be longer."""
    n = partitions(found.sparkSession)
    return found.repartitionById(n, F.col("target")).mapInArrow(lambda it: then(gather(it)) if then else gather(it), schema)


class _Levels:
    """Sorted keys with values, in levels of which each is at least twice as long as the next one, so that adding keys chunk by
    chunk copies each of them a logarithmic number of times."""

    def __init__(self) -> None:
        self.levels: list[list[np.ndarray]] = []

    def find(self, keys: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(level, which of the keys it holds, where) of every level that holds some; keys are distinct."""
        out = []
        for n, level in enumerate(self.levels):
            at = np.searchsorted(level[0], keys)
            inside = np.flatnonzero(at < len(level[0]))
            held = inside[level[0][at[inside]] == keys[inside]]
            if len(held):
                out.append((n, held, at[held]))
        return out

    def add(self, *columns: np.ndarray) -> None:
        """New keys, sorted, and their values."""
        if not len(columns[0]):
            return
        self.levels.append(list(columns))
        while len(self.levels) > 1 and 2 * len(self.levels[-1][0]) > len(self.levels[-2][0]):
            joined = [np.concatenate(x) for x in zip(self.levels[-2], self.levels[-1], strict=True)]
            order = np.argsort(joined[0], kind="stable")
            self.levels[-2:] = [[x[order] for x in joined]]


class Seen(_Levels):
    """Distinct keys of a bucket with the first document seen and whether another was; fed chunk by chunk."""

    def feed(self, ids: np.ndarray, sizes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, sizes, keys) now known to be shared by different documents; a document may come twice."""
        order = np.argsort(keys, kind="stable")
        ids, sizes, keys = ids[order], sizes[order], keys[order]
        lo, hi = segments(keys)
        new, first, size = keys[lo], ids[lo].copy(), sizes[lo].copy()
        known, was = np.zeros(len(new), bool), np.zeros(len(new), bool)
        held = self.find(new)
        for n, which, at in held:
            known[which] = True
            _, first_of, size_of, many_of = self.levels[n]
            first[which], size[which], was[which] = first_of[at], size_of[at], many_of[at]
        other = ids != np.repeat(first, hi - lo)
        many = was | (np.add.reduceat(other, lo) > 0 if len(lo) else was)
        late = known & many & ~was
        for n, which, at in held:
            self.levels[n][3][at] = many[which]
        tell = np.repeat(many, hi - lo)
        out = tuple(np.concatenate(x) for x in ((ids[tell], first[late]), (sizes[tell], size[late]), (keys[tell], new[late])))
        fresh = ~known
        self.add(new[fresh], first[fresh], size[fresh], many[fresh])
        return out


class Smallest(_Levels):
    """Distinct keys of a bucket with their smallest document; fed chunk by chunk."""

    def feed(self, ids: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, keys) of documents now known not to be the smallest that holds the key."""
        order = np.lexsort((ids, keys))
        ids, keys = ids[order], keys[order]
        lo, hi = segments(keys)
        new, low = keys[lo], ids[lo].copy()
        fresh, late = np.ones(len(new), bool), []
        for n, which, at in self.find(new):
            fresh[which] = False
            lows = self.levels[n][1]
            before = lows[at]
            beaten = low[which] < before
            late.append((before[beaten], new[which][beaten]))
            low[which] = np.minimum(low[which], before)
            lows[at] = low[which]
        above = ids > np.repeat(low, hi - lo)
        self.add(new[fresh], low[fresh])
        return np.concatenate([ids[above], *(x for x, _ in late)]), np.concatenate([keys[above], *(x for _, x in late)])
