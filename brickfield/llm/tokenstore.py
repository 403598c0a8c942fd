"""Content-addressed token store.

Texts become id streams, each ended by END_ID. A rolling hash over GEAR ids cuts a stream into chunks where the
hash has CUT_BITS zero bits, with least and most lengths, so equal passages give equal chunks wherever they
stand. A chunk is named by its SHA-256 and stored once; a document is a recipe, its chunks'
names and lengths. Folder layout, all Parquet:

    objects/   chunks (kind 0: name, ids) and recipes as they are made (kind 1)
    manifest/  the recipes in ascending document id order: shard, row, doc_id, start in the shard, root
    roots/     a row for each shard: ids, documents, Merkle root over its documents' roots
    whole/     one row: shards, documents, ids, Merkle root over the shards' roots

Merkle roots are of binary hash trees, built while streaming: a document's over its chunks' names, a shard's over its documents'
roots, the store's over its shards'. Reading back recomputes every name, root and count from what is stored, holds them against
what is recorded in both directions, and fails where one differs or is missing. The CRC-32 of a
document is put together from its chunks' (a CRC is linear over GF(2)), so reading back moves names and numbers,
not ids; `reconstruct` gives the ids. Each shard asks once for each chunk that it names, so a chunk of very many documents makes
as many rows as there are shards.

Ids are stored as 2-byte numbers if the chunk's fit, else 4-byte, little-endian, behind one byte
that says which. Defined results: a null or empty text is END_ID alone; documents with equal
ids follow each other in order of their roots; a null id comes first.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import Encoder
from .columns import field
from .packed import PACK_BYTES
from .runtime import fresh_dir, partitions, until_the_end
from .vocab import default_path, hold, json_tokenizer
from .wordscan import NOT_SPACE, U64, batches_of, mix, scan, text_slices

END_ID = 1
GEAR, CUT_BITS, LEAST, MOST = 16, 9, 64, 4096
_SLICE = 1 << 21
REMEMBERED = 1_600_000
_GEAR_BASE = 0xD6E8_FEB8_6659_FD93

OBJECT = T.StructType(
    [
        field("pid", T.IntegerType()),
        field("kind", T.IntegerType()),
        field("name", T.BinaryType()),
        field("ids", T.BinaryType()),
        field("doc_id", T.LongType()),
        field("n_tokens", T.LongType()),
        field("names", T.BinaryType()),
        field("sizes", T.BinaryType()),
        field("root", T.BinaryType()),
    ]
)
_OBJECT_ARROW = pa.schema([("pid", pa.int32()), ("kind", pa.int32()), ("name", pa.binary()), ("ids", pa.binary()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("names", pa.binary()), ("sizes", pa.binary()), ("root", pa.binary())])


class CorruptStore(ValueError):
    pass


class Merkle:
    """The root of a binary hash tree over leaves (hashes) that come one by one; memory grows with the logarithm of their number."""

    def __init__(self, leaves: Iterator[bytes] = ()) -> None:
        self.stack: list[tuple[int, bytes]] = []
        for leaf in leaves:
            self.push(leaf)

    def push(self, leaf: bytes) -> None:
        node = (0, leaf)
        while self.stack and self.stack[-1][0] == node[0]:
            node = (node[0] + 1, hashlib.sha256(b"\1" + self.stack.pop()[1] + node[1]).digest())
        self.stack.append(node)

    def root(self) -> bytes:
        """Incomplete trees join from the last to the first; without leaves, the hash of nothing."""
        out = self.stack[-1][1] if self.stack else hashlib.sha256(b"").digest()
        for _, node in reversed(self.stack[:-1]):
            out = hashlib.sha256(b"\1" + node + out).digest()
        return out


def recipe_root(names: bytes) -> bytes:
    """The root of a document over its chunks' names, 32 bytes each."""
    return names if len(names) == 32 else Merkle(names[k : k + 32] for k in range(0, len(names), 32)).root()


def pack_ids(ids: np.ndarray) -> bytes:
    small = not len(ids) or int(ids.max()) < 1 << 16
    return (b"\x02" + ids.astype("<u2").tobytes()) if small else (b"\x04" + ids.astype("<u4").tobytes())


def unpack_ids(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if raw[0] == 2 else "<u4", offset=1).astype(np.uint32)


@lru_cache(maxsize=1)
def _gear(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _GEAR_BASE, U64), np.full(n, pow(_GEAR_BASE, -1, 1 << 64), U64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def cut_points(ids: np.ndarray, begins: np.ndarray) -> list[tuple[int, int, int]]:
    """(document, start, end) of the chunks of id streams laid end to end; begins: each one's start, and the end of all."""
    n = len(ids)
    up, down = _gear(1 << max(1, n).bit_length())
    p = np.concatenate([np.zeros(1, U64), np.cumsum(mix(ids.astype(U64) + U64(7)) * up[:n])])
    at = np.arange(GEAR, n + 1)
    h = mix((p[at] - p[at - GEAR]) * down[at - GEAR]) if len(at) else p[:0]
    marks = at[(h >> U64(64 - CUT_BITS)) == 0]
    out = []
    lo, hi = np.searchsorted(marks, begins[:-1] + LEAST), np.searchsorted(marks, begins[1:])
    for d, (a, b, i, j) in enumerate(zip(begins[:-1].tolist(), begins[1:].tolist(), lo.tolist(), hi.tolist(), strict=True)):
        start = a
        for m in marks[i:j].tolist():
            if m - start < LEAST:
                continue
            while m - start > MOST:
                out.append((d, start, start + MOST))
                start += MOST
            if m - start >= LEAST:
                out.append((d, start, m))
                start = m
        while b - start > MOST:
            out.append((d, start, start + MOST))
            start += MOST
        if b > start:
            out.append((d, start, b))
    return out


#: The normaliser and splitter for which encode_slice's runs were checked; other tokenizers get whole texts.
_CHECKED_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_CHECKED_SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def splits_at_runs(tokenizer: str) -> bool:
    """Whether a tokenizer (its JSON) is of the kind whose ids are those of its runs; added tokens must start with `<|` and hold no space."""
    import json

    t = json.loads(tokenizer)
    plain = all(a["content"].startswith("<|") and not any(c.isspace() for c in a["content"]) and not (a["single_word"] or a["normalized"]) for a in t["added_tokens"])
    return plain and t["normalizer"] == _CHECKED_NORMALIZER and t["pre_tokenizer"] == _CHECKED_SPLITTER and not t["truncation"] and not t["padding"]


def _encoder(path: str) -> Encoder:
    return hold(("ids", path), lambda: _make_encoder(path))


def _make_encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = json_tokenizer(path)
    runs = splits_at_runs(t.to_str())
    encoder = Encoder(lambda chunks: [e.ids for e in t.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)], np.uint32, REMEMBERED if runs else 1)
    encoder.runs = runs
    return encoder


_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_MARK = np.zeros(256, bool)
_MARK[0x21:0x41] = _MARK[0x5B:0x61] = _MARK[0x7B:0x7F] = True
_MARK[0x27] = False


def _letter_ends(data: np.ndarray) -> np.ndarray:
    """Bytes with an ASCII letter on one side and an ASCII mark or digit other than the apostrophe on the other."""
    letter, mark = _LETTER[data], _MARK[data]
    out = np.zeros(len(data), bool)
    out[1:] = (letter[1:] & mark[:-1]) | (mark[1:] & letter[:-1])
    return out


_ANY = np.ones(256, bool)


def _lowered(data: np.ndarray) -> np.ndarray:
    """ASCII capitals lower-cased, except before a byte beyond ASCII: `H` and a combining mark need not compose as `h` and the mark do."""
    capital = (data >= 65) & (data <= 90)
    capital[:-1] &= data[1:] < 128
    return data + (capital.astype(np.uint8) << 5)


def encode_slice(data: np.ndarray, offs: np.ndarray, encoder: Encoder) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, each with END_ID behind it; where each begins, and the end).

    The checked tokenizer drops white space and joins nothing over it, nor a letter with a mark or digit, and it
    composes characters and then lower-cases; so runs of either are encoded apart, lower-cased but for capitals
    before a character beyond ASCII, which may compose with it. Slices that may hold a special token
    (`<|`) keep their words whole and as they are. Of other tokenizers a text is one run.
    """
    if not encoder.runs:
        w = scan(data, offs, _ANY)
    elif b"<|" in data.tobytes():
        w = scan(data, offs, NOT_SPACE)
    else:
        w = scan(_lowered(data), offs, NOT_SPACE, cuts=_letter_ends(data))
    raw = w.data.tobytes()
    ids, sizes = encoder.ids(w.hash, lambda k: raw[w.start[k] : w.end[k]])
    ends = np.concatenate([[0], np.cumsum(sizes)])[w.first]
    return np.insert(ids, ends[1:], END_ID), ends + np.arange(len(ends))


def _objects(tokenizer: str, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for t in batches_of(batches, PACK_BYTES):
            doc_ids, known = t.column("doc_id").to_pylist(), set()
            for i, _, data, offs in text_slices(t.column("text"), _SLICE):
                ids, begins = encode_slice(data, offs, encoder)
                rows, recipes = [], {}
                for d, a, b in cut_points(ids, begins):
                    raw = pack_ids(ids[a:b])
                    name = hashlib.sha256(raw).digest()
                    recipes.setdefault(d, []).append((name, b - a))
                    if name not in known:
                        known.add(name)
                        rows.append((int.from_bytes(name[:4], "little") % n, 0, name, raw, None, None, None, None, None))
                for d, parts in recipes.items():
                    names = b"".join(x for x, _ in parts)
                    root = recipe_root(names)
                    sizes = np.array([s for _, s in parts], "<u4")
                    # Recipes are spread by id and place in the slice, not by content, so copies don't meet.
                    rows.append((((doc_ids[i + d] or 0) * 0x9E3779B1 + d * 0x85EBCA77 >> 7) % n, 1, None, None, doc_ids[i + d], int(sizes.sum()), names, sizes.tobytes(), root))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OBJECT_ARROW, strict=True)], schema=_OBJECT_ARROW)

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops chunks that the partition has had; equal chunks meet in one partition."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for name in batch.column(batch.schema.get_field_index("name")).to_pylist():
            keep.append(name is None or name not in seen)
            if name is not None:
                seen.add(name)
        yield batch.filter(pa.array(keep, pa.bool_()))


MANIFEST = T.StructType(
    [
        field("shard", T.IntegerType()),
        field("row", T.LongType()),
        field("doc_id", T.LongType()),
        field("start", T.LongType()),
        field("n_tokens", T.LongType()),
        field("names", T.BinaryType()),
        field("sizes", T.BinaryType()),
        field("root", T.BinaryType()),
    ]
)


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shard, row and start for recipes that come in order."""
    shard, row, start = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        n = batch.num_rows
        tokens = batch.column(batch.schema.get_field_index("n_tokens")).to_numpy()
        ends = start + np.cumsum(tokens)
        own = [pa.array(np.full(n, shard, np.int32)), pa.array(np.arange(row, row + n)), batch.column(0), pa.array((ends - tokens).astype(np.int64))]
        yield pa.RecordBatch.from_arrays([*own, *batch.columns[1:]], names=MANIFEST.names)
        row, start = row + n, int(ends[-1]) if n else start


ROOTS = T.StructType([field("shard", T.IntegerType()), field("n_docs", T.LongType()), field("n_tokens", T.LongType()), field("root", T.BinaryType())])


def _shard_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The Merkle root of each shard of a partition sorted by shard and row."""
    now, out = None, []
    for batch in batches:
        for shard, row, tokens, names, root in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if recipe_root(names) != root:
                raise CorruptStore(f"the recipe in row {row} of shard {shard} doesn't have its root")
            if now is None or now[0] != shard:
                if now:
                    out.append(now)
                now = [shard, 0, 0, Merkle()]
            now[1] += 1
            now[2] += tokens
            now[3].push(root)
    out += [now] if now else []
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.int64()), pa.array([r[3].root() for r in out], pa.binary())], names=ROOTS.names)


def _roots(manifest: DataFrame) -> DataFrame:
    n = partitions(manifest.sparkSession)
    return manifest.select("shard", "row", "n_tokens", "names", "root").repartitionById(n, F.col("shard") % n).sortWithinPartitions("shard", "row").mapInArrow(_shard_roots, ROOTS)


WHOLE = T.StructType([field("n_shards", T.LongType()), field("n_docs", T.LongType()), field("n_tokens", T.LongType()), field("root", T.BinaryType())])


def _whole_root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shards, docs, tokens, tree = 0, 0, 0, Merkle()
    for batch in batches:
        for _, n, t, root in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            shards, docs, tokens = shards + 1, docs + n, tokens + t
            tree.push(root)
    yield pa.RecordBatch.from_arrays([pa.array([shards]), pa.array([docs]), pa.array([tokens]), pa.array([tree.root()], pa.binary())], names=WHOLE.names)


def _whole(roots: DataFrame) -> DataFrame:
    """The store's one row, from one row for each shard (as many as the store was written with partitions)."""
    return roots.repartition(1).sortWithinPartitions("shard").mapInArrow(_whole_root, WHOLE)


def write_store(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> None:
    """Encodes every text and writes the store into a new folder."""
    spark = docs.sparkSession
    n = partitions(spark)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    made = own.mapInArrow(_objects(tokenizer or default_path("word_bpe_49k.json"), n), OBJECT)
    placed = made.repartitionById(n, F.col("pid")).mapInArrow(_once, OBJECT)
    placed.write.option("compression", "zstd").parquet(f"{path}/objects")
    recipes = spark.read.schema(OBJECT).parquet(f"{path}/objects").where("kind = 1").select("doc_id", "n_tokens", "names", "sizes", "root")
    ordered = recipes.repartitionByRange(n, "doc_id", "root").sortWithinPartitions("doc_id", "root")
    ordered.mapInArrow(_number, MANIFEST).write.parquet(f"{path}/manifest")
    _roots(spark.read.schema(MANIFEST).parquet(f"{path}/manifest")).write.parquet(f"{path}/roots")
    _whole(spark.read.schema(ROOTS).parquet(f"{path}/roots")).write.parquet(f"{path}/whole")


def _multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of polynomials over GF(2) modulo the CRC-32 polynomial, highest power in the lowest bit."""
    out, a, b = np.zeros(len(a), U64), a.astype(U64), b.astype(U64)
    for k in range(31, -1, -1):
        out ^= np.where((a >> U64(k)) & U64(1), b, U64(0))
        b = (b >> U64(1)) ^ np.where(b & U64(1), U64(0xEDB88320), U64(0))
    return out


def _power(bits: np.ndarray) -> np.ndarray:
    """x to the given powers, modulo the same."""
    out, square = np.full(len(bits), 1 << 31, U64), np.array([1 << 30], U64)
    left = bits.astype(np.int64)
    while left.any():
        odd = (left & 1) > 0
        out[odd] = _multiply(out[odd], np.broadcast_to(square, odd.sum()))
        square, left = _multiply(square, square), left >> 1
    return out


def shifted_crc(crc: np.ndarray, bytes_after: np.ndarray) -> np.ndarray:
    """What a part's CRC-32 adds (by exclusive or) to that of a whole with so many bytes behind the part."""
    return _multiply(_power(bytes_after * 8), crc)


_CHECKED = T.StructType([field("name", T.BinaryType()), field("stored", T.LongType()), field("crc", T.LongType())])


def _check_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, raws = (c.to_pylist() for c in batch.columns)
        sizes, crcs = [], []
        for name, raw in zip(names, raws, strict=True):
            if hashlib.sha256(raw).digest() != name:
                raise CorruptStore(f"chunk {name.hex()} doesn't have its name's content")
            ids = unpack_ids(raw)
            sizes.append(len(ids))
            crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], names=_CHECKED.names)


_NEED = T.StructType([field("shard", T.IntegerType()), field("name", T.BinaryType())])


def _needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The names that a task's recipes use, once for each shard."""
    seen: set[tuple[int, bytes]] = set()
    for batch in batches:
        new = []
        for shard, names in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for k in range(0, len(names), 32):
                if (key := (shard, names[k : k + 32])) not in seen:
                    seen.add(key)
                    new.append(key)
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in new], pa.int32()), pa.array([x for _, x in new], pa.binary())], names=_NEED.names)


#: Answers (kind 0: name, ids stored, CRC) and recipes (kind 1), on their way to their shard.
_TOLD = T.StructType([field("shard", T.IntegerType()), field("kind", T.IntegerType()), field("row", T.LongType()), field("name", T.BinaryType()), field("stored", T.LongType()), field("crc", T.LongType()), field("sizes", T.BinaryType()), field("doc_id", T.LongType()), field("start", T.LongType())])
_READ = T.StructType([field("shard", T.IntegerType()), field("doc_id", T.LongType()), field("start", T.LongType()), field("n_tokens", T.LongType()), field("ids_crc32", T.LongType())])


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each recipe's length and CRC from its chunks'; a shard's answers come before its recipes."""
    told: dict[bytes, int] = {}
    stored, crcs, now = [], [], None

    def settled(at: list[int], counts: list[int], sizes: list[bytes], docs: list, starts: list[int]) -> pa.RecordBatch:
        place, ends = np.array(at, np.int64), np.cumsum(counts)
        size = np.frombuffer(b"".join(sizes), "<u4").astype(np.int64)
        if len(size) != len(place) or not np.array_equal(size, np.array(stored, np.int64)[place]):
            raise CorruptStore("a recipe names a chunk that isn't stored in its length")
        total = np.cumsum(size)
        tokens = np.diff(np.concatenate([[0], total[ends - 1]]))
        add = shifted_crc(np.array(crcs, np.int64)[place], 4 * (np.repeat(total[ends - 1], counts) - total))
        whole = np.bitwise_xor.reduceat(add, ends - counts).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array([now] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(tokens), pa.array(whole)], names=_READ.names)

    for batch in batches:
        rows = ([], [], [], [], [])
        for shard, kind, _, name, held, crc, size, doc, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if shard != now:
                if rows[1]:
                    yield settled(*rows)
                rows, told, stored, crcs, now = ([], [], [], [], []), {}, [], [], shard
            if kind == 0:
                if held is None:
                    raise CorruptStore(f"chunk {name.hex()} isn't stored")
                told[name] = len(stored)
                stored.append(held)
                crcs.append(crc)
                continue
            rows[0].extend(told[name[x : x + 32]] for x in range(0, len(name), 32))
            for column, value in zip(rows[1:], (len(name) // 32, size, doc, start), strict=True):
                column.append(value)
        if rows[1]:
            yield settled(*rows)


_PART = T.StructType([field("shard", T.IntegerType()), field("row", T.LongType()), field("seq", T.LongType()), field("name", T.BinaryType())])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk of each recipe."""
    for batch in batches:
        out = [(shard, row, k // 32, names[k : k + 32]) for shard, row, names in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k in range(0, len(names), 32)]
        columns = zip(*out, strict=True) if out else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=_PART.names)


def _tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    objects = spark.read.schema(OBJECT).parquet(f"{path}/objects").where("kind = 0").select("name", "ids")
    return objects, spark.read.schema(MANIFEST).parquet(f"{path}/manifest"), spark.read.schema(ROOTS).parquet(f"{path}/roots")


def verify_roots(spark: SparkSession, path: str) -> None:
    """Fails unless the recipes have their roots, every shard's Merkle root and counts follow from its manifest, no shard is
    missing on either side, and the store's root and counts follow from the shards'."""
    _, manifest, roots = _tables(spark, path)
    found = _roots(manifest).select("shard", F.struct("n_docs", "n_tokens", "root").alias("found"))
    stated = roots.select("shard", F.struct("n_docs", "n_tokens", "root").alias("stated"))
    wrong = found.join(stated, "shard", "full").where(~F.col("found").eqNullSafe(F.col("stated")))
    if not wrong.isEmpty():
        raise CorruptStore("a shard's manifest doesn't have its root, or one of them is missing")
    whole = spark.read.schema(WHOLE).parquet(f"{path}/whole")
    if [tuple(r) for r in whole.limit(2).collect()] != [tuple(r) for r in _whole(roots).collect()]:
        raise CorruptStore("the store's shards don't have its root")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the stored files, all checked."""
    verify_roots(spark, path)
    n = partitions(spark)
    objects, manifest, roots = _tables(spark, path)
    chunks = objects.mapInArrow(_check_chunks, _CHECKED)
    needs = manifest.select("shard", "names").mapInArrow(_needs, _NEED)
    none = lambda *names: [F.lit(None).cast(_TOLD[c].dataType).alias(c) for c in names]
    answers = needs.join(chunks, "name", "left").select("shard", F.lit(0).alias("kind"), *none("row"), "name", "stored", "crc", *none("sizes", "doc_id", "start"))
    recipes = manifest.select("shard", F.lit(1).alias("kind"), "row", F.col("names").alias("name"), *none("stored", "crc"), "sizes", "doc_id", "start")
    told = answers.unionByName(recipes).select(_TOLD.names)
    read = told.repartitionById(n, F.col("shard") % n).sortWithinPartitions("shard", "kind").mapInArrow(_assemble, _READ)
    # One row for each shard: as many as the store was written with partitions.
    before = roots.withColumn("before", F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)))
    own = F.broadcast(before.select("shard", F.coalesce("before", F.lit(0)).alias("before")))
    return read.join(own, "shard").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """shard, row, doc_id and the ids of each document (array of int)."""
    objects, manifest, _ = _tables(spark, path)
    parts = manifest.select("shard", "row", "names").mapInArrow(_parts, _PART)
    joined = parts.join(objects, "name").groupBy("shard", "row").agg(F.array_sort(F.collect_list(F.struct("seq", "ids"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, row, parts = batch.columns
            ids = [np.concatenate([unpack_ids(p["ids"]) for p in ps]).astype(np.int32) for ps in parts.to_pylist()]
            yield pa.RecordBatch.from_arrays([shard, row, pa.array(ids, pa.list_(pa.int32()))], names=["shard", "row", "ids"])

    return manifest.select("shard", "row", "doc_id").join(joined.mapInArrow(run, "shard int, row long, ids array<int>"), ["shard", "row"])


def store_and_read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Writes a store into the shared folder and reads it back; it goes when the session's JVM ends."""
    path = fresh_dir(docs.sparkSession, "tokenstore")
    write_store(docs, path, id_col, text_col, tokenizer)
    until_the_end(docs.sparkSession, path)
    return read_store(docs.sparkSession, path)


__all__ = ["CorruptStore", "read_store", "reconstruct", "store_and_read", "verify_roots", "write_store"]
