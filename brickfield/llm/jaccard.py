"""N-gram Jaccard join by vertical partitioning.

A document is its set of distinct word shingles; two documents link when their sets' Jaccard
similarity reaches a threshold. Shingles have one global order, that of their fingerprints,
and it is cut into fragments. Work is done fragment by fragment, on each document's segment of it,
and partial counts are added up:

1. Equal sets are one class, named by its set's fingerprint; only classes go on.
2. Each fragment counts, for every class, the shingles of its segment that another class also
   has. A class whose counts add up to less than the threshold times its size can link with
   nothing and ends here. Shingles that no other class has are never needed again.
3. Candidates: a pair that links shares a shingle among each one's first few in the global order
   (prefix filter). Classes that share such a shingle form a list.
   The order within a set is by a sketch's count of each shingle's frequency, rare ones first, so
   that passages that very many documents share come last; any order gives the same links.
4. Short lists give their pairs. In a long list, all are compared with one class, the hub. Two members that
   both link with the hub are in one component already. What is left, members that don't link with it
   against all of the hub's members, is counted in blocks of BLOCK by BLOCK: for d(x), the shingles in which x and
   the hub differ, |x & y| follows from |d(x)|, |d(y)| and |d(x) & d(y)|, and the last is one
   product of 0/1 matrices for each fragment of the block's shingles, added up. A block's answer is a spanning forest of its
   links. So no list's pairs become rows, no task holds more than a block, and no link
   between components is lost. A member's row is copied to every block that it is compared in: with u members that don't link with
   their hub in a list of n, about 2 u n / BLOCK rows. Rows of a hub are dealt to as many tasks as its list needs.
5. A pair's overlap is the sum of the overlaps in each fragment.

Links and components stay distributed. Defined results: with fewer words than a shingle, the
whole sequence is the one shingle; a text without words, or null, has the empty set and links with
nothing; rows with equal ids are documents of their own that name themselves alike, so
their components are one; a null id's component is the smallest id other than null, if any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import field, unused, with_columns
from .components import connected
from .packed import FOUND, Pack, Seen, found_rows, gathered, scatter, stream
from .runtime import cut, partitions, staged
from .wordscan import NOT_SPACE, U64, give_back, mix, scan, text_slices

SHINGLE, PERCENT = 5, 75
#: Lists up to this length give all their pairs.
SHORT = 24
#: Counters of the frequency sketch: half a megabyte, whatever the input.
SLOTS = 1 << 17
#: Members of a long list compared in one task, and shingles multiplied at once.
BLOCK, FRAGMENT = 1024, 2048
#: Members of a long list that meet one copy of their hub's shingles, and hubs that may be broadcast, counted.
SPREAD, FEW_HUBS = 256, 10_000
#: Parts of the sketch that are added up side by side.
PARTS = 64
_WIDTH = 6


def _sets(column, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, document, shingle) of each slice, without repetition."""
    for i, j, data, offs in text_slices(column):
        w = scan(data, offs, NOT_SPACE, lower=True)
        key, _, doc = w.grams(size)
        short = np.flatnonzero((w.counts > 0) & (w.counts < size))
        key, doc = np.concatenate([key, w.whole(short)]), np.concatenate([doc, short])
        order = np.lexsort((key, doc))
        key, doc = key[order], doc[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        yield i, j, doc[new], key[new]


def _name(doc: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """Fingerprint of each document's set."""
    total = np.zeros(n, U64)
    np.add.at(total, doc, mix(key + U64(0x632BE59BD9B4E019)))
    size = np.bincount(doc, minlength=n).astype(U64)
    return mix(total ^ mix(size)).view(np.int64)


def shingle_sets(docs: DataFrame, text_col: str, size: int, name_col: str) -> DataFrame:
    """docs with n_shingles and the set's fingerprint."""

    def make():
        def work(batch: pa.RecordBatch) -> list:
            sizes, names = [], []
            for i, j, doc, key in _sets(batch.column(batch.schema.get_field_index(text_col)), size):
                sizes.append(np.bincount(doc, minlength=j - i))
                names.append(_name(doc, key, j - i))
            join = lambda x: pa.array(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64))
            return [join(sizes), join(names)]

        return work

    return with_columns(docs, [field("n_shingles", T.LongType()), field(name_col, T.LongType())], make)


def _set_packs(size: int):
    def packs(t: pa.Table) -> Iterator[Pack]:
        ids, sizes, docs, keys = [], [], [], []
        for i, j, doc, key in _sets(t.column("text"), size):
            ids.append(_name(doc, key, j - i))
            sizes.append(np.bincount(doc, minlength=j - i).astype(np.uint32))
            docs.append(doc + i)
            keys.append(key)
        if not keys:
            return
        ids, sizes, doc, key = np.concatenate(ids), np.concatenate(sizes), np.concatenate(docs), np.concatenate(keys)
        first = np.zeros(len(ids), bool)  # equal sets of a pack go once
        first[np.unique(ids, return_index=True)[1]] = True
        keep = first[doc]
        yield ids, sizes, doc[keep], key[keep], 0

    return packs


def _shared(batches: Iterator[pa.RecordBatch], targets: int) -> Iterator[pa.RecordBatch]:
    """Each fragment's partial result: the shingles of a class that another class has."""
    bucket, seen = None, Seen()
    for now, _, ids, sizes, keys in stream(batches, _WIDTH):
        if now != bucket:
            bucket, seen = now, Seen()
        found, size, key = seen.feed(ids, sizes, keys)
        if len(found):
            yield found_rows(found, size, key | (U64(bucket) << U64(8 * _WIDTH)), targets)


CLASS = T.StructType([field("id", T.LongType()), field("size", T.LongType()), field("codes", T.BinaryType())])
_CLASS_ARROW = pa.schema([("id", pa.int64()), ("size", pa.int64()), ("codes", pa.binary())])


def _survivors(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for node, size, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                codes = np.unique(np.frombuffer(raw, U64))
                if 100 * len(codes) >= percent * size:
                    out.append((node, size, codes.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _CLASS_ARROW, strict=True)], schema=_CLASS_ARROW)

    return run


def _slot(codes: np.ndarray) -> np.ndarray:
    return (mix(codes + U64(0x1F)) >> U64(47)).astype(np.int64)


def _sketch(classes: DataFrame) -> np.ndarray:
    """How many classes have the shingles of each slot: a fixed-size array from each partition, cut into PARTS that are added up apart."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total += np.bincount(_slot(np.frombuffer(raw, U64)), minlength=SLOTS)
        parts = np.minimum(total, 2**32 - 1).astype(np.uint32).reshape(PARTS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["part", "c"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                totals[part] = totals.get(part, 0) + np.frombuffer(raw, np.uint32).astype(np.int64)
        sums = [np.minimum(t, 2**32 - 1).astype(np.uint32).tobytes() for t in totals.values()]
        yield pa.RecordBatch.from_arrays([pa.array(totals.keys(), pa.int32()), pa.array(sums, pa.binary())], names=["part", "c"])

    n = min(PARTS, partitions(classes.sparkSession))
    rows = classes.select("codes").mapInArrow(count, "part int, c binary").repartitionById(n, F.col("part") % n).mapInArrow(add, "part int, c binary").collect()
    out = np.zeros((PARTS, SLOTS // PARTS), np.uint32)  # PARTS rows of a fixed size
    for part, raw in rows:
        out[part] = np.frombuffer(raw, np.uint32)
    return out.ravel()


#: A member of a list; score: how common its shingles are.
LISTED = T.StructType([field("list", T.LongType()), field("id", T.LongType()), field("size", T.IntegerType()), field("score", T.FloatType())])
_LISTED_ARROW = pa.schema([("list", pa.int64()), ("id", pa.int64()), ("size", pa.int32()), ("score", pa.float32())])


def _listed(rows: list[tuple[np.ndarray, int, int, float]]) -> pa.RecordBatch:
    """rows: (lists, id, size, score)"""
    n = [len(r[0]) for r in rows]
    of = lambda k, t: np.repeat(np.array([r[k] for r in rows], t), n)
    lists = np.concatenate([r[0] for r in rows]) if rows else np.zeros(0, U64)
    return pa.RecordBatch.from_arrays([pa.array(lists.view(np.int64)), pa.array(of(1, np.int64)), pa.array(of(2, np.int32)), pa.array(of(3, np.float32))], schema=_LISTED_ARROW)


def _score(counts: np.ndarray) -> float:
    return float(np.log2(1.0 + counts).mean()) if len(counts) else 0.0


def _rarest(codes: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, float]:
    """The codes in the global order, and the set's score."""
    counts = sketch[_slot(codes)]
    return codes[np.lexsort((mix(codes), counts))], _score(counts)


def _prefixes(percent: int, sketch):
    """A row for each of a class's first shingles that a partner must share; shingles of no other class come first in the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        for batch in batches:
            rows = []
            for node, size, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                codes, score = _rarest(np.frombuffer(raw, U64), counts)
                n = size - -(-percent * size // 100) + 1 - (size - len(codes))
                if n > 0:
                    rows.append((codes[:n], node, size, score))
            yield _listed(rows)

    return run


PAIR = T.StructType([field("a", T.LongType()), field("b", T.LongType())])
_PAIR_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64())])
COMPARED = T.StructType([*PAIR, field("size", T.LongType()), field("linked", T.BooleanType()), field("extra", T.BinaryType()), field("lacking", T.BinaryType())])
_COMPARED_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("size", pa.int64()), ("linked", pa.bool_()), ("extra", pa.binary()), ("lacking", pa.binary())])


def _compare(percent: int, differences: bool):
    """Overlap of each pair, summed over the fragments; and, if asked for, what a has besides b and what it lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            numbers = [batch.column(k).to_pylist() for k in (0, 1, 2, 4)]
            for a, b, na, nb, xa, xb in zip(*numbers, batch.column(3), batch.column(5), strict=True):
                x, y = np.frombuffer(xa.as_buffer(), U64), np.frombuffer(xb.as_buffer(), U64)
                at = np.minimum(np.searchsorted(y, x), max(len(y) - 1, 0))
                same = y[at] == x if len(y) else np.zeros(len(x), bool)
                partial = np.bincount((x[same] >> U64(8 * _WIDTH)).astype(np.int64))  # of each fragment
                common = int(partial.sum())
                extra, lacking = None, None
                if differences:
                    has = np.zeros(len(y), bool)
                    has[at[same]] = True
                    extra, lacking = x[~same].tobytes(), y[~has].tobytes()
                out.append((a, b, na, 100 * common >= percent * (na + nb - common), extra, lacking))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [()] * 6, _COMPARED_ARROW, strict=True)], schema=_COMPARED_ARROW)
        give_back()

    return run


def _of(classes: DataFrame, s: str) -> DataFrame:
    return classes.select(F.col("id").alias(s), F.col("size").alias(f"n_{s}"), F.col("codes").alias(f"x_{s}"))


def _compared(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """pairs(a, b) with whether they link."""
    both = pairs.join(_of(classes, "a"), "a").join(_of(classes, "b"), "b").select("a", "b", "n_a", "x_a", "n_b", "x_b")
    return both.mapInArrow(_compare(percent, False), COMPARED)


def _compared_with_hubs(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """members(a, b, part) of hubs b with whether they link, and their differences; a copy of the hub goes to each of its parts."""
    hubs = members.select("b", "part").distinct().join(_of(classes, "b"), "b")
    both = members.join(_of(classes, "a"), "a").join(hubs, ["b", "part"]).select("a", "b", "n_a", "x_a", "n_b", "x_b")
    return both.mapInArrow(_compare(percent, True), COMPARED)


def _pairs_of_short(percent: int):
    """All pairs of lists of at most SHORT members whose sizes let them link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()
        for batch in batches:
            found = set()
            for members in batch.column(0).to_pylist():
                m = tuple(sorted((x["id"], x["size"]) for x in members))
                if m in done:
                    continue
                if len(done) < 20_000:
                    done.add(m)
                for i, (a, na) in enumerate(m):
                    for b, nb in m[i + 1 :]:
                        if a != b and 100 * min(na, nb) >= percent * max(na, nb):
                            found.add((a, b))
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_PAIR_ARROW)

    return run


def _forest(n: int, links: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what all of them connect."""
    up, out = list(range(n)), []
    for a, b in links.tolist():
        while up[a] != a:
            up[a] = a = up[up[a]]
        while up[b] != b:
            up[b] = b = up[up[b]]
        if a != b:
            up[a] = b
            out.append((a, b))
    return out


def _block_links(percent: int):
    def run(t: pa.Table) -> pa.Table:
        """Links between the open members (side 0) and all members (side 1) of one block, as a spanning forest."""
        t = t.combine_chunks()
        side, ids = t.column("side").to_numpy(), t.column("a").to_numpy()
        size, base, lacks = (t.column(c).to_numpy() for c in ("size", "base", "lacks"))
        raw = t.column("apart").to_pylist()
        row, col = np.repeat(np.arange(len(raw)), [len(x) // 8 for x in raw]), np.frombuffer(b"".join(raw), U64)
        names, col = np.unique(col, return_inverse=True)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        place = np.zeros(len(raw), np.int64)
        place[left], place[right] = np.arange(len(left)), np.arange(len(right))
        on_left = side[row] == 0
        both = (np.bincount(col[on_left], minlength=len(names)) > 0) & (np.bincount(col[~on_left], minlength=len(names)) > 0)
        keep = both[col]
        rank = np.cumsum(both) - 1
        row, col, on_left = row[keep], rank[col[keep]], on_left[keep]
        shared = np.zeros((len(left), len(right)), np.float32)
        for a in range(0, int(both.sum()), FRAGMENT):
            part = (col >= a) & (col < a + FRAGMENT)
            x, y = np.zeros((len(left), FRAGMENT), np.float32), np.zeros((len(right), FRAGMENT), np.float32)
            p, q = part & on_left, part & ~on_left
            x[place[row[p]], col[p] - a] = 1
            y[place[row[q]], col[q] - a] = 1
            shared += x @ y.T
        common = np.rint(shared).astype(np.int64) + base[left][:, None] - lacks[left][:, None] - lacks[right][None, :]
        linked = 100 * common >= percent * (size[left][:, None] + size[right][None, :] - common)
        i, j = np.nonzero(linked & (ids[left][:, None] != ids[right][None, :]))
        nodes, at = np.unique(ids, return_inverse=True)
        found = _forest(len(nodes), np.stack([at[left[i]], at[right[j]]], 1))
        give_back()
        return pa.Table.from_arrays([pa.array([nodes[x] for x, _ in found], pa.int64()), pa.array([nodes[y] for _, y in found], pa.int64())], schema=_PAIR_ARROW)

    return run


def _links_of_rest(around: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Links between members that don't link with their hub (b) and all of its members."""
    counts = around.groupBy("b").agg(F.count("*").alias("n"), F.sum((~F.col("linked")).cast("long")).alias("left")).where("left > 0")
    hubs = cut(counts.join(classes.select(F.col("id").alias("b"), (F.length("codes") / 8).cast("long").alias("base")), "b"))
    hubs = F.broadcast(hubs) if hubs.count() <= FEW_HUBS else hubs
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    of = around.join(hubs, "b").select("a", "b", "size", "base", "linked", (F.length("lacking") / 8).cast("long").alias("lacks"), F.concat("extra", "lacking").alias("apart"), blocks("left").alias("bu"), blocks("n").alias("bm"))
    up_to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = lambda n: F.pmod(F.xxhash64("a"), F.col(n)).cast("int")
    kept = ["a", "b", "size", "base", "lacks", "apart"]
    left = of.where("not linked").select(*kept, own("bu").alias("u"), F.explode(up_to("bm")).alias("m"), F.lit(0).alias("side"))
    right = of.select(*kept, F.explode(up_to("bu")).alias("u"), own("bm").alias("m"), F.lit(1).alias("side"))
    return left.unionByName(right).groupBy("b", "u", "m").applyInArrow(_block_links(percent), PAIR)


def class_links(classes: DataFrame, percent: int = PERCENT, short: int = SHORT) -> DataFrame:
    """(a, b) links that join every component of the classes; not every link within one."""
    spark = classes.sparkSession
    sketch = spark.sparkContext.broadcast(_sketch(classes))
    lists = cut(classes.mapInArrow(_prefixes(percent, sketch), LISTED))
    about = lists.groupBy("list").agg(F.count("*").alias("n")).where("n > 1")
    members = cut(lists.join(about, "list"))
    few = members.where(F.col("n") <= short).groupBy("list").agg(F.collect_list(F.struct("id", "size")).alias("members")).select("members")
    near = _compared(few.mapInArrow(_pairs_of_short(percent), PAIR).distinct(), classes, percent).where("linked").select("a", "b")
    parts = F.ceil(F.col("n") / SPREAD).cast("int")
    many = members.where(F.col("n") > short).withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
    hubs = many.groupBy("list").agg(F.max_by("id", F.struct("score", "id")).alias("hub"), F.max("n").alias("n"))
    hubs = hubs.select("list", "hub", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    to_hub = many.join(hubs, ["list", "part"]).where(F.col("id") != F.col("hub"))
    # Lists of different lengths may have the same hub: a pair goes once.
    to_hub = to_hub.groupBy(F.col("id").alias("a"), F.col("hub").alias("b")).agg(F.min("part").alias("part"))
    around = cut(_compared_with_hubs(to_hub, classes, percent))
    return near.unionByName(around.where("linked").select("a", "b")).unionByName(_links_of_rest(around, classes, percent))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT, short: int = SHORT, group_col: str | None = None) -> DataFrame:
    """docs with n_shingles and component_id, the smallest id that links lead to; group_col: the component's own key too, null for a text without words."""
    own, node, root, low = unused(docs, "_set", "_node", "_root", "_low")
    (group,) = [group_col] if group_col else unused(docs, "_group")
    sets = shingle_sets(docs, text_col, size, own)
    text = docs.select(F.col(text_col).alias("text"))
    n = partitions(docs.sparkSession)
    found = scatter(text, _set_packs(size), _WIDTH).mapInArrow(lambda it: _shared(it, n), FOUND)
    classes = staged(gathered(found, _survivors(percent), CLASS), "jaccard")
    roots = connected(class_links(classes, percent, short)).toDF(node, root)
    named = sets.join(roots, F.col(own) == F.col(node), "left").withColumn(group, F.when(F.col("n_shingles") > 0, F.coalesce(root, own))).drop(node, root, own)
    lows = named.where(F.col(group).isNotNull()).groupBy(group).agg(F.min(id_col).alias(low))
    whole = named.join(lows, group, "left").withColumn("component_id", F.coalesce(low, F.col(id_col))).drop(low)
    return whole if group_col else whole.drop(group)
