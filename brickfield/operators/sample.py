"""Joins of points with volumes: nearest neighbour, trilinear, tricubic, partial volume; and lattices.

points(pid, x, y, z) are in the voxel coordinates of the volume. A gather explodes a point into the voxels it needs
(1, 8 or 64), joins them on the voxel index and adds up weight times value, so it is an equi-join
and a partial aggregation whatever the sizes. A single volume of up to PACKED voxels goes to the points as one array
instead, so that nothing is exploded, shuffled or joined by point. Shifted sub-lattices in such a volume are arrays in numpy.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import AXES, Geometry, affine, grid, rounded
from .measures import local_diff

XYZ = ("x", "y", "z")
OUTSIDE = -1.7976931348623157e308
#: Voxels of a volume that is sent to all tasks as one array (32 KB).
PACKED = 4096
#: Nodes whose points are worked on at once.
NODES = 1024


def _indexed(voxels: DataFrame, value: str = "value", by: tuple[str, ...] = ()) -> DataFrame:
    return voxels.select(*by, *(F.col(a).alias(f"_{a}") for a in AXES), F.col(value).alias("_v"))


def inside_nearest(size) -> Column:
    out = F.lit(True)
    for c, n in zip(XYZ, size, strict=True):
        out = out & (F.col(c) >= -0.5) & (F.col(c) < n - 0.5)
    return out


def inside_linear(size) -> Column:
    out = F.lit(True)
    for c, n in zip(XYZ, size, strict=True):
        out = out & (F.col(c) >= 0) & (F.col(c) < n - 1)
    return out


def inside_cubic(size) -> Column:
    out = F.lit(True)
    for c, n in zip(XYZ, size, strict=True):
        out = out & (F.col(c) >= 1) & (F.col(c) < n - 2)
    return out


def _is_packed(size, by: tuple[str, ...]) -> bool:
    return not by and int(np.prod([int(n) for n in size], dtype=object)) <= PACKED


def _within(voxels: DataFrame, size) -> DataFrame:
    return voxels.where(" and ".join(f"{a} >= 0 and {a} < {int(n)}" for a, n in zip(AXES, size, strict=True)))


def with_packed(points: DataFrame, voxels: DataFrame, size) -> DataFrame:
    """points with the volume's values in raster order as the array _packed, null where a voxel is missing."""
    nx, ny, nz = (int(n) for n in size)
    live = _within(voxels, size)
    raster = ((F.col("i") * ny + F.col("j")) * nz + F.col("k")).cast("int")
    each = live.groupBy(raster.alias("_r")).agg(F.max("value").alias("_v"))
    at = each.agg(F.map_from_entries(F.collect_list(F.struct("_r", "_v"))).alias("_m"))
    one = at.select(F.transform(F.sequence(F.lit(0), F.lit(nx * ny * nz - 1)), lambda p: F.try_element_at("_m", p)).alias("_packed"))
    return points.crossJoin(F.broadcast(one))  # one row


def _packed_nearest(size) -> Column:
    at = [rounded(F.col(c)) for c in XYZ]
    return F.get("_packed", F.when(inside_nearest(size), (at[0] * int(size[1]) + at[1]) * int(size[2]) + at[2]))


def _packed_sum(points: DataFrame, size, inside: Column, base, low: int, high: int, weight, out: str) -> DataFrame:
    """points with the sum of weight times value over the voxels base + low ... base + high on each axis; null outside and where all are missing."""
    ny, nz = int(size[1]), int(size[2])
    at = [base(F.col(c)).cast("int") for c in XYZ]
    span = range(low, high + 1)
    weights = {f"_w{a}": F.array(*(weight(F.col(c) - base(F.col(c)), d) for d in span)) for a, c in zip(AXES, XYZ, strict=True)}
    df = points.withColumns({"_at": F.when(inside, (at[0] * ny + at[1]) * nz + at[2]), **weights})
    offsets = list(itertools.product(span, repeat=3))
    value = lambda o: F.get("_packed", F.col("_at") + o)
    share = lambda i, j, k: F.get("_wi", i) * F.get("_wj", j) * F.get("_wk", k)
    if len(offsets) <= 8:
        v = [value((i * ny + j) * nz + k) for i, j, k in offsets]
        some = F.coalesce(*v).isNotNull()
        total = sum((share(*(F.lit(d - low) for d in o)) * F.coalesce(x, F.lit(0.0)) for o, x in zip(offsets, v, strict=True)), F.lit(0.0))
    else:  # a loop: so many terms written out make a method that Java doesn't compile
        table = F.array(*(F.struct(F.lit((o[0] * ny + o[1]) * nz + o[2]).alias("o"), *(F.lit(d - low).alias(a) for a, d in zip(AXES, o, strict=True))) for o in offsets))
        some = F.exists(table, lambda t: value(t["o"]).isNotNull())
        total = F.aggregate(table, F.lit(0.0), lambda s, t: s + share(*(t[a] for a in AXES)) * F.coalesce(value(t["o"]), F.lit(0.0)))
    return df.withColumn(out, F.when(F.col("_at").isNotNull() & some, total)).drop("_at", *weights)


def nearest(points: DataFrame, voxels: DataFrame, size, out: str = "sample", by: tuple[str, ...] = ()) -> DataFrame:
    """points with the nearest voxel's value; null outside."""
    if _is_packed(size, by):
        return with_packed(points, voxels, size).withColumn(out, _packed_nearest(size)).drop("_packed")
    keyed = points.withColumns({f"_{a}": F.when(inside_nearest(size), rounded(F.col(c))) for a, c in zip(AXES, XYZ, strict=True)})
    keys = [*by, *(f"_{a}" for a in AXES)]
    return keyed.join(_indexed(voxels, by=by), keys, "left").withColumnRenamed("_v", out).drop("_i", "_j", "_k")


def corners(points: DataFrame, low: int, high: int, weight) -> DataFrame:
    """points exploded into the voxels floor(x) + low ... floor(x) + high on each axis, with the product of the axes' weights."""
    spans = [F.array(*(F.struct(F.lit(d).alias("d"), weight(F.col(c) - F.floor(c), d).alias("w")) for d in range(low, high + 1))) for c in XYZ]
    df = points
    for a, c, s in zip(AXES, XYZ, spans, strict=True):
        df = df.withColumn(f"_s{a}", F.explode(s)).withColumn(f"_{a}", (F.floor(c) + F.col(f"_s{a}.d")).cast("int"))
    return df.withColumn("_w", F.col("_si.w") * F.col("_sj.w") * F.col("_sk.w")).drop("_si", "_sj", "_sk")


def _linear_weight(t: Column, d: int) -> Column:
    return 1 - t if d == 0 else t


def _cubic_weight(t: Column, d: int) -> Column:
    """Catmull-Rom."""
    t2, t3 = t * t, t * t * t
    return {-1: (-t + 2 * t2 - t3) / 2, 0: (2 - 5 * t2 + 3 * t3) / 2, 1: (t + 4 * t2 - 3 * t3) / 2, 2: (t3 - t2) / 2}[d]


def _gather(points: DataFrame, voxels: DataFrame, low: int, high: int, weight, out: str, by: tuple[str, ...]) -> DataFrame:
    keys = [*by, "_i", "_j", "_k"]
    met = corners(points.select("pid", *by, *XYZ), low, high, weight).join(_indexed(voxels, by=by), keys)
    return met.groupBy("pid", *by).agg(F.sum(F.col("_w") * F.col("_v")).alias(out))


def _packed_linear(points: DataFrame, size, out: str) -> DataFrame:
    got = _packed_sum(points, size, inside_linear(size), F.floor, 0, 1, _linear_weight, "_inner")
    return got.withColumn(out, F.coalesce("_inner", _packed_nearest(size))).drop("_inner")


def trilinear(points: DataFrame, voxels: DataFrame, size, out: str = "sample", by: tuple[str, ...] = ()) -> DataFrame:
    """points with the trilinear value; the nearest voxel's outside the inner box; null outside the volume."""
    if _is_packed(size, by):
        return _packed_linear(with_packed(points, voxels, size), size, out).drop("_packed")
    inner = _gather(points.where(inside_linear(size)), voxels, 0, 1, _linear_weight, "_inner", by)
    near = nearest(points, voxels, size, "_near", by)
    return near.join(inner.hint("merge"), ["pid", *by], "left").withColumn(out, F.coalesce("_inner", "_near")).drop("_inner", "_near")


def trilinear_columns(points: DataFrame, voxels: DataFrame, size, columns: tuple[str, ...]) -> DataFrame:
    """points with the trilinear values of several columns of the voxels, in one gather; the nearest voxel's outside the inner box."""
    at = voxels.select(*(F.col(a).alias(f"_{a}") for a in AXES), *(F.col(c).alias(f"_v{c}") for c in columns))
    keys = ["_i", "_j", "_k"]
    met = corners(points.where(inside_linear(size)).select("pid", *XYZ), 0, 1, _linear_weight).join(at, keys)
    inner = met.groupBy("pid").agg(*(F.sum(F.col("_w") * F.col(f"_v{c}")).alias(f"_s{c}") for c in columns))
    near = points.withColumns({f"_{a}": F.when(inside_nearest(size), rounded(F.col(c))) for a, c in zip(AXES, XYZ, strict=True)}).join(at, keys, "left")
    return near.join(inner, "pid", "left").withColumns({c: F.coalesce(f"_s{c}", f"_v{c}") for c in columns}).drop(*keys, *(f"_{n}{c}" for n in "sv" for c in columns))


def tricubic(points: DataFrame, voxels: DataFrame, size, out: str = "sample", by: tuple[str, ...] = ()) -> DataFrame:
    """Catmull-Rom over 64 voxels; trilinear near the edge, nearest at it."""
    inner = _gather(points.where(inside_cubic(size)), voxels, -1, 2, _cubic_weight, "_cubic", by)
    rest = trilinear(points, voxels, size, "_linear", by)
    return rest.join(inner, ["pid", *by], "left").withColumn(out, F.coalesce("_cubic", "_linear")).drop("_cubic", "_linear")


def _quadratic_weight(t: Column, d: int) -> Column:
    """The quadratic spline through a voxel and its two neighbours; t is measured from the voxel, -0.5 to 0.5."""
    u = t + 0.5
    return {-1: (1 - u) * (1 - u) / 2, 0: (1 + 2 * u - 2 * u * u) / 2, 1: u * u / 2}[d]


def triquadratic(points: DataFrame, voxels: DataFrame, size, out: str = "sample", by: tuple[str, ...] = ()) -> DataFrame:
    """Quadratic spline over 27 voxels around the nearest one; trilinear near the edge, nearest at it."""
    inside = F.lit(True)
    for c, n in zip(XYZ, size, strict=True):
        inside = inside & (F.col(c) >= 0.5) & (F.col(c) < n - 1.5)
    if _is_packed(size, by):
        got = _packed_sum(with_packed(points, voxels, size), size, inside, lambda c: F.floor(c + 0.5), -1, 1, _quadratic_weight, "_quadratic")
        return _packed_linear(got, size, "_linear").withColumn(out, F.coalesce("_quadratic", "_linear")).drop("_quadratic", "_linear", "_packed")
    live = points.where(inside).select("pid", *by, *XYZ)
    spans = {c: F.array(*(F.struct(F.lit(d).alias("d"), _quadratic_weight(F.col(c) - rounded(F.col(c)), d).alias("w")) for d in (-1, 0, 1))) for c in XYZ}
    for a, c in zip(AXES, XYZ, strict=True):
        live = live.withColumn(f"_s{a}", F.explode(spans[c])).withColumn(f"_{a}", (rounded(F.col(c)) + F.col(f"_s{a}.d")).cast("int"))
    met = live.join(_indexed(voxels, by=by), [*by, "_i", "_j", "_k"])
    inner = met.groupBy("pid", *by).agg(F.sum(F.col("_si.w") * F.col("_sj.w") * F.col("_sk.w") * F.col("_v")).alias("_quadratic"))
    rest = trilinear(points, voxels, size, "_linear", by)
    return rest.join(inner.hint("merge"), ["pid", *by], "left").withColumn(out, F.coalesce("_quadratic", "_linear")).drop("_quadratic", "_linear")


def point_value(points: DataFrame, voxels: DataFrame, size, out: str = "sample", by: tuple[str, ...] = ()) -> DataFrame:
    """The trilinear value, or the most negative double outside the inner box."""
    inner = _gather(points.where(inside_linear(size)), voxels, 0, 1, _linear_weight, out, by)
    return points.join(inner, ["pid", *by], "left").withColumn(out, F.coalesce(F.col(out), F.lit(OUTSIDE)))


def bicubic_slice(points: DataFrame, voxels: DataFrame, size, out: str = "sample", by: tuple[str, ...] = ()) -> DataFrame:
    """Catmull-Rom over 16 voxels within the nearest slice along z; null outside the inner box of the slice."""
    inside = (F.col("z") >= -0.5) & (F.col("z") < size[2] - 0.5)
    for c, n in zip(XYZ[:2], size[:2], strict=True):
        inside = inside & (F.col(c) >= 1) & (F.col(c) < n - 2)
    live = points.where(inside).select("pid", *by, *XYZ).withColumn("_k", rounded(F.col("z")))
    for a, c in zip(AXES[:2], XYZ[:2], strict=True):
        span = F.array(*(F.struct(F.lit(d).alias("d"), _cubic_weight(F.col(c) - F.floor(c), d).alias("w")) for d in (-1, 0, 1, 2)))
        live = live.withColumn(f"_s{a}", F.explode(span)).withColumn(f"_{a}", (F.floor(c) + F.col(f"_s{a}.d")).cast("int"))
    met = live.join(_indexed(voxels, by=by), [*by, "_i", "_j", "_k"]).groupBy("pid", *by).agg(F.sum(F.col("_si.w") * F.col("_sj.w") * F.col("_v")).alias(out))
    return points.join(met, ["pid", *by], "left")


def evaluate(points: DataFrame, voxels: DataFrame, size, degree: int, out: str = "sample", by: tuple[str, ...] = ()) -> DataFrame:
    """Degree -1 nearest, 0 trilinear, 1 quadratic, 2 tricubic; each falls back near edges."""
    return {-1: nearest, 0: trilinear, 1: triquadratic, 2: tricubic}[degree](points, voxels, size, out, by)


def evaluate_world(points: DataFrame, voxels: DataFrame, g: Geometry, degree: int = 0, out: str = "sample") -> DataFrame:
    return evaluate(transformed(points, g.to_voxel()), voxels, g.size, degree, out)


def partial_volume(points: DataFrame, voxels: DataFrame, size, by: tuple[str, ...] = (), join_by: tuple[str, ...] | None = None) -> DataFrame:
    """Up to eight rows for each point: a voxel's value and its share. by: columns kept; join_by: those of them that volumes have too."""
    met = corners(points.where(inside_linear(size)).select("pid", *by, *XYZ), 0, 1, _linear_weight)
    keys = by if join_by is None else join_by
    return met.join(_indexed(voxels, by=keys), [*keys, "_i", "_j", "_k"]).select("pid", *by, F.col("_v").alias("value"), F.col("_w").alias("share"))


def value_and_derivatives(points: DataFrame, voxels: DataFrame, size) -> DataFrame:
    """Trilinear value and its derivatives along x, y, z."""
    met = corners(points.where(inside_linear(size)).select("pid", *XYZ), 0, 1, _linear_weight).join(_indexed(voxels), ["_i", "_j", "_k"])
    up = [F.col(f"_{a}") > F.floor(c) for a, c in zip(AXES, XYZ, strict=True)]
    t = [F.col(c) - F.floor(c) for c in XYZ]
    share = [F.when(u, f).otherwise(1 - f) for u, f in zip(up, t, strict=True)]
    sign = [F.when(u, 1.0).otherwise(-1.0) for u in up]
    terms = {"value": share[0] * share[1] * share[2], "ddx": sign[0] * share[1] * share[2], "ddy": share[0] * sign[1] * share[2], "ddz": share[0] * share[1] * sign[2]}
    return points.join(met.groupBy("pid").agg(*(F.sum(w * F.col("_v")).alias(n) for n, w in terms.items())), "pid", "left")


def transformed(points: DataFrame, matrix: np.ndarray) -> DataFrame:
    return points.withColumns(dict(zip(XYZ, affine(matrix, *XYZ), strict=True)))


def node_points(size, spark) -> DataFrame:
    """Every voxel of a box as a point, pid its raster number."""
    nx, ny, nz = size
    df = grid(spark, size)
    raster = (F.col("i").cast("long") * ny + F.col("j")) * nz + F.col("k")
    return df.select(raster.alias("pid"), *AXES, *(F.col(a).cast("double").alias(c) for a, c in zip(AXES, XYZ, strict=True)))


def resample(source: DataFrame, source_g: Geometry, like: Geometry, transform: np.ndarray, degree: int = 0, vol: str = "resampled", fill: float = 0.0) -> DataFrame:
    """source as seen through a source-to-target transform on the grid of `like`; fill outside."""
    folded = source_g.to_voxel() @ np.linalg.inv(np.asarray(transform)) @ like.to_world()
    points = transformed(node_points(like.size, source.sparkSession), folded)
    got = evaluate(points.where(inside_nearest(source_g.size)), source, source_g.size, degree)
    whole = points.select("pid", *AXES).join(got.select("pid", "sample"), "pid", "left")
    return whole.select(F.lit(vol).alias("vol"), *AXES, F.coalesce("sample", F.lit(float(fill))).alias("value"))


def lattice(spark, start, step, count) -> DataFrame:
    """World points start + n step, in raster order."""
    df = grid(spark, count, ("s", "r", "c"))
    raster = (F.col("s").cast("long") * int(count[1]) + F.col("r")) * int(count[2]) + F.col("c")
    return df.select(raster.alias("pid"), "s", "r", "c", *((F.lit(float(b)) + F.col(n) * float(d)).alias(a) for a, b, d, n in zip(XYZ, start, step, ("s", "r", "c"), strict=True)))


def lattice_of(g: Geometry, step) -> dict:
    """Start, signed step and count of a lattice over a volume: as many nodes as fit, centred."""
    sep = np.asarray(g.step, float)
    size = np.asarray(g.size, float)
    want = np.asarray(step, float)
    count = np.maximum(1, np.floor(np.abs(sep * size / want) + 0.5)).astype(int)
    signed = np.abs(want) * np.sign(sep)
    first = -0.5 * sep + 0.5 * signed + 0.5 * (sep * size - signed * count)
    start = np.asarray(g.dircos, float).T @ (np.asarray(g.start, float) + first)
    return {"start": tuple(start), "step": tuple(signed), "count": tuple(int(c) for c in count)}


def _offsets(width, count: int) -> list[tuple[float, ...]]:
    line = [0.0] if count < 2 else [-0.5 + n / (count - 1) for n in range(count)]
    return [tuple(t * w for t, w in zip(o, width, strict=True)) for o in itertools.product(line, repeat=3) if sum(t * t for t in o) <= 0.55 * 0.55]


def sub_lattice(nodes: DataFrame, width, count: int) -> DataFrame:
    """Each node's points: count**3 offsets over the width, within an ellipsoid of 0.55. The offsets are a literal array."""
    table = F.array(*(F.struct(*(F.lit(d).alias(f"d{a}") for d, a in zip(p, XYZ, strict=True))) for p in _offsets(width, count)))
    out = nodes.select("*", F.posexplode(table).alias("point", "_o"))
    return out.withColumns({a: F.col(a) + F.col(f"_o.d{a}") for a in XYZ}).drop("_o")


def shifted_similarity(nodes: DataFrame, voxels: DataFrame, size, width, count: int, shifts) -> DataFrame:
    """shift, n and similarity for each node (pid unique, x, y, z, other columns kept) and each shift along x that leaves points.

    The points of a node's sub-lattice take the nearest voxel's value where they are and the trilinear one where the shift puts
    them; those outside, or without a voxel at either place, go. similarity: minus the mean absolute difference of the n others.
    A volume of up to PACKED voxels goes to the nodes as one array, and points stay arrays too: no row is made for a point.
    """
    kept = [f for f in nodes.schema.fields if f.name not in XYZ]
    names = [f.name for f in kept]
    if not _is_packed(size, ()):
        points = sub_lattice(nodes, width, count).withColumns({"_node": F.col("pid"), "pid": F.struct("pid", "point")})
        near = nearest(points, voxels, size, "_v1").where("_v1 is not null")
        moved = near.withColumn("shift", F.explode(F.array(*(F.lit(float(s)) for s in shifts))))
        moved = moved.withColumns({"x": F.col("x") + F.col("shift"), "pid": F.struct("pid", "shift")}).where(inside_linear(size))
        both = trilinear(moved, voxels, size, "_v2").where("_v2 is not null").withColumn("pid", F.col("_node"))
        return both.groupBy(*names, "shift").agg(F.count("*").alias("n"), local_diff(F.col("_v1"), F.col("_v2")).alias("similarity"))

    nx, ny, nz = (int(n) for n in size)
    values, known = np.zeros(nx * ny * nz), np.zeros(nx * ny * nz, bool)
    for i, j, k, v in _within(voxels, size).where("value is not null").groupBy(*AXES).agg(F.max("value")).collect():
        values[(i * ny + j) * nz + k], known[(i * ny + j) * nz + k] = v, True
    offsets, shifts, whole = np.array(_offsets(width, count)), [float(s) for s in shifts], bool(known.all())
    corner = [(i * ny + j) * nz + k for i, j, k in itertools.product((0, 1), repeat=3)]

    def similarities(b: pa.RecordBatch) -> pa.RecordBatch:
        at = [b.column(c).to_numpy(zero_copy_only=False).astype(float)[:, None] + o for c, o in zip(XYZ, offsets.T, strict=True)]
        inside = np.logical_and.reduce([(c >= -0.5) & (c < n - 0.5) for c, n in zip(at, (nx, ny, nz), strict=True)])
        for c, n in zip(at[1:], (ny, nz), strict=True):  # not shifted
            inside &= (c >= 0) & (c < n - 1)
        node = np.nonzero(inside)[0]
        x, y, z = (c[inside] for c in at)
        i, j, k = (np.floor(c + 0.5).astype(int) for c in (x, y, z))
        own = (i * ny + j) * nz + k
        if not whole:
            node, x, y, z, own = (a[known[own]] for a in (node, x, y, z, own))
        v1 = values[own]
        j, k = np.floor(y), np.floor(z)
        ty, tz, row = y - j, z - k, (j * nz + k).astype(int)
        got = []
        for s in shifts:
            moved = x + s
            on = np.flatnonzero((moved >= 0) & (moved < nx - 1))
            moved = moved[on]
            i = np.floor(moved)
            first = i.astype(int) * (ny * nz) + row[on]
            if not whole:
                some = np.logical_or.reduce([known[first + c] for c in corner])
                on, moved, i, first = on[some], moved[some], i[some], first[some]
            tx, u, w = moved - i, ty[on], tz[on]
            v = [values[first + c] for c in corner]
            for t in (w, u, tx):  # pairs along z, then y, then x
                v = [a * (1 - t) + b * t for a, b in zip(v[::2], v[1::2], strict=True)]
            n = np.bincount(node[on], minlength=len(b))
            of = np.flatnonzero(n)
            got.append((of, np.full(len(of), s), n[of], -np.bincount(node[on], np.abs(v1[on] - v[0]), len(b))[of] / n[of]))
        of, *out = (np.concatenate(c) for c in zip(*got, strict=True))
        return pa.RecordBatch.from_arrays([*b.select(names).take(pa.array(of)).columns, *map(pa.array, out)], names=[*names, "shift", "n", "similarity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, len(b), NODES):
                yield similarities(b.slice(start, NODES))

    return nodes.mapInArrow(run, T.StructType([*kept, T.StructField("shift", T.DoubleType()), T.StructField("n", T.LongType()), T.StructField("similarity", T.DoubleType())]))


def target_lattice(points: DataFrame, matrix: np.ndarray, fine: DataFrame | None = None, g: Geometry | None = None) -> DataFrame:
    """Source points through the linear part, plus the displacement of the nearest node of a fine field (none: 0)."""
    if fine is None:
        return transformed(points, matrix)
    keyed = points.withColumns({f"_{a}": rounded(c) for a, c in zip(AXES, affine(g.to_voxel(), *XYZ), strict=True)})
    moved = keyed.join(fine.select(*(F.col(a).alias(f"_{a}") for a in AXES), "dx", "dy", "dz"), ["_i", "_j", "_k"], "left").drop("_i", "_j", "_k")
    shifted = moved.withColumns({a: F.col(a) + F.coalesce(d, F.lit(0.0)) for a, d in zip(XYZ, ("dx", "dy", "dz"), strict=True)})
    return transformed(shifted.drop("dx", "dy", "dz"), matrix)


def nearest_object(sources: DataFrame, targets: DataFrame, cell: float | None = None) -> DataFrame:
    """Distance of each source point (pid, x, y, z) to its nearest target point; null for a point that isn't finite, or without targets.

    cell: the widest cells to begin with; where targets are dense, cells are narrower, so that each holds a few different targets.
    Points that find none within a width look again at twice the width.
    """
    from .scattered import ROUNDS, _cells, _cut, cell_width, finite

    names = [f"_n{c}" for c in XYZ]
    nodes = _cut(finite(targets).select(*(F.col(c).alias(n) for c, n in zip(XYZ, names, strict=True))).distinct())
    total, fit = nodes.count(), cell_width(nodes, names=names)
    width = fit if cell is None else min(cell, fit)
    left, found = finite(sources).select("pid", *XYZ), None
    around = F.array(*(F.struct(*(F.lit(d).alias(a) for a, d in zip("abc", o, strict=True))) for o in itertools.product((-1, 0, 1), repeat=3)))
    d2 = sum((F.col(c) - F.col(n)) ** 2 for c, n in zip(XYZ, names, strict=True))
    for k in range(ROUNDS):
        rest = left.count() if total else 0
        if not rest:
            break
        at, of = _cells(left, width, XYZ, "_"), _cells(nodes, width, names, "_")
        spread = lambda df, own: df.withColumn("_o", F.explode(around)).select(*own, *((F.col(f"_{a}") + F.col(f"_o.{a}")).alias(f"_{a}") for a in "abc"))
        at, of = (at, spread(of, names)) if total <= rest else (spread(at, ("pid", *XYZ)), of)  # the fewer ones go to 27 cells
        # Sorted joins: neither side is small for sure, and what lies in 27 cells is more than it is taken for.
        met = at.join(of.hint("merge"), ["_a", "_b", "_c"])
        best = _cut(met.groupBy("pid").agg(F.sqrt(F.min(d2)).alias("distance")).where(F.col("distance") <= width))
        found = best if found is None else found.unionByName(best)
        left = _cut(left.join(best.select("pid").hint("merge"), "pid", "left_anti"))
        width *= 2 if k < 6 else 8  # what is left by then lies far out
    return sources.withColumn("distance", F.lit(None).cast("double")) if found is None else sources.join(found.hint("merge"), "pid", "left")


def _to_segment() -> Column:
    """Squared distance of x, y, z to the segment x1..z2."""
    a, b, p = [F.col(f"{c}1") for c in XYZ], [F.col(f"{c}2") for c in XYZ], [F.col(c) for c in XYZ]
    ab2 = sum((y - x) * (y - x) for x, y in zip(a, b, strict=True))
    t = F.when(ab2 == 0, 0.0).otherwise(F.least(F.greatest(sum((q - x) * (y - x) for q, x, y in zip(p, a, b, strict=True)) / ab2, F.lit(0.0)), F.lit(1.0)))
    return sum((q - (x + t * (y - x))) ** 2 for q, x, y in zip(p, a, b, strict=True))


def nearest_line(points: DataFrame, lines: DataFrame, cell: float, most: int = 64) -> DataFrame:
    """Distance of each point (pid, x, y, z) to the nearest segment (x1..z2); null for one that isn't finite, or without lines.

    A segment lies in the cells that its points, a cell's width apart at most, fall into, and in those around them, so that
    every segment within a width of a point shares its cell. Points that find none within a width look again at twice the width.
    """
    from .scattered import _cells, _cut, finite

    segments = finite(lines.select(*(f"{c}{n}" for n in (1, 2) for c in XYZ)), [f"{c}{n}" for n in (1, 2) for c in XYZ])
    left, found = finite(points).select("pid", *XYZ), None
    around = F.array(*(F.struct(*(F.lit(d).alias(a) for a, d in zip("abc", o, strict=True))) for o in itertools.product((-1, 0, 1), repeat=3)))
    live = not segments.isEmpty()
    for k in range(most if live else 0):
        if left.isEmpty():
            break
        n = F.ceil(F.greatest(*(F.abs(F.col(f"{c}2") - F.col(f"{c}1")) for c in XYZ)) / cell)
        along = segments.withColumn("_n", F.greatest(n, F.lit(1))).withColumn("_u", F.explode(F.sequence(F.lit(0), F.col("_n"))))
        at = {f"_l{c}": F.col(f"{c}1") + (F.col(f"{c}2") - F.col(f"{c}1")) * (F.col("_u") / F.col("_n")) for c in XYZ}
        near = _cells(along.withColumns(at), cell, [f"_l{c}" for c in XYZ], "_p").withColumn("_o", F.explode(around))
        own = near.select(*segments.columns, *((F.col(f"_p{a}") + F.col(f"_o.{a}")).alias(f"_{a}") for a in "abc")).distinct()
        met = _cells(left, cell, XYZ, "_").join(own, ["_a", "_b", "_c"])
        best = _cut(met.groupBy("pid").agg(F.sqrt(F.min(_to_segment())).alias("distance")).where(F.col("distance") <= cell))
        found = best if found is None else found.unionByName(best)
        left = _cut(left.join(best.select("pid"), "pid", "left_anti"))
        cell *= 2 if k < 6 else 8  # what is left by then lies far out
    return points.select("pid").withColumn("distance", F.lit(None).cast("double")) if found is None else points.select("pid").join(found, "pid", "left")


def without_ends(points: DataFrame, by: str = "object", pos: str = "pos") -> DataFrame:
    """Points of objects without each one's first and last."""
    ends = points.groupBy(by).agg(F.min(pos).alias("_a"), F.max(pos).alias("_b"))
    return points.join(ends, by).where((F.col(pos) != F.col("_a")) & (F.col(pos) != F.col("_b"))).drop("_a", "_b")


def rms(distances: DataFrame, column: str = "distance") -> Column:
    return F.sqrt(F.avg(F.col(column) * F.col(column)))
