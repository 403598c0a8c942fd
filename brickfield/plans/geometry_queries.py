"""Queries on phantoms, resampling, lattices, transforms and fits, with their SQL."""

from __future__ import annotations


import numpy as np
from pyspark.sql import functions as F

from ..functions import transforms as tr
from ..model import AXES, Geometry, affine
from ..operators import lattice, masks, nonlinear, sample, stencil, xfmops
from ..sources import phantoms
from .volume_queries import V, query, r6, table, volumes


G16 = Geometry((16, 16, 16), (8.0, 8.0, 8.0), (-64.0, -64.0, -64.0))
_GRID16 = "g AS (SELECT CAST(n // 256 AS INTEGER) AS i, CAST((n // 16) % 16 AS INTEGER) AS j, CAST(n % 16 AS INTEGER) AS k FROM range(4096) t(n))"
_R = (3.75, 5.0, 1.875)
_SHIFT = tr.from_degrees((0.3, -0.2, 0.4), (5, -3, 8), center=(1.5, 1.5, 1.5))


def _d2(i: str, j: str, k: str) -> str:
    return " + ".join(f"pow((8 - ({x})) / {r}, 2)" for x, r in zip((i, j, k), _R, strict=True))


@query(f"WITH {_GRID16} SELECT i, j, k, CASE WHEN abs(i - 8) <= 3.75 AND abs(j - 8) <= 5 AND abs(k - 8) <= 1.875 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM g")
def phantom_rect(spark, sf_dir):
    return phantoms.rectangle(spark, G16).select(*AXES, "value")


@query(f"WITH {_GRID16} SELECT i, j, k, CASE WHEN {_d2('i', 'j', 'k')} <= 1.0000001 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM g")
def phantom_ellipse(spark, sf_dir):
    inside = phantoms.inside_ellipsoid(*(F.col(a) for a in AXES), (8, 8, 8), _R)
    return sample.node_points((16, 16, 16), spark).select(*AXES, F.when(inside, 1.0).otherwise(0.0).alias("value"))


_SEVEN = " + ".join(f"({_d2(f'i + {a}', f'j + {b}', f'k + {c}')} <= 1.0000001)::INT" for a, b, c in [(0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)])


@query(
    f"""WITH {_GRID16}, c AS (SELECT *, {_SEVEN} AS n FROM g), s(o) AS (SELECT -0.5 + x / 9.0 FROM range(10) t(x)),
  p AS (SELECT i, j, k, sum(({_d2('i + a.o', 'j + b.o', 'k + d.o')} <= 1.0000001)::INT) / 1000.0 AS f FROM c, s a, s b, s d WHERE n BETWEEN 1 AND 6 GROUP BY i, j, k)
SELECT c.i, c.j, c.k, round(CASE n WHEN 7 THEN 1.0 WHEN 0 THEN 0.0 ELSE f END, 6) + 0 AS value FROM c LEFT JOIN p ON c.i = p.i AND c.j = p.j AND c.k = p.k"""
)
def phantom_partial(spark, sf_dir):
    return phantoms.ellipsoid(spark, G16, byte_store=False).select(*AXES, r6(F.col("value")).alias("value"))


def _moved(axis: int, x="i", y="j", z="k") -> str:
    m = _SHIFT[axis]
    return f"({float(m[0])!r}::DOUBLE * {x} + {float(m[1])!r}::DOUBLE * {y} + {float(m[2])!r}::DOUBLE * {z} + {float(m[3])!r}::DOUBLE)"


_PTS = f"p AS (SELECT vol, i, j, k, {_moved(0)} AS x, {_moved(1)} AS y, {_moved(2)} AS z FROM v)"
_NN = "x >= -0.5 AND x < 3.5 AND y >= -0.5 AND y < 3.5 AND z >= -0.5 AND z < 3.5"
_NEAR = f"""nn AS (SELECT p.vol, p.i, p.j, p.k, c.value FROM (SELECT vol, i, j, k, CAST(floor(x + 0.5) AS INTEGER) AS a, CAST(floor(y + 0.5) AS INTEGER) AS b, CAST(floor(z + 0.5) AS INTEGER) AS d FROM p WHERE {_NN}) p
  JOIN v c ON c.vol = p.vol AND c.i = p.a AND c.j = p.b AND c.k = p.d)"""


def _points(spark, sf_dir):
    v = volumes(spark, sf_dir)
    return v, v.select("vol", *AXES, (F.col("i") * 16 + F.col("j") * 4 + F.col("k")).alias("pid"), *(c.alias(n) for c, n in zip(affine(_SHIFT, *AXES), sample.XYZ, strict=True)))


def _sampled(spark, sf_dir, how):
    v, p = _points(spark, sf_dir)
    return how(p, v, (4, 4, 4), "value", ("vol",)).select("vol", *AXES, r6(F.col("value")).alias("value"))


@query(f"WITH {V}, {_PTS}, {_NEAR} SELECT vol, i, j, k, round(nn.value, 6) + 0 AS value FROM p LEFT JOIN nn USING (vol, i, j, k)")
def nn_resample(spark, sf_dir):
    return _sampled(spark, sf_dir, sample.nearest)


def _weighted(weight: dict[int, str], cond: str, name: str) -> str:
    """Sums over the voxels around each point, named by their offsets."""
    at = lambda t, x: t.replace("t", f"({x} - floor({x}))")
    w = " * ".join(f"CASE o{a} " + " ".join(f"WHEN {d} THEN {at(e, x)}" for d, e in weight.items()) + " END" for a, x in zip(AXES, "xyz", strict=True))
    offsets = f"(VALUES {', '.join(f'({d})' for d in weight)})"
    grid = ", ".join(f"{offsets} t{a}(o{a})" for a in AXES)
    where = ", ".join(f"CAST(floor({x}) + o{a} AS INTEGER) AS n{a}" for a, x in zip(AXES, "xyz", strict=True))
    return f"""{name}w AS (SELECT vol, i, j, k, {where}, {w} AS w FROM p, {grid} WHERE {cond}),
  {name} AS (SELECT n.vol, n.i, n.j, n.k, sum(c.value * w) AS s FROM {name}w n JOIN v c ON c.vol = n.vol AND c.i = n.ni AND c.j = n.nj AND c.k = n.nk GROUP BY ALL)"""


_LIN = _weighted({0: "(1 - t)", 1: "t"}, " AND ".join(f"{x} >= 0 AND {x} < 3" for x in "xyz"), "l")
_CUB = _weighted({-1: "((-t + 2*t*t - t*t*t) / 2)", 0: "((2 - 5*t*t + 3*t*t*t) / 2)", 1: "((t + 4*t*t - 3*t*t*t) / 2)", 2: "((t*t*t - t*t) / 2)"}, " AND ".join(f"{x} >= 1 AND {x} < 2" for x in "xyz"), "q")


@query(f"WITH {V}, {_PTS}, {_NEAR}, {_LIN} SELECT vol, i, j, k, round(coalesce(l.s, nn.value), 6) + 0 AS value FROM p LEFT JOIN nn USING (vol, i, j, k) LEFT JOIN l USING (vol, i, j, k)")
def trilinear_resample(spark, sf_dir):
    return _sampled(spark, sf_dir, sample.trilinear)


@query(f"WITH {V}, {_PTS}, {_NEAR}, {_LIN}, {_CUB} SELECT vol, i, j, k, round(coalesce(q.s, l.s, nn.value), 6) + 0 AS value FROM p LEFT JOIN nn USING (vol, i, j, k) LEFT JOIN l USING (vol, i, j, k) LEFT JOIN q USING (vol, i, j, k)")
def tricubic_resample(spark, sf_dir):
    return _sampled(spark, sf_dir, sample.tricubic)


@query(f"WITH {V}, {_PTS} SELECT vol, count(*) AS points, 8 * count(*) AS n_rows FROM p WHERE {' AND '.join(f'p.{x} >= 0 AND p.{x} < 3' for x in 'xyz')} GROUP BY vol")
def partial_volume_rows(spark, sf_dir):
    v, p = _points(spark, sf_dir)
    rows = sample.partial_volume(p, v, (4, 4, 4), ("vol",))
    return rows.groupBy("vol").agg(F.countDistinct("pid").alias("points"), F.count("*").alias("n_rows"))


@query(
    """WITH a AS (SELECT c_custkey AS pid, c_acctbal AS x, c_nationkey * 100.0 AS y FROM customer), b AS (SELECT s_acctbal AS x, s_nationkey * 100.0 AS y FROM supplier)
SELECT pid, round(min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))), 6) + 0 AS distance FROM a, b GROUP BY pid"""
)
def nearest_object(spark, sf_dir):
    at = lambda t, key, bal, nation: table(spark, sf_dir, t).select(F.col(key).alias("pid"), F.col(bal).alias("x"), (F.col(nation) * 100.0).alias("y"), F.lit(0.0).alias("z"))
    got = sample.nearest_object(at("customer", "c_custkey", "c_acctbal", "c_nationkey"), at("supplier", "s_suppkey", "s_acctbal", "s_nationkey"), 500.0)
    return got.select("pid", r6(F.col("distance")).alias("distance"))


_STEPS = "x AS (SELECT 'a' AS xfm_id, CAST(c_custkey - (SELECT min(c_custkey) FROM customer) AS INTEGER) AS seq, c_nationkey % 2 = 0 AS invert_flag, c_custkey FROM customer)"


def _steps(spark, sf_dir):
    """The customers as one long list of transform steps."""
    t = table(spark, sf_dir, "customer")
    first = t.agg(F.min("c_custkey").alias("_n"))  # one row
    return t.crossJoin(F.broadcast(first)).select(F.lit("a").alias("xfm_id"), (F.col("c_custkey") - F.col("_n")).cast("int").alias("seq"), (F.col("c_nationkey") % 2 == 0).alias("invert_flag"), "c_custkey")


@query(f"WITH {_STEPS} SELECT xfm_id, seq, invert_flag, c_custkey FROM x UNION ALL SELECT xfm_id, CAST(seq + (SELECT max(seq) + 1 FROM x) AS INTEGER), invert_flag, c_custkey FROM x")
def transform_concat(spark, sf_dir):
    x = _steps(spark, sf_dir)
    return xfmops.concat(x, x)


@query(f"WITH {_STEPS} SELECT xfm_id, CAST((SELECT max(seq) FROM x) - seq AS INTEGER) AS seq, NOT invert_flag AS invert_flag, c_custkey FROM x")
def transform_invert_seq(spark, sf_dir):
    return xfmops.invert(_steps(spark, sf_dir))


@query(f"WITH {_STEPS} SELECT xfm_id, CAST(row_number() OVER (ORDER BY seq) - 1 AS INTEGER) AS seq, invert_flag, c_custkey FROM x WHERE seq IN (0, 1, 3)")
def transform_extract(spark, sf_dir):
    return xfmops.extract(_steps(spark, sf_dir), "0-1,3")


@query("SELECT CAST(r AS INTEGER) AS \"row\", CAST(c AS INTEGER) AS col, round(CAST(d AS DOUBLE), 6) + 0 AS difference FROM (SELECT 0 AS r, 3 AS c, 0.3 AS d UNION ALL SELECT 1, 3, 0.2 UNION ALL SELECT 2, 3, 0.4) WHERE d > 0.25")
def transform_compare(spark, sf_dir):
    a, b = masks.matrix_rows(spark, tr.from_degrees((0.3, -0.2, 0.4))), masks.matrix_rows(spark, np.eye(4))
    return masks.transform_differences(a, b, 0.01, 0.25).select("row", "col", r6(F.col("difference")).alias("difference"))


@query("SELECT CAST(n // 64 AS INTEGER) AS s, CAST((n // 8) % 8 AS INTEGER) AS r, CAST(n % 8 AS INTEGER) AS c, round(CAST(-60.0 + (n // 64) * 16.0 AS DOUBLE), 6) + 0 AS x, round(CAST(-60.0 + ((n // 8) % 8) * 16.0 AS DOUBLE), 6) + 0 AS y, round(CAST(-60.0 + (n % 8) * 16.0 AS DOUBLE), 6) + 0 AS z FROM range(512) t(n)")
def lattice_nodes(spark, sf_dir):
    spec = sample.lattice_of(G16, (16.0, 16.0, 16.0))
    return sample.lattice(spark, spec["start"], spec["step"], spec["count"]).select("s", "r", "c", *(r6(F.col(a)).alias(a) for a in "xyz"))


@query("SELECT p_partkey, CASE WHEN abs(p_size / 20.0) < 1.5 THEN 2 * (p_size / 20.0) ELSE p_size / 20.0 END AS step, CASE WHEN p_retailprice > 1000 THEN 1000 - p_retailprice ELSE 0.0 END AS crop FROM part")
def guess_subsample_and_crop(spark, sf_dir):
    """Subsampling and cropping guessed for every extent."""
    step, extent = F.col("p_size") / 20.0, F.col("p_retailprice")
    return table(spark, sf_dir, "part").select("p_partkey", lattice.guess_subsample(step).alias("step"), lattice.guess_crop(extent, 1000.0).alias("crop"))


@query(f"WITH {V}, {_PTS} SELECT vol, i, j, k, round(x - i, 6) + 0 AS dx, round(y - j, 6) + 0 AS dy, round(z - k, 6) + 0 AS dz, round(sqrt(pow(x - i, 2) + pow(y - j, 2) + pow(z - k, 2)), 6) + 0 AS magnitude FROM p")
def deformation_magnitude(spark, sf_dir):
    _, p = _points(spark, sf_dir)
    field = p.select("vol", *AXES, *((F.col(c) - F.col(a)).alias(d) for c, a, d in zip(sample.XYZ, AXES, stencil.DISPLACEMENT, strict=True)))
    return stencil.magnitude(field).select("vol", *AXES, *(r6(F.col(c)).alias(c) for c in (*stencil.DISPLACEMENT, "magnitude")))


@query(f"WITH {V}, p AS (SELECT vol, i + 0.5 AS x, j + 0.5 AS y, k + 0.5 AS z, i, j, k FROM v WHERE i < 3 AND j < 3 AND k < 3), c AS (SELECT p.vol, p.i, p.j, p.k, avg(v.value) AS value, sum(v.value * CASE WHEN v.i > p.i THEN 0.25 ELSE -0.25 END) AS ddx FROM p JOIN v ON v.vol = p.vol AND v.i IN (p.i, p.i + 1) AND v.j IN (p.j, p.j + 1) AND v.k IN (p.k, p.k + 1) GROUP BY p.vol, p.i, p.j, p.k), w AS (SELECT vol - 1 AS vol, i, j, k, value AS v2 FROM c) SELECT c.vol, c.i, c.j, c.k, round(CASE WHEN abs(ddx) > 0.02 THEN (value - v2) / ddx ELSE 0.0 END, 4) + 0 AS fx FROM c JOIN w USING (vol, i, j, k)")
def optical_flow_vector(spark, sf_dir):
    v = volumes(spark, sf_dir)
    one = F.when(F.col("_i") > F.col("i"), 0.25).otherwise(-0.25)
    nodes = v.where("i < 3 and j < 3 and k < 3").select("vol", *AXES, *((F.col(a) + 0.5).alias(c) for a, c in zip(AXES, sample.XYZ, strict=True)))
    met = sample.corners(nodes, 0, 1, lambda t, d: F.lit(0.5)).join(v.select("vol", *(F.col(a).alias(f"_{a}") for a in AXES), F.col("value").alias("_v")), ["vol", "_i", "_j", "_k"])
    c = met.groupBy("vol", *AXES).agg(F.avg("_v").alias("value"), F.sum(F.col("_v") * one).alias("ddx"))
    other = c.select((F.col("vol") - 1).alias("vol"), *AXES, F.col("value").alias("v2"))
    (fx,) = nonlinear.optical_flow(F.col("value"), F.col("v2"), [F.col("ddx")], 1.0)
    return c.join(other, ["vol", *AXES]).select("vol", *AXES, (F.round(fx, 4) + F.lit(0.0)).alias("fx"))


def _pair(spark):
    one = phantoms.ellipsoid(spark, G16)
    return one, sample.resample(one, G16, G16, tr.from_degrees((5, 2, -6), (-4, 7, 10)))


@query()
def nonlinear_step(spark, sf_dir):
    one, two = _pair(spark)
    return nonlinear.nonlinear_fit(one, G16, two, G16, 32.0, nonlinear.Options(iterations=1, diameter=48.0, sub_nodes=3))[0]


