"""Queries on voxel maps, predicates, points in volumes, neighbourhoods and lattices, with their SQL."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as cx
from ..functions import transforms as tr
from ..model import AXES, Geometry, affine
from ..operators import lattice, masks, measures, nonlinear, sample, scattered, stencil, voxelwise, xfmops
from ..operators.sample import XYZ
from .geometry_queries import G16
from .transform_queries import MATRIX, _matrices, _num, _spread, _typed_steps, _xyz6, _XYZ, _STEPS
from .volume_queries import _DER, _INNER, _RAW, MEANS, V, _box_sql, _field, label_means, query, r6, table, volumes

# --- voxel maps -------------------------------------------------------------------------------------------------------


@query(f"WITH {V} SELECT vol, i, j, k, round((value + 0.5) * 255, 6) + 0 AS voxel, round(value, 6) + 0 AS real FROM v")
def voxel_value_map(spark, sf_dir):
    """Real values to the voxel range and back."""
    v = volumes(spark, sf_dir).withColumn("voxel", voxelwise.to_voxel_value(F.col("value"), (-0.5, 0.5), (0.0, 255.0)))
    return v.select("vol", *AXES, r6(F.col("voxel")).alias("voxel"), r6(voxelwise.to_real_value(F.col("voxel"), (-0.5, 0.5), (0.0, 255.0))).alias("real"))


@query(f"WITH {V} SELECT vol, i, j, k, 0.0::DOUBLE AS value FROM v")
def zero_fill(spark, sf_dir):
    """A volume of zeros of the same shape."""
    return voxelwise.zeros(volumes(spark, sf_dir)).select("vol", *AXES, "value")


@query(
    """WITH x AS (SELECT p_partkey, p_size / 5.0::DOUBLE - 5 AS x FROM part), s AS (SELECT *, 4 / 2.35482 AS s FROM x)
SELECT p_partkey, round(exp(-x * x / (2 * s * s)), 6) + 0 AS height, round(3 * exp(-x * x / (2 * s * s)) / (s * sqrt(2 * pi())), 6) + 0 AS density, CASE WHEN x >= -2 AND x < 2 THEN 0.25::DOUBLE ELSE 0 END AS rect FROM s"""
)
def kernel_shapes(spark, sf_dir):
    """Gaussian height and density, and the rectangle, at many places."""
    x = F.col("p_size") / 5.0 - 5
    return table(spark, sf_dir, "part").select("p_partkey", r6(voxelwise.gaussian_height(x, 4.0)).alias("height"), r6(voxelwise.gaussian_density(x, 4.0, c=3.0)).alias("density"), voxelwise.rect_density(x, 4.0).alias("rect"))


@query(f"WITH {V} SELECT vol, i, j, k, CASE WHEN floor(value * 10) = 1 THEN 0 ELSE CAST(floor(value * 10) AS DOUBLE) END AS value FROM v")
def remove_label(spark, sf_dir):
    """C17: one label set to zero."""
    v = volumes(spark, sf_dir).withColumn("value", F.floor(F.col("value") * 10).cast("double"))
    return voxelwise.remove_label(v, 1.0).select("vol", *AXES, "value")


_COS = tr.rotation(0.2, -0.1, 0.3)


@query(f"WITH {V} SELECT vol, i, j, k, " + ", ".join(f"round(value * ({_num(_COS[r, 0])} + 2 * {_num(_COS[r, 1])} - {_num(_COS[r, 2])}), 6) + 0 AS g{a}" for r, a in enumerate("xyz")) + ", round(value / 7, 6) + 0 AS bx, round(2 * value / 7, 6) + 0 AS \"by\", round(-value / 7, 6) + 0 AS bz FROM v")
def grid_space(spark, sf_dir):
    """C20: displacements along the grid's axes, and back to the world's."""
    g = _field(spark, sf_dir)
    g = g.withColumns(dict(zip(("gx", "gy", "gz"), voxelwise.to_grid_space(*(F.col(c) for c in stencil.DISPLACEMENT), _COS), strict=True)))
    g = g.withColumns(dict(zip(("bx", "by", "bz"), voxelwise.from_grid_space(*(F.col(c) for c in ("gx", "gy", "gz")), _COS), strict=True)))
    return g.select("vol", *AXES, *(r6(F.col(c)).alias(c) for c in ("gx", "gy", "gz")), *(r6(F.col(c) / 7).alias(c) for c in ("bx", "by", "bz")))


@query("SELECT p_partkey, list_filter([CASE WHEN p_partkey % 4 > 0 THEN p_size * 1.0::DOUBLE END, CASE WHEN p_partkey % 3 > 0 THEN p_size / 2.0::DOUBLE END, 7.0::DOUBLE], lambda x: x IS NOT NULL)[1] AS first, 1 + CAST(p_partkey % 4 > 0 AS INTEGER) + CAST(p_partkey % 3 > 0 AS INTEGER) AS n FROM part")
def axis_weights(spark, sf_dir):
    """The weights of axes longer than one."""
    k = F.col("p_partkey")
    sizes = [F.when(k % 4 > 0, 9).otherwise(1), F.when(k % 3 > 0, 5).otherwise(1), F.lit(3)]
    live = voxelwise.live_axes_of([F.col("p_size") * F.lit(1.0), F.col("p_size") / 2.0, F.lit(7.0)], sizes)
    return table(spark, sf_dir, "part").select("p_partkey", F.element_at(live, 1).alias("first"), F.size(live).alias("n"))


@query("SELECT p_partkey, round(CASE WHEN p_size <= 10 THEN 0 WHEN p_size >= 40 THEN 1 ELSE (p_size - 10) / 30.0::DOUBLE END, 6) + 0 AS confidence FROM part")
def confidence(spark, sf_dir):
    """0 to 1 along a straight line between two values."""
    return table(spark, sf_dir, "part").select("p_partkey", r6(voxelwise.confidence(F.col("p_size").cast("double"), 10.0, 40.0)).alias("confidence"))


# --- masks and predicates ---------------------------------------------------------------------------------------------

_MASK = "w AS (SELECT i, j, k, avg(value) AS value FROM v GROUP BY ALL)"


def _mean_volume(spark, sf_dir):
    return volumes(spark, sf_dir).groupBy(*AXES).agg(F.avg("value").alias("value"))


@query(f"WITH {V}, {_MASK}, p AS (SELECT * FROM ({_XYZ[6:-1]})) SELECT pid FROM p JOIN w ON w.value > 0 AND w.i = CAST(floor(x + 0.5) AS INTEGER) AND w.j = CAST(floor(y + 0.5) AS INTEGER) AND w.k = CAST(floor(z + 0.5) AS INTEGER)")
def voxel_mask(spark, sf_dir):
    """Points whose nearest voxel is in the mask; those outside its box go."""
    return masks.not_masked_voxel(_spread(spark, sf_dir), _mean_volume(spark, sf_dir)).select("pid")


@query(f"WITH {V}, {_MASK}, p AS (SELECT * FROM ({_XYZ[6:-1]})) SELECT pid, round(2 * x - 3, 6) + 0 AS x FROM p JOIN w ON w.value > 0 AND w.i = CAST(floor(x + 0.5) AS INTEGER) AND w.j = CAST(floor(y + 0.5) AS INTEGER) AND w.k = CAST(floor(z + 0.5) AS INTEGER)")
def world_mask(spark, sf_dir):
    """The same for points in the world."""
    g = Geometry((4, 4, 4), (2.0, 2.0, 2.0), (-3.0, 1.0, 0.5))
    world = _spread(spark, sf_dir).withColumns({"x": F.col("x") * 2 - 3, "y": F.col("y") * 2 + 1, "z": F.col("z") * 2 + 0.5})
    return masks.not_masked_world(world, _mean_volume(spark, sf_dir), g).select("pid", r6(F.col("x")).alias("x"))


@query(f"WITH {V} SELECT vol, count(*) AS n FROM v WHERE value BETWEEN -0.1 AND 0.1 GROUP BY vol")
def valid_range(spark, sf_dir):
    """Voxels within a closed range."""
    return volumes(spark, sf_dir).where(masks.in_limits(F.col("value"), -0.1, 0.1)).groupBy("vol").agg(F.count("*").alias("n"))


@query(f"WITH p AS (SELECT * FROM ({_XYZ[6:-1]})) SELECT pid FROM p WHERE {' + '.join(f'({c} / 4 - 0.5) * ({c} / 4 - 0.5)' for c in 'xyz')} <= {0.55 * 0.55!r}::DOUBLE")
def ellipsoidal_points(spark, sf_dir):
    """Points within the ellipsoid of a sub-lattice."""
    t = [F.col(c) / 4 - 0.5 for c in XYZ]
    return _spread(spark, sf_dir).where(masks.ellipsoidal(*t)).select("pid")


@query(f"WITH {V}, {MEANS}, {_MASK} SELECT DISTINCT w.i, w.j, w.k FROM w JOIN m USING (i, j, k) WHERE w.value > -0.005 AND m.m > 0.03")
def eligible_nodes(spark, sf_dir):
    """Nodes above a threshold that at least one mask, one for each label, accepts."""
    m = label_means(volumes(spark, sf_dir))
    accepted = m.select(*AXES, F.when(F.col("m") > 0.03, 1).otherwise(0).alias("value"))
    return masks.eligible(_mean_volume(spark, sf_dir), [accepted], threshold=-0.005).select(*AXES)


@query(f"WITH {V}, {_DER} SELECT vol, i, j, k, uu > -1e-9 AND vv > -1e-9 AND ww > -1e-9 AND uu*vv - uv*uv > -1e-9 AND uu*ww - uw*uw > -1e-9 AND vv*ww - vw*vw > -1e-9 AND uu*(vv*ww - vw*vw) - uv*(uv*ww - vw*uw) + uw*(uv*vw - vv*uw) > -1e-9 AS semidefinite, uu < 0 AND uu*vv - uv*uv > 0 AS negative_2d FROM d WHERE {_INNER}")
def semidefinite(spark, sf_dir):
    """Seven minors, and the two of a plane."""
    d = stencil.derivatives(volumes(spark, sf_dir)).where(stencil.interior((4, 4, 4)))
    h = {n: F.col(n) for n in ("uu", "vv", "ww", "uv", "uw", "vw")}
    return d.select("vol", *AXES, masks.positive_semidefinite(h).alias("semidefinite"), masks.negative_definite_2d(h["uu"], h["vv"], h["uv"]).alias("negative_2d"))


_MOM = "s AS (SELECT label, count(*) AS n, avg(i*i) - avg(i)*avg(i) AS xx, avg(i*j) - avg(i)*avg(j) AS xy, avg(i*k) - avg(i)*avg(k) AS xz, avg(j*j) - avg(j)*avg(j) AS yy, avg(j*k) - avg(j)*avg(k) AS yz, avg(k*k) - avg(k)*avg(k) AS zz FROM (SELECT label * 16 + floor(value * 12 + 4) AS label, i, j, k FROM v) GROUP BY label)"


@query(
    f"""WITH {V}, {_MOM}, q AS (SELECT *, (xx + yy + zz) / 3 AS m FROM s), p AS (SELECT *, sqrt((pow(xx - m, 2) + pow(yy - m, 2) + pow(zz - m, 2) + 2 * (xy*xy + xz*xz + yz*yz)) / 6) AS p FROM q),
  d AS (SELECT *, CASE WHEN p > 0 THEN ((xx-m)*((yy-m)*(zz-m) - yz*yz) - xy*(xy*(zz-m) - yz*xz) + xz*(xy*yz - (yy-m)*xz)) / (2*p*p*p) ELSE 0 END AS h FROM p),
  e AS (SELECT *, acos(greatest(least(h, 1), -1)) / 3 AS a FROM d), l AS (SELECT label, n, m + 2*p*cos(a) AS e1, m + 2*p*cos(a + 2*pi()/3) AS e3, m FROM e),
  r AS (SELECT label, n, sqrt(abs(e1)) AS a1, sqrt(abs(3*m - e1 - e3)) AS a2, sqrt(abs(e3)) AS a3 FROM l)
SELECT CAST(label AS BIGINT) AS label, n, round(a1, 5) + 0 AS a1, n BETWEEN 30 AND 2000 AND a1 > 1.05 * a2 AND a2 < 1.05 * a3 AS tube FROM r WHERE n > 20"""
)
def tube_finder(spark, sf_dir):
    """Size and axes of every label, and which of them are tubes."""
    v = volumes(spark, sf_dir).withColumn("value", F.col("label") * 16 + F.floor(F.col("value") * 12 + 4))
    m = measures.label_moments(v.where(F.lit(True)), least=None).where("n > 20")
    axes = cx.symmetric_eigenvalues(*(F.col(f"c{p}") for p in ("xx", "xy", "xz", "yy", "yz", "zz")))
    m = m.withColumns({f"a{k + 1}": F.sqrt(F.abs(e)) for k, e in enumerate(axes)})
    tube = masks.is_tube(F.col("n"), F.col("a1"), F.col("a2"), F.col("a3"), 30, 2000, 1.05)
    return m.select(F.col("label").cast("long").alias("label"), "n", (F.round("a1", 5) + F.lit(0.0)).alias("a1"), tube.alias("tube"))


@query("SELECT p_size, bool_or(p_partkey % 5 NOT IN (0, 3)) AS needed FROM part GROUP BY p_size")
def sub_lattice_needed(spark, sf_dir):
    """Whether any feature of a fit needs a sub-lattice."""
    names = F.array(*map(F.lit, ("opticalflow", "xcorr", "diff", "chamfer", "label")))
    features = table(spark, sf_dir, "part").select("p_size", F.element_at(names, (F.col("p_partkey") % 5 + 1).cast("int")).alias("objective"))
    return features.groupBy("p_size").agg(masks.needs_sub_lattice(features).alias("needed"))


# --- joins of points and volumes --------------------------------------------------------------------------------------


@query(
    f"""WITH {MATRIX}, w AS (SELECT id, id % 10 * 2 - 7.0 AS x, id % 7 * 1.5 + 1 AS y, id % 5 * 3 - 2.0 AS z, m.* EXCLUDE (id) FROM m)
SELECT id, {", ".join(f"round((m{r}0*x + m{r}1*y + m{r}2*z + m{r}3 - ({s})) / {t}, 6) + 0 AS {a}" for r, (a, s, t) in enumerate((("x", 5.0, 1.5), ("y", -4.0, 2.0), ("z", 0.5, -1.0))))} FROM w"""
)
def folded_matrices(spark, sf_dir):
    """E5: voxels of one volume to voxels of another in a single matrix."""
    m = cx.folded(cx.entries(), (2.0, 1.5, 3.0), (-7.0, 1.0, -2.0), (1.5, 2.0, -1.0), (5.0, -4.0, 0.5))
    df = _matrices(spark, sf_dir).withColumns(cx.named(m, "f"))
    at = [(F.col("id") % n).cast("double") for n in (10, 7, 5)]
    return df.select("id", *(r6(c).alias(a) for a, c in zip("xyz", cx.moved(cx.entries("f"), at), strict=True)))


@query(f"WITH {V} SELECT vol, k AS i, i AS j, j AS k, round(value, 6) + 0 AS value FROM v")
def dimension_order(spark, sf_dir):
    """Volumes stored with their axes in another order, brought to x, y, z."""
    stored = volumes(spark, sf_dir).select("vol", F.col("i").alias("d0"), F.col("j").alias("d1"), F.col("k").alias("d2"), "value")
    return lattice.reordered(stored, ("yspace", "zspace", "xspace")).select("vol", *AXES, r6(F.col("value")).alias("value"))


@query(f"WITH {V}, n AS (SELECT a.vol, a.i, a.j, a.k, avg(b.value) AS m FROM v a JOIN v b ON a.vol = b.vol AND abs(a.i - b.i) + abs(a.j - b.j) + abs(a.k - b.k) = 1 GROUP BY a.vol, a.i, a.j, a.k) SELECT vol, i, j, k, round(2.0 * i + 1 + m, 6) + 0 AS x, round(2.0 * j + 2 * m, 6) + 0 AS y, round(2.0 * k - 1 - m, 6) + 0 AS z FROM n")
def mean_warped_position(spark, sf_dir):
    """Nodes moved by their six neighbours' mean displacement."""
    out = stencil.mean_warped_position(_field(spark, sf_dir), (2.0, 2.0, 2.0), (1.0, 0.0, -1.0))
    return out.select("vol", *AXES, *(r6(F.col(f"mean_{c}")).alias(c) for c in XYZ))


_LINE5 = "o5 AS (SELECT -0.5 + n / 4.0::DOUBLE AS o FROM range(5) t(n)), o AS (SELECT a.o AS a, b.o AS b, c.o AS c FROM o5 a, o5 b, o5 c WHERE a.o*a.o + b.o*b.o + c.o*c.o <= 0.55 * 0.55)"


@query(f"WITH {_XYZ}, {_LINE5} SELECT pid, count(*) AS n, round(sum(x + 2 * a), 6) + 0 AS sx, round(sum(pow(y + 3 * b, 2)), 5) + 0 AS syy, round(max(z + 4 * c), 6) + 0 AS mz FROM v, o GROUP BY pid")
def sub_lattice(spark, sf_dir):
    """The points of every node's sub-lattice."""
    p = sample.sub_lattice(_spread(spark, sf_dir), (2.0, 3.0, 4.0), 5)
    return p.groupBy("pid").agg(F.count("*").alias("n"), r6(F.sum("x")).alias("sx"), (F.round(F.sum(F.col("y") ** 2), 5) + F.lit(0.0)).alias("syy"), r6(F.max("z")).alias("mz"))


_SHIFTS = "s AS (SELECT v.*, i.o AS so, v.x + i.o AS tx FROM p v, (VALUES (-1.0::DOUBLE), (0.0), (1.0)) i(o))"


@query(
    f"""WITH {V}, {_MASK}, n AS (SELECT * FROM ({_XYZ[6:-1]})), {_LINE5}, p AS (SELECT pid, x + 1.5 * a AS x, y + 1.5 * b AS y, z + 1.5 * c AS z FROM n, o),
  near AS (SELECT p.*, w.value AS v1 FROM p JOIN w ON w.i = CAST(floor(x + 0.5) AS INTEGER) AND w.j = CAST(floor(y + 0.5) AS INTEGER) AND w.k = CAST(floor(z + 0.5) AS INTEGER)),
  s AS (SELECT near.*, t.o AS so, row_number() OVER () AS q FROM near, (VALUES (-1.0::DOUBLE), (0.0), (1.0)) t(o)),
  c AS (SELECT q, pid, so, v1, CAST(floor(x + so) AS INTEGER) + a.d AS i, CAST(floor(y) AS INTEGER) + b.d AS j, CAST(floor(z) AS INTEGER) + e.d AS k,
    CASE a.d WHEN 0 THEN 1 - (x + so - floor(x + so)) ELSE x + so - floor(x + so) END * CASE b.d WHEN 0 THEN 1 - (y - floor(y)) ELSE y - floor(y) END * CASE e.d WHEN 0 THEN 1 - (z - floor(z)) ELSE z - floor(z) END AS w
    FROM s, (VALUES (0), (1)) a(d), (VALUES (0), (1)) b(d), (VALUES (0), (1)) e(d) WHERE x + so >= 0 AND x + so < 3 AND y >= 0 AND y < 3 AND z >= 0 AND z < 3),
  g AS (SELECT q, pid, so, any_value(v1) AS v1, sum(c.w * w.value) AS v2 FROM c JOIN w ON w.i = c.i AND w.j = c.j AND w.k = c.k GROUP BY q, pid, so)
SELECT pid, so AS shift, count(*) AS n, round(-avg(abs(v1 - v2)), 6) + 0 AS similarity FROM g GROUP BY pid, so"""
)
def shifted_similarity(spark, sf_dir):
    """Sub-lattices sampled in the source and, at several offsets, in the target; a similarity for each node and offset."""
    nodes = _spread(spark, sf_dir).groupBy("pid", *XYZ).agg(F.count("*").alias("copies"))  # also deals a single file's nodes out to all tasks
    got = sample.shifted_similarity(nodes, _mean_volume(spark, sf_dir), (4, 4, 4), (1.5, 1.5, 1.5), 5, (-1, 0, 1))
    return got.select("pid", "shift", (F.col("n") * F.col("copies")).alias("n"), r6(F.col("similarity")).alias("similarity"))


_LIN4 = tr.from_degrees((0.4, -0.3, 0.2), (4, -6, 3))


@query(f"WITH {_XYZ} SELECT pid, {', '.join(f'round({_num(_LIN4[r, 0])} * x + {_num(_LIN4[r, 1])} * y + {_num(_LIN4[r, 2])} * z + {_num(_LIN4[r, 3])}, 6) + 0 AS {a}' for r, a in enumerate('xyz'))} FROM v")
def target_lattice(spark, sf_dir):
    """Source points through the transform."""
    return _xyz6(sample.target_lattice(_spread(spark, sf_dir), _LIN4))


@query(
    f"""WITH {V}, {_MASK}, n AS (SELECT * FROM ({_XYZ[6:-1]})), t AS (SELECT pid, x + coalesce(w.value, 0) AS x, y + 2 * coalesce(w.value, 0) AS y, z - coalesce(w.value, 0) AS z
  FROM n LEFT JOIN w ON w.i = CAST(floor(x + 0.5) AS INTEGER) AND w.j = CAST(floor(y + 0.5) AS INTEGER) AND w.k = CAST(floor(z + 0.5) AS INTEGER))
SELECT pid, {', '.join(f'round({_num(_LIN4[r, 0])} * x + {_num(_LIN4[r, 1])} * y + {_num(_LIN4[r, 2])} * z + {_num(_LIN4[r, 3])}, 6) + 0 AS {a}' for r, a in enumerate('xyz'))} FROM t"""
)
def target_lattice_fine(spark, sf_dir):
    """The same with the displacement of a fine field's nearest node; the linear part alone outside it."""
    fine = _mean_volume(spark, sf_dir).select(*AXES, F.col("value").alias("dx"), (F.col("value") * 2).alias("dy"), (-F.col("value")).alias("dz"))
    return _xyz6(sample.target_lattice(_spread(spark, sf_dir), _LIN4, fine, Geometry((4, 4, 4))))


_SEG = "g AS (SELECT s_acctbal / 10 AS x1, s_nationkey * 40.0::DOUBLE AS y1, s_suppkey % 50 * 5.0::DOUBLE AS z1, s_acctbal / 10 + 30 AS x2, s_nationkey * 40.0::DOUBLE + 25 AS y2, s_suppkey % 50 * 5.0::DOUBLE - 20 AS z2 FROM supplier)"
_PT = "c AS (SELECT c_custkey AS pid, c_acctbal / 10 AS x, c_nationkey * 40.0::DOUBLE AS y, c_custkey % 50 * 5.0::DOUBLE AS z FROM customer)"


def _customers(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("pid"), (F.col("c_acctbal") / 10).alias("x"), (F.col("c_nationkey") * 40.0).alias("y"), (k % 50 * 5.0).alias("z"))


@query(
    f"""WITH {_SEG}, {_PT}, t AS (SELECT pid, x, y, z, g.*, greatest(least(((x-x1)*(x2-x1) + (y-y1)*(y2-y1) + (z-z1)*(z2-z1)) / (pow(x2-x1, 2) + pow(y2-y1, 2) + pow(z2-z1, 2)), 1), 0) AS t FROM c, g)
SELECT pid, round(min(sqrt(pow(x - x1 - t*(x2-x1), 2) + pow(y - y1 - t*(y2-y1), 2) + pow(z - z1 - t*(z2-z1), 2))), 6) + 0 AS distance FROM t GROUP BY pid"""
)
def nearest_line(spark, sf_dir):
    """Every point's distance to its nearest segment."""
    k, x, y = F.col("s_suppkey"), F.col("s_acctbal") / 10, F.col("s_nationkey") * 40.0
    z = k % 50 * 5.0
    lines = table(spark, sf_dir, "supplier").select(x.alias("x1"), y.alias("y1"), z.alias("z1"), (x + 30).alias("x2"), (y + 25).alias("y2"), (z - 20).alias("z2"))
    return sample.nearest_line(_customers(spark, sf_dir), lines, 60.0).select("pid", r6(F.col("distance")).alias("distance"))


@query(
    f"""WITH {MATRIX} SELECT id, {", ".join(f"round(m{r}3 + least(-m{r}0, 2*m{r}0) + least(0, 3*m{r}1) + least(-2*m{r}2, m{r}2), 6) + 0 AS lo{a}, round(m{r}3 + greatest(-m{r}0, 2*m{r}0) + greatest(0, 3*m{r}1) + greatest(-2*m{r}2, m{r}2), 6) + 0 AS hi{a}" for r, a in enumerate("xyz"))} FROM m"""
)
def bounds_transform(spark, sf_dir):
    """The bounds of a box's corners after every transform."""
    low, high = cx.moved_bounds(cx.entries(), [F.lit(x) for x in (-1.0, 0.0, -2.0)], [F.lit(x) for x in (2.0, 3.0, 1.0)])
    return _matrices(spark, sf_dir).select("id", *(r6(c).alias(f"lo{a}") for a, c in zip("xyz", low, strict=True)), *(r6(c).alias(f"hi{a}") for a, c in zip("xyz", high, strict=True)))


_IN3 = " AND ".join(f"{c} >= 0 AND {c} < 3" for c in "xyz")
_CORNER = f"""c8 AS (SELECT pid, CAST(floor(x) AS INTEGER) + a.d AS i, CAST(floor(y) AS INTEGER) + b.d AS j, CAST(floor(z) AS INTEGER) + e.d AS k, x - floor(x) AS u, y - floor(y) AS t, z - floor(z) AS s, a.d AS p, b.d AS q, e.d AS r
  FROM n, (VALUES (0), (1)) a(d), (VALUES (0), (1)) b(d), (VALUES (0), (1)) e(d) WHERE {_IN3}), f8 AS (SELECT *, CASE p WHEN 1 THEN u ELSE 1 - u END AS wx, CASE q WHEN 1 THEN t ELSE 1 - t END AS wy, CASE r WHEN 1 THEN s ELSE 1 - s END AS wz FROM c8)"""
_N = f"n AS (SELECT * FROM ({_XYZ[6:-1]}))"


@query(f"WITH {V}, {_MASK}, {_N}, {_CORNER}, g AS (SELECT pid, sum(wx * wy * wz * w.value) AS g FROM f8 JOIN w USING (i, j, k) GROUP BY pid) SELECT pid, round(coalesce(g, -1.0), 6) + 0 AS value, g IS NULL AS outside FROM n LEFT JOIN g USING (pid)")
def point_value(spark, sf_dir):
    """the trilinear value of every point, the most negative number outside."""
    got = sample.point_value(_spread(spark, sf_dir), _mean_volume(spark, sf_dir), (4, 4, 4))
    out = F.col("sample") == sample.OUTSIDE
    return got.select("pid", r6(F.when(out, -1.0).otherwise(F.col("sample"))).alias("value"), out.alias("outside"))


def _cubic(t: str, d: str) -> str:
    return f"(CASE {d} WHEN -1 THEN (-{t} + 2*{t}*{t} - {t}*{t}*{t}) / 2 WHEN 0 THEN (2 - 5*{t}*{t} + 3*{t}*{t}*{t}) / 2 WHEN 1 THEN ({t} + 4*{t}*{t} - 3*{t}*{t}*{t}) / 2 ELSE ({t}*{t}*{t} - {t}*{t}) / 2 END)"


_FOUR = "(VALUES (-1), (0), (1), (2))"


@query(
    f"""WITH {V}, {_MASK}, {_N}, c AS (SELECT pid, CAST(floor(x) AS INTEGER) + a.d AS i, CAST(floor(y) AS INTEGER) + b.d AS j, CAST(floor(z + 0.5) AS INTEGER) AS k, {_cubic("(x - floor(x))", "a.d")} * {_cubic("(y - floor(y))", "b.d")} AS f
  FROM n, {_FOUR} a(d), {_FOUR} b(d) WHERE x >= 1 AND x < 2 AND y >= 1 AND y < 2 AND z >= -0.5 AND z < 3.5), g AS (SELECT pid, sum(f * w.value) AS g FROM c JOIN w USING (i, j, k) GROUP BY pid)
SELECT pid, round(g, 6) + 0 AS value FROM n LEFT JOIN g USING (pid)"""
)
def bicubic_slice(spark, sf_dir):
    """cubic interpolation within the nearest slice."""
    return sample.bicubic_slice(_spread(spark, sf_dir), _mean_volume(spark, sf_dir), (4, 4, 4)).select("pid", r6(F.col("sample")).alias("value"))


_NEARW = "LEFT JOIN w ON w.i = CAST(floor(x + 0.5) AS INTEGER) AND w.j = CAST(floor(y + 0.5) AS INTEGER) AND w.k = CAST(floor(z + 0.5) AS INTEGER) AND x < 3.5 AND y < 3.5 AND z < 3.5"


@query(f"WITH {V}, {_MASK}, {_N}, {_CORNER}, g AS (SELECT pid, sum(wx * wy * wz * w.value) AS g FROM f8 JOIN w USING (i, j, k) GROUP BY pid), d AS (SELECT n.pid, coalesce(g, w.value, 0) AS d, x, y, z FROM n LEFT JOIN g USING (pid) {_NEARW}) SELECT pid, round(x + d, 6) + 0 AS x, round(y + 2 * d, 6) + 0 AS y, round(z - d, 6) + 0 AS z FROM d")
def grid_forward(spark, sf_dir):
    """Points moved by a grid's displacement at them."""
    fine = _mean_volume(spark, sf_dir).select(*AXES, F.col("value").alias("dx"), (F.col("value") * 2).alias("dy"), (-F.col("value")).alias("dz"))
    return _xyz6(xfmops.grid_forward(_spread(spark, sf_dir), fine, Geometry((4, 4, 4))))


@query(f"WITH {_XYZ} SELECT pid, round(x - 0.25, 6) + 0 AS x, round(y + 0.5, 6) + 0 AS y, round(z - 0.125, 6) + 0 AS z FROM v")
def grid_inverse(spark, sf_dir):
    """The inverse of a grid by fixed-point steps; of one that moves all nodes alike, the way back."""
    wide = Geometry((12, 12, 12), (1.0, 1.0, 1.0), (-4.0, -4.0, -4.0))
    f = sample.node_points(wide.size, spark).select(*AXES, F.lit(0.25).alias("dx"), F.lit(-0.5).alias("dy"), F.lit(0.125).alias("dz"))
    return _xyz6(xfmops.grid_inverse(_spread(spark, sf_dir), f, wide))


@query(f"WITH {V}, {_MASK}, {_N}, {_CORNER}, g AS (SELECT pid, sum(wx*wy*wz*w.value) AS v, sum((2*p-1)*wy*wz*w.value) AS a, sum(wx*(2*q-1)*wz*w.value) AS b, sum(wx*wy*(2*r-1)*w.value) AS c FROM f8 JOIN w USING (i, j, k) GROUP BY pid) SELECT pid, round(v, 6) + 0 AS value, round(a, 6) + 0 AS ddx, round(b, 6) + 0 AS ddy, round(c, 6) + 0 AS ddz FROM n LEFT JOIN g USING (pid)")
def value_and_derivatives(spark, sf_dir):
    """trilinear values with their derivatives."""
    got = sample.value_and_derivatives(_spread(spark, sf_dir), _mean_volume(spark, sf_dir), (4, 4, 4))
    return got.select("pid", *(r6(F.col(c)).alias(c) for c in ("value", "ddx", "ddy", "ddz")))


def _quad(c: str, d: str) -> str:
    u = f"({c} - floor({c} + 0.5) + 0.5)"
    return f"(CASE {d} WHEN -1 THEN (1 - {u}) * (1 - {u}) / 2 WHEN 0 THEN (1 + 2*{u} - 2*{u}*{u}) / 2 ELSE {u}*{u} / 2 END)"


_THREE = "(VALUES (-1), (0), (1))"
_QUADRATIC = f"""c3 AS (SELECT pid, CAST(floor(x + 0.5) AS INTEGER) + a.d AS i, CAST(floor(y + 0.5) AS INTEGER) + b.d AS j, CAST(floor(z + 0.5) AS INTEGER) + e.d AS k, {_quad("x", "a.d")} * {_quad("y", "b.d")} * {_quad("z", "e.d")} AS f
  FROM n, {_THREE} a(d), {_THREE} b(d), {_THREE} e(d) WHERE {" AND ".join(f"{c} >= 0.5 AND {c} < 2.5" for c in "xyz")}), q AS (SELECT pid, sum(f * w.value) AS q FROM c3 JOIN w USING (i, j, k) GROUP BY pid)"""


@query(f"WITH {V}, {_MASK}, {_N}, {_CORNER}, g AS (SELECT pid, sum(wx * wy * wz * w.value) AS g FROM f8 JOIN w USING (i, j, k) GROUP BY pid), {_QUADRATIC} SELECT n.pid, round(coalesce(q, g, w.value), 6) + 0 AS quadratic, round(w.value, 6) + 0 AS nearest FROM n LEFT JOIN g USING (pid) LEFT JOIN q USING (pid) {_NEARW}")
def evaluate_degrees(spark, sf_dir):
    """Evaluation by degree, in voxels and in the world; the quadratic one falls back to linear, then nearest."""
    v, p, g = _mean_volume(spark, sf_dir), _spread(spark, sf_dir), Geometry((4, 4, 4), (2.0, 2.0, 2.0), (-3.0, 1.0, 0.5))
    near = sample.evaluate(p, v, (4, 4, 4), -1, "nearest")
    world = near.withColumns({"x": F.col("x") * 2 - 3, "y": F.col("y") * 2 + 1, "z": F.col("z") * 2 + 0.5})
    got = sample.evaluate_world(world, v, g, 1, "quadratic")
    return got.select("pid", r6(F.col("quadratic")).alias("quadratic"), r6(F.col("nearest")).alias("nearest"))


def _super_sql(name: str, source: str, axis: str) -> str:
    others = [a for a in AXES if a != axis]
    w = f"WINDOW q AS (PARTITION BY vol, {', '.join(others)} ORDER BY {axis})"
    cols = lambda e: ", ".join(f"CAST({e} AS INTEGER) AS {axis}" if a == axis else a for a in AXES)
    return f"""{name}w AS (SELECT vol, i, j, k, value, lag(value) OVER q AS a, lead(value) OVER q AS c, lead(value, 2) OVER q AS d FROM {source} {w}),
  {name} AS (SELECT vol, {cols(f'2 * {axis}')}, value FROM {name}w UNION ALL SELECT vol, {cols(f'2 * {axis} + 1')}, coalesce((-a + 9 * value + 9 * c - d) / 16, (value + c) / 2) FROM {name}w WHERE c IS NOT NULL)"""


@query(f"WITH {V}, {_super_sql('s1', 'v', 'i')}, {_super_sql('s2', 's1', 'j')}, {_super_sql('s3', 's2', 'k')} SELECT vol, i, j, k, round(value, 6) + 0 AS value FROM s3")
def supersample_3d(spark, sf_dir):
    """twice the nodes less one along all axes."""
    return stencil.supersample(volumes(spark, sf_dir), (4, 4, 4)).select("vol", *AXES, r6(F.col("value")).alias("value"))


@query(f"WITH {V}, p AS (SELECT vol * 4 + k AS vol, i, j, CAST(0 AS INTEGER) AS k, value FROM v), {_super_sql('s1', 'p', 'i')}, {_super_sql('s2', 's1', 'j')} SELECT vol, i, j, k, round(value, 6) + 0 AS value FROM s2")
def supersample_2d(spark, sf_dir):
    """fields with one axis of length one."""
    flat = volumes(spark, sf_dir).select((F.col("vol") * 4 + F.col("k")).alias("vol"), "i", "j", F.lit(0).alias("k"), "value")
    return stencil.supersample(flat, (4, 4, 1)).select("vol", *AXES, r6(F.col("value")).alias("value"))


@query("SELECT * FROM (VALUES ('x', 7, 1.0::DOUBLE, -2.0::DOUBLE), ('y', 1, 3.0, 5.0), ('z', 9, -0.5, 0.0)) t(axis, size, step, start)")
def supersample_geometry(spark, sf_dir):
    """half the step and twice the nodes less one; axes of length one stay."""
    g = stencil.supersampled_geometry(Geometry((4, 1, 5), (2.0, 3.0, -1.0), (-2.0, 5.0, 0.0)))
    return spark.createDataFrame([(a, int(n), float(s), float(b)) for a, n, s, b in zip("xyz", g.size, g.step, g.start, strict=True)], "axis string, size int, step double, start double")


# --- measures ---------------------------------------------------------------------------------------------------------


@query(
    f"""WITH {V}, {MEANS}, n AS (SELECT vol * 64 + i * 16 + j * 4 + k AS pid, vol, label, value AS v1, i + 0.5 * value AS x, j + value AS y, k - 0.5 * value AS z FROM v), {_CORNER.replace("SELECT pid,", "SELECT pid, label, vol, v1,")},
  g AS (SELECT pid, any_value(vol) AS vol, any_value(v1) AS value, sum(wx * wy * wz * m) AS v2 FROM f8 JOIN m USING (label, i, j, k) GROUP BY pid)
SELECT vol, count(*) AS n, round(1 - {_RAW.format(a='value', b='v2')}, 6) + 0 AS objective FROM g GROUP BY vol"""
)
def xcorr_through_field(spark, sf_dir):
    """Correlation of volumes with their label's mean, seen through a deformation."""
    v = volumes(spark, sf_dir)
    means = label_means(v).select("label", *AXES, F.col("m").alias("value"))
    d = {"x": F.col("i") + 0.5 * F.col("value"), "y": F.col("j") + F.col("value"), "z": F.col("k") - 0.5 * F.col("value")}
    points = v.select(((F.col("vol") * 64) + F.col("i") * 16 + F.col("j") * 4 + F.col("k")).alias("pid"), "vol", "label", F.col("value").alias("v1"), *(c.alias(n) for n, c in d.items()))
    got = sample.trilinear(points.where(sample.inside_linear((4, 4, 4))), means, (4, 4, 4), "v2", ("label",))
    return got.groupBy("vol").agg(F.count("*").alias("n"), r6(measures.xcorr(F.col("v1"), F.col("v2"))).alias("objective"))


@query(f"WITH {V}, {MEANS} SELECT vol, round(max(abs(value - m)), 6) + 0 AS similarity FROM v JOIN m USING (label, i, j, k) GROUP BY vol")
def registered_objective(spark, sf_dir):
    """An objective of one's own, registered by name."""
    measures.register_objective("largest", lambda a, b: F.max(F.abs(a - b)))
    v = volumes(spark, sf_dir)
    both = v.join(label_means(v), ["label", *AXES])
    return both.groupBy("vol").agg(r6(measures.LOCAL["largest"](F.col("value"), F.col("m"))).alias("similarity"))


_ABS = "(SELECT label, vol, i * 2.0::DOUBLE - 1 AS i, j * 3.0::DOUBLE AS j, k * -1.0::DOUBLE + 2 AS k, abs(value) AS value FROM v)"


@query(f"WITH {V} SELECT label, round(sum(i*value)/sum(value), 6) + 0 AS cx, round(sum(j*value)/sum(value), 6) + 0 AS cy, round(sum(k*value)/sum(value), 6) + 0 AS cz, round(sum(i*i*value)/sum(value) - pow(sum(i*value)/sum(value), 2), 6) + 0 AS cxx, round(sum(j*k*value)/sum(value) - sum(j*value)/sum(value) * (sum(k*value)/sum(value)), 6) + 0 AS cyz FROM {_ABS} GROUP BY label")
def cog_and_covariance(spark, sf_dir):
    """World centre and covariance in one pass."""
    g = Geometry((4, 4, 4), (2.0, 3.0, -1.0), (-1.0, 0.0, 2.0))
    at = affine(g.to_world(), *AXES)
    v = volumes(spark, sf_dir).withColumn("value", F.abs("value"))
    out = v.groupBy("label").agg(*measures.centre_of_gravity(*at, F.col("value")), *measures.covariance(*at, F.col("value")))
    return out.select("label", *(r6(F.col(c)).alias(c) for c in ("cx", "cy", "cz", "cxx", "cyz")))


@query(f"WITH {V}, n AS (SELECT vol, s, r, c, v.value FROM v JOIN (SELECT CAST(a.n AS INTEGER) AS s, CAST(b.n AS INTEGER) AS r, CAST(d.n AS INTEGER) AS c FROM range(2) a(n), range(2) b(n), range(2) d(n)) ON i = 2 * s + 1 AND j = 2 * r + 1 AND k = 2 * c + 1) SELECT vol, min(s) AS min_s, max(s) AS max_s, min(r) AS min_r, max(r) AS max_r, min(c) AS min_c, max(c) AS max_c FROM n WHERE value > 0.05 GROUP BY vol")
def lattice_box(spark, sf_dir):
    """First and last live node of a lattice over every volume."""
    g = Geometry((4, 4, 4))
    spec = sample.lattice_of(g, (2.0, 2.0, 2.0))
    nodes = sample.lattice(spark, spec["start"], spec["step"], spec["count"])
    at = nodes.select("s", "r", "c", *(F.floor(F.col(x) + 0.5).cast("int").alias(a) for a, x in zip(AXES, XYZ, strict=True)))
    live = volumes(spark, sf_dir).join(F.broadcast(at), list(AXES)).where("value > 0.05")  # eight nodes
    return live.groupBy("vol").agg(*(f(c).alias(f"{n}_{c}") for c in ("s", "r", "c") for n, f in (("min", F.min), ("max", F.max))))


@query("SELECT user_id, round(sum(value), 4) + 0 AS k1, round(sum(value * value), 3) + 0 AS k2 FROM events GROUP BY user_id")
def kernel_sums(spark, sf_dir):
    """Sums and sums of squares of kernels."""
    out = table(spark, sf_dir, "events").groupBy("user_id").agg(*measures.kernel_sums(F.col("value")))
    return out.select("user_id", (F.round("k1", 4) + F.lit(0.0)).alias("k1"), (F.round("k2", 3) + F.lit(0.0)).alias("k2"))


@query(f"WITH {V} SELECT vol, round(max(sqrt(6 * value * value)), 6) + 0 AS largest FROM v GROUP BY vol")
def largest_magnitude(spark, sf_dir):
    """The largest displacement of every field."""
    return stencil.magnitude(_field(spark, sf_dir)).groupBy("vol").agg(r6(F.max("magnitude")).alias("largest"))


@query("WITH p AS (SELECT c_nationkey AS object, c_custkey AS pos, min(c_custkey) OVER w AS a, max(c_custkey) OVER w AS b FROM customer WINDOW w AS (PARTITION BY c_nationkey)) SELECT object, pos FROM p WHERE pos NOT IN (a, b)")
def object_ends(spark, sf_dir):
    """Points of objects without the first and the last."""
    p = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("object"), F.col("c_custkey").alias("pos"))
    return sample.without_ends(p)


@query(
    f"""WITH {_PT}, e AS (SELECT *, c_nationkey AS g FROM c JOIN customer ON c_custkey = pid), i AS (SELECT *, min(pid) OVER (PARTITION BY g) AS a, max(pid) OVER (PARTITION BY g) AS b FROM e),
  t AS (SELECT s_acctbal / 10 AS u, s_nationkey * 40.0::DOUBLE AS v, s_suppkey % 50 * 5.0::DOUBLE AS w FROM supplier), d AS (SELECT g, pid, min(sqrt(pow(x-u, 2) + pow(y-v, 2) + pow(z-w, 2))) AS d FROM i, t WHERE pid NOT IN (a, b) GROUP BY g, pid)
SELECT g AS object, count(*) AS n, round(sqrt(avg(d * d)), 5) + 0 AS rms FROM d GROUP BY g"""
)
def object_distance(spark, sf_dir):
    """Root mean square distance of each object's inner points to the nearest target."""
    objects = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("object"), F.col("c_custkey").alias("pos"))
    inner = sample.without_ends(objects).join(_customers(spark, sf_dir), F.col("pos") == F.col("pid"))
    k = F.col("s_suppkey")
    targets = table(spark, sf_dir, "supplier").select((F.col("s_acctbal") / 10).alias("x"), (F.col("s_nationkey") * 40.0).alias("y"), (k % 50 * 5.0).alias("z"))
    d = sample.nearest_object(inner.select("object", "pid", *XYZ), targets)
    return d.groupBy("object").agg(F.count("*").alias("n"), (F.round(sample.rms(d), 5) + F.lit(0.0)).alias("rms"))


# --- scattered data ---------------------------------------------------------------------------------------------------

_NODES = "s AS (SELECT s_suppkey AS node, s_acctbal / 10 AS u, s_nationkey * 40.0::DOUBLE AS v, s_suppkey % 50 * 5.0::DOUBLE AS w FROM supplier)"
_KNN = f"{_PT}, {_NODES}, k AS (SELECT pid, node, sqrt(pow(x-u, 2) + pow(y-v, 2) + pow(z-w, 2)) AS d FROM c, s), q AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY d, node) AS r FROM k)"


def _suppliers(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("node"), (F.col("s_acctbal") / 10).alias("x"), (F.col("s_nationkey") * 40.0).alias("y"), (k % 50 * 5.0).alias("z"), (k % 3 - 1.0).alias("dx"), (k % 5).cast("double").alias("dy"), (F.col("s_nationkey") / 10.0).alias("dz"))


@query(f"WITH {_KNN} SELECT pid, CAST(r AS INTEGER) AS rank, node, round(d, 6) + 0 AS distance FROM q WHERE r <= 4")
def scattered_nearest(spark, sf_dir):
    """The four nodes nearest to every point, found through cells."""
    near = scattered.nearest_nodes(_customers(spark, sf_dir), _suppliers(spark, sf_dir), 4)
    return near.select("pid", "rank", "node", r6(F.col("distance")).alias("distance"))


@query(f"WITH {_KNN}, b AS (SELECT q.*, s_suppkey % 3 - 1.0::DOUBLE AS dx, s_nationkey / 10.0::DOUBLE AS dz FROM q JOIN supplier ON s_suppkey = node WHERE r <= 4) SELECT pid, round(CASE WHEN min(d) = 0 THEN avg(dx) FILTER (WHERE d = 0) ELSE sum(dx / d) / sum(1 / d) END, 6) + 0 AS dx, round(CASE WHEN min(d) = 0 THEN avg(dz) FILTER (WHERE d = 0) ELSE sum(dz / d) / sum(1 / d) END, 6) + 0 AS dz FROM b GROUP BY pid")
def scattered_displacement(spark, sf_dir):
    """Displacements of points by the inverse distance of their four nearest nodes."""
    out = scattered.interpolate_displacement(_customers(spark, sf_dir), _suppliers(spark, sf_dir), 4)
    return out.select("pid", r6(F.col("dx")).alias("dx"), r6(F.col("dz")).alias("dz"))


# --- neighbourhoods ---------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, CAST(pow(2, ceil(log2(p_size))) AS BIGINT) AS n FROM part")
def next_power_of_two(spark, sf_dir):
    """H7: the next power of two."""
    return table(spark, sf_dir, "part").select("p_partkey", stencil.next_power_of_two(F.col("p_size")).alias("n"))


_N6 = "n AS (SELECT a.vol, a.i, a.j, a.k, avg(b.value) AS m FROM v a JOIN v b ON a.vol = b.vol AND abs(a.i - b.i) + abs(a.j - b.j) + abs(a.k - b.k) = 1 GROUP BY a.vol, a.i, a.j, a.k)"


@query(f"WITH {V}, {_N6} SELECT vol, i, j, k, round(value + (m - value) * 0.3, 6) + 0 AS iso, round(value + (m - value) * 0.5 * 0.9, 6) + 0 AS dx, round(2 * value + 2 * (m - value) * 0.5 * 0.5, 6) + 0 AS dy, round(-value - (m - value) * 0.5 * 0.2, 6) + 0 AS dz FROM v JOIN n USING (vol, i, j, k)")
def local_smoothing(spark, sf_dir):
    """Towards the neighbours' mean, alike in all directions and by confidence along axes."""
    m = stencil.neighbour_mean(_field(spark, sf_dir), stencil.DISPLACEMENT, 6)
    axes = [[F.lit(float(a == b)) for b in range(3)] for a in range(3)]
    moved = stencil.anisotropic_smooth(m, [F.lit(0.1), F.lit(0.5), F.lit(0.8)], axes, 0.5)
    return m.select("vol", *AXES, r6(stencil.isotropic_smooth(0.3)["dx"]).alias("iso"), *(r6(c).alias(n) for n, c in moved.items()))


@query(f"WITH {V}, w AS (SELECT vol - 1 AS vol, i, j, k, value AS o FROM v) SELECT v.vol, i, j, k, round(value + 0.5 * coalesce(o, 0), 6) + 0 AS dx, round(2 * value + coalesce(o, 0), 6) + 0 AS dy FROM v LEFT JOIN w USING (vol, i, j, k)")
def add_warps(spark, sf_dir):
    """A weighted additional field added to the current one."""
    f = _field(spark, sf_dir).drop("estimated")
    return stencil.add_warps(f.withColumn("vol", F.col("vol") - 1), f, 0.5).select("vol", *AXES, r6(F.col("dx")).alias("dx"), r6(F.col("dy")).alias("dy"))


@query(
    f"""WITH {V}, b AS (SELECT a.vol, a.i, a.j, a.k, sum(b.value * (b.i - a.i)) / 6 AS u, sum(b.value * (b.j - a.j)) / 6 AS v, sum(b.value * CASE WHEN b.i = a.i THEN -2 ELSE 1 END) / 3 AS uu, sum(b.value * CASE WHEN b.j = a.j THEN -2 ELSE 1 END) / 3 AS vv, sum(b.value * (b.i - a.i) * (b.j - a.j)) / 4 AS uv
  FROM v a JOIN v b ON a.vol = b.vol AND a.k = b.k AND b.i BETWEEN a.i - 1 AND a.i + 1 AND b.j BETWEEN a.j - 1 AND a.j + 1 GROUP BY a.vol, a.i, a.j, a.k HAVING count(*) = 9)
SELECT vol, i, j, k, {", ".join(f"round({n}, 6) + 0 AS {n}" for n in ("u", "v", "uu", "vv", "uv"))}, round(CASE WHEN u*u + v*v > 0 THEN (2*u*v*uv - u*u*vv - v*v*uu) / pow(u*u + v*v, 1.5) END, 4) + 0 AS curvature FROM b"""
)
def derivatives_2d(spark, sf_dir):
    """Derivatives within slices, and the curvature of level lines."""
    d = stencil.derivatives_2d(volumes(spark, sf_dir)).where("uv is not null")
    c = stencil.principal_curvature_2d(*(F.col(n) for n in ("u", "v", "uu", "vv", "uv")))
    return d.select("vol", *AXES, *(r6(F.col(n)).alias(n) for n in ("u", "v", "uu", "vv", "uv")), (F.round(c, 4) + F.lit(0.0)).alias("curvature"))


_LVV = "CASE WHEN u*u + v*v + w*w > 1e-12 THEN -0.5 * (u*u*(vv + ww) + v*v*(uu + ww) + w*w*(uu + vv) - 2*(u*v*uv + u*w*uw + v*w*vw)) / sqrt(u*u + v*v + w*w) ELSE 0.0 END"


@query(f"WITH {V}, {_DER}, t AS (SELECT vol, max(value) * 0.01 AS t FROM v GROUP BY vol), l AS (SELECT d.vol, i, j, k, {_LVV} AS l FROM d JOIN t ON t.vol = d.vol WHERE {_INNER} AND value > t), b AS (SELECT vol, min(l) * 0.9 AS a, max(l) * 0.9 AS b FROM l GROUP BY vol) SELECT l.vol, i, j, k, round(least(greatest(l, least(a, b)), greatest(a, b)), 6) + 0 AS lvv FROM l JOIN b ON b.vol = l.vol")
def lvv_volume(spark, sf_dir):
    """Lvv of the brighter interior voxels, clamped to nine tenths of its range."""
    return stencil.lvv_volume(volumes(spark, sf_dir), (4, 4, 4)).select("vol", *AXES, r6(F.col("lvv")).alias("lvv"))


@query(
    f"""WITH {V}, {_DER}, m AS (SELECT *, u*u + v*v + w*w AS m FROM d WHERE {_INNER}),
  c AS (SELECT vol, i, j, k, (u*u*(vv*ww - vw*vw) + v*v*(uu*ww - uw*uw) + w*w*(uu*vv - uv*uv) + 2*(u*v*(uw*vw - uv*ww) + v*w*(uv*uw - vw*uu) + u*w*(uv*vw - uw*vv))) / (m*m) AS g,
    (u*u*(vv + ww) + v*v*(uu + ww) + w*w*(uu + vv) - 2*(u*v*uv + u*w*uw + v*w*vw)) / (2 * pow(m, 1.5)) AS h FROM m WHERE m > 0.01)
SELECT vol, i, j, k, round(g, 3) + 0 AS gauss, round(h, 4) + 0 AS mean, round(h + sqrt(greatest(h*h - g, 0)), 4) + 0 AS k1, round(h - sqrt(greatest(h*h - g, 0)), 4) + 0 AS k2 FROM c"""
)
def principal_curvatures(spark, sf_dir):
    """Gaussian, mean and principal curvatures of level surfaces."""
    d = stencil.derivatives(volumes(spark, sf_dir)).where(stencil.interior((4, 4, 4))).where("u*u + v*v + w*w > 0.01")
    found = stencil.principal_curvatures()
    return d.select("vol", *AXES, *((F.round(found[n], 3 if n == "gauss" else 4) + F.lit(0.0)).alias(n) for n in ("gauss", "mean", "k1", "k2")))


_POW = {"xx": ("i", "i"), "xy": ("i", "j"), "xz": ("i", "k"), "yy": ("j", "j"), "yz": ("j", "k"), "zz": ("k", "k")}


@query(
    f"""WITH {V}, p AS (SELECT vol, i, j, k, abs(value) + 0.1 AS value FROM v), b AS (SELECT a.vol, a.i, a.j, a.k, sum(b.value) AS s, {", ".join(f"sum(b.value * (b.{a} - a.{a})) AS s{a}" for a in AXES)}, {", ".join(f"sum(b.value * (b.{x} - a.{x}) * (b.{y} - a.{y})) AS s{n}" for n, (x, y) in _POW.items())}
  FROM p a JOIN p b ON a.vol = b.vol AND {_box_sql(1)} GROUP BY a.vol, a.i, a.j, a.k HAVING count(*) = 27), c AS (SELECT vol, i, j, k, {", ".join(f"s{n}/s - s{x}/s * (s{y}/s) AS {n}" for n, (x, y) in _POW.items())} FROM b)
SELECT vol, i, j, k, {", ".join(f"round({n}, 6) + 0 AS c{n}" for n in _POW)}, round(xx + yy + zz, 6) + 0 AS total, round(xx*xx + yy*yy + zz*zz + 2*(xy*xy + xz*xz + yz*yz), 6) + 0 AS squares, round(xx*(yy*zz - yz*yz) - xy*(xy*zz - yz*xz) + xz*(xy*yz - yy*xz), 6) + 0 AS product, true AS sorted FROM c"""
)
def local_pca(spark, sf_dir):
    """Covariance of the 27 values around a voxel and its eigenvalues, held by their sum, squares and product."""
    out = stencil.local_pca(volumes(spark, sf_dir).withColumn("value", F.abs("value") + 0.1))
    e = [F.col(f"e{n}") for n in (1, 2, 3)]
    held = {"total": e[0] + e[1] + e[2], "squares": cx.dot(e, e), "product": e[0] * e[1] * e[2]}
    return out.select("vol", *AXES, *(r6(F.col(f"c{n}")).alias(f"c{n}") for n in _POW), *(r6(c).alias(n) for n, c in held.items()), ((e[0] >= e[1] - 1e-9) & (e[1] >= e[2] - 1e-9)).alias("sorted"))


_SEMI = "uu > -1e-9 AND vv > -1e-9 AND ww > -1e-9 AND uu*vv - uv*uv > -1e-9 AND uu*ww - uw*uw > -1e-9 AND vv*ww - vw*vw > -1e-9 AND uu*(vv*ww - vw*vw) - uv*(uv*ww - vw*uw) + uw*(uv*vw - vv*uw) > -1e-9"


@query(f"WITH {V}, {_DER} SELECT vol, i, j, k, round(uu + vv + ww, 5) + 0 AS total, round(uu*uu + vv*vv + ww*ww + 2*(uv*uv + uw*uw + vw*vw), 5) + 0 AS squares, true AS sorted FROM d WHERE {_INNER} AND {_SEMI}")
def hessian_eigen(spark, sf_dir):
    """Eigenvalues of semidefinite Hessians, held by their sum and squares."""
    out = stencil.local_eigen(volumes(spark, sf_dir))
    e = [F.col(f"e{n}") for n in (1, 2, 3)]
    r5 = lambda c: F.round(c, 5) + F.lit(0.0)
    return out.select("vol", *AXES, r5(e[0] + e[1] + e[2]).alias("total"), r5(cx.dot(e, e)).alias("squares"), ((e[0] >= e[1]) & (e[1] >= e[2])).alias("sorted"))


_DET = "(uu*(vv*ww - vw*vw) - uv*(uv*ww - vw*uw) + uw*(uv*vw - vv*uw))"


@query(
    f"""WITH {V}, {_DER}, n AS (SELECT vol, i, j, k, -u AS u, -v AS v, -w AS w, -uu AS uu, -vv AS vv, -ww AS ww, -uv AS uv, -uw AS uw, -vw AS vw FROM d WHERE {_INNER}), s AS (SELECT *, uu > 0 AND uu*vv - uv*uv > 0 AND {_DET} > 0 AS good,
  -((vv*ww - vw*vw)*u + (uw*vw - uv*ww)*v + (uv*vw - uw*vv)*w) / {_DET} AS du, -((uw*vw - uv*ww)*u + (uu*ww - uw*uw)*v + (uv*uw - uu*vw)*w) / {_DET} AS dv, -((uv*vw - uw*vv)*u + (uv*uw - uu*vw)*v + (uu*vv - uv*uv)*w) / {_DET} AS dw FROM n)
SELECT vol, i, j, k, round(du, 4) + 0 AS du, round(dv, 4) + 0 AS dv, round(dw, 4) + 0 AS dw FROM s WHERE good AND sqrt(du*du + dv*dv + dw*dw) < 2"""
)
def quadratic_max_3d(spark, sf_dir):
    """The step to the maximum of a quadratic fit."""
    d = stencil.derivatives(volumes(spark, sf_dir)).where(stencil.interior((4, 4, 4)))
    return d.select("vol", *AXES, *((F.round(c, 4) + F.lit(0.0)).alias(n) for n, c in stencil.quadratic_step(-1.0).items())).where("du is not null")


@query(f"WITH {V}, {_DER}, s AS (SELECT vol, i, j, k, uu < 0 AND uu*vv - uv*uv > 0 AS good, -(vv*u - uv*v) / (uu*vv - uv*uv) AS du, -(uu*v - uv*u) / (uu*vv - uv*uv) AS dv FROM d WHERE {_INNER}) SELECT vol, i, j, k, round(du, 4) + 0 AS du, round(dv, 4) + 0 AS dv FROM s WHERE good AND sqrt(du*du + dv*dv) < 2")
def quadratic_max_2d(spark, sf_dir):
    """The same within a slice."""
    d = stencil.derivatives(volumes(spark, sf_dir)).where(stencil.interior((4, 4, 4)))
    return d.select("vol", *AXES, *((F.round(c, 4) + F.lit(0.0)).alias(n) for n, c in stencil.quadratic_step_2d(-1.0).items())).where("du is not null")


# --- order ------------------------------------------------------------------------------------------------------------


@query(
    """WITH s AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber) AS r, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
SELECT l_orderkey, max(CASE WHEN r = 1 THEN f END) AS best, max(CASE WHEN r = n THEN f END) AS worst, max(CASE WHEN r = greatest(n - 1, 1) THEN f END) AS next_worst FROM s GROUP BY l_orderkey"""
)
def simplex_ranks(spark, sf_dir):
    """Best, worst and next-worst vertex of every simplex."""
    w = Window.partitionBy("l_orderkey")
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("f"))
    r = t.withColumns({"r": F.row_number().over(w.orderBy("f", "l_linenumber")), "n": F.count("*").over(w)})
    pick = lambda c: F.max(F.when(c, F.col("f")))
    return r.groupBy("l_orderkey").agg(pick(F.col("r") == 1).alias("best"), pick(F.col("r") == F.col("n")).alias("worst"), pick(F.col("r") == F.greatest(F.col("n") - 1, F.lit(1))).alias("next_worst"))


@query(f"WITH {V}, c AS (SELECT *, i * 16 + j * 4 + k AS p FROM v), r AS (SELECT *, row_number() OVER (PARTITION BY vol ORDER BY value, p) AS a, row_number() OVER (PARTITION BY vol ORDER BY value DESC, p) AS b FROM c) SELECT vol, CAST(max(CASE WHEN a = 1 THEN p END) AS INTEGER) AS lowest, CAST(max(CASE WHEN b = 1 THEN p END) AS INTEGER) AS highest FROM r GROUP BY vol")
def extreme_cells(spark, sf_dir):
    """The cells of the smallest and the largest value, the first of equal ones."""
    return measures.extreme_cells(volumes(spark, sf_dir), (4, 4, 4)).select("vol", "lowest", "highest")


@query("SELECT vec_id, list_min(embedding) AS low, list_max(embedding) AS high, embedding[1:32] = embedding[33:64] AS same, len(embedding) AS n FROM embeddings")
def array_extremes(spark, sf_dir):
    """Smallest and largest of arrays, and whether two are alike."""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_min(e).alias("low"), F.array_max(e).alias("high"), (F.slice(e, 1, 32) == F.slice(e, 33, 32)).alias("same"), F.size(e).cast("long").alias("n"))


# --- fields -----------------------------------------------------------------------------------------------------------


@query(f"WITH {V} SELECT vol, i, j, k, round(value * 0.4, 6) + 0 AS dx, round(0.8 * value, 6) + 0 AS dy, round(-0.4 * value, 6) + 0 AS dz FROM v")
def scale_field(spark, sf_dir):
    """A part of every displacement."""
    return xfmops.scale_field(_field(spark, sf_dir), 0.4).select("vol", *AXES, *(r6(F.col(c)).alias(c) for c in stencil.DISPLACEMENT))


@query("SELECT CAST(9 * 9 * 1 AS BIGINT) AS n, 9 AS nx, 9 AS ny, 1 AS nz, -9.0::DOUBLE AS x, -2.5::DOUBLE AS y, 5.0::DOUBLE AS z, 0.0::DOUBLE AS largest")
def new_field(spark, sf_dir):
    """Zeros on a lattice five nodes wider, shifted by half of that; axes of length one stay."""
    field, g = xfmops.new_field(spark, Geometry((4, 4, 1), (4.0, 1.0, 2.0), (1.0, 0.0, 5.0)))
    size = F.lit(g.size[0]), F.lit(g.size[1]), F.lit(g.size[2])
    return field.agg(F.count("*").alias("n"), *(F.any_value(s).alias(a) for s, a in zip(size, ("nx", "ny", "nz"), strict=True)), *(F.any_value(F.lit(float(b))).alias(a) for b, a in zip(g.start, XYZ, strict=True)), F.max(F.greatest("dx", "dy", "dz")).alias("largest"))


_BIG = "g AS (SELECT CAST(n // 36 AS INTEGER) AS i, CAST((n // 6) % 6 AS INTEGER) AS j, CAST(n % 6 AS INTEGER) AS k FROM range(216) t(n)), w AS (SELECT *, 2.0::DOUBLE * i - 5 AS x, 2.0::DOUBLE * j - 5 AS y, 2.0::DOUBLE * k - 5 AS z FROM g)"
_GRID6 = Geometry((6, 6, 6), (2.0, 2.0, 2.0), (-5.0, -5.0, -5.0))


@query(f"WITH {_BIG} SELECT i, j, k, {', '.join(f'round({_num(_LIN4[r, 0])} * x + {_num(_LIN4[r, 1])} * y + {_num(_LIN4[r, 2])} * z + {_num(_LIN4[r, 3])} - {a}, 6) + 0 AS d{a}' for r, a in enumerate('xyz'))} FROM w")
def resample_field(spark, sf_dir):
    """A transform as a field on a lattice."""
    out = xfmops.resample_field(spark, _GRID6, [{"type": "Linear", "matrix": _LIN4}])
    return out.select(*AXES, *(r6(F.col(c)).alias(c) for c in stencil.DISPLACEMENT))


@query(f"WITH {_BIG} SELECT i, j, k, -0.25::DOUBLE AS dx, 0.5::DOUBLE AS dy, -0.125::DOUBLE AS dz FROM w")
def reverse_field(spark, sf_dir):
    """The inverse of a field, as a field; of one that moves all nodes alike, the way back."""
    wide = Geometry((20, 20, 20), (1.0, 1.0, 1.0), (-10.0, -10.0, -10.0))
    f = sample.node_points(wide.size, spark).select(*AXES, F.lit(0.25).alias("dx"), F.lit(-0.5).alias("dy"), F.lit(0.125).alias("dz"))
    return xfmops.reverse_field(spark, f, wide, _GRID6).select(*AXES, *(r6(F.col(c)).alias(c) for c in stencil.DISPLACEMENT))


@query(f"WITH {_BIG} SELECT i, j, k, round(0.1 * x * x - 0.05 * y * z, 6) + 0 AS dx, round(sin(y / 3), 6) + 0 AS dy, round(0.2 * z, 6) + 0 AS dz FROM w")
def test_field(spark, sf_dir):
    """A field from a formula."""
    x, y, z = (F.col(c) for c in XYZ)
    out = xfmops.field_of(spark, _GRID6, {"dx": 0.1 * x * x - 0.05 * y * z, "dy": F.sin(y / 3), "dz": 0.2 * z})
    return out.select(*AXES, *(r6(F.col(c)).alias(c) for c in stencil.DISPLACEMENT))


# --- lattices and bounds ----------------------------------------------------------------------------------------------

_EXT = "e AS (SELECT p_partkey AS id, p_size * 1.5::DOUBLE - 30 AS a, p_size * 1.5::DOUBLE - 30 + (p_partkey % 41 - 20) * 1.25 AS b, CASE WHEN p_partkey % 2 = 0 THEN 2.0::DOUBLE ELSE -1.5 END AS s FROM part)"


def _extents(spark, sf_dir):
    k, a = F.col("p_partkey"), F.col("p_size") * 1.5 - 30
    return table(spark, sf_dir, "part").select(k.alias("id"), a.alias("a"), (a + (k % 41 - 20) * 1.25).alias("b"), F.when(k % 2 == 0, 2.0).otherwise(-1.5).alias("s"))


@query(f"WITH {_EXT}, o AS (SELECT id, s, CASE WHEN (b - a) * s < 0 THEN b ELSE a END AS a, CASE WHEN (b - a) * s < 0 THEN a ELSE b END AS b FROM e) SELECT id, round(a, 6) + 0 AS first, round(a + s * ceil(abs((b - a) / s) - 1e-9), 6) + 0 AS last FROM o")
def fix_bounds(spark, sf_dir):
    """K5: extents rounded up to whole steps, in the step's direction."""
    first, last = lattice.fixed_bounds(F.col("a"), F.col("b"), F.col("s"))
    return _extents(spark, sf_dir).select("id", r6(first).alias("first"), r6(last).alias("last"))


@query(f"WITH {_EXT}, w AS (SELECT *, CASE WHEN b >= a THEN 1 ELSE -1 END AS d FROM e) SELECT id, round(a - d * abs(b - a) * 0.1, 6) + 0 AS pa, round(b + d * abs(b - a) * 0.1, 6) + 0 AS pb, round(a - d * 5.0, 6) + 0 AS ma, round(b + d * 2 * abs(s), 6) + 0 AS vb FROM w")
def modify_bounds(spark, sf_dir):
    """K6: bounds moved outwards by percent, millimetres and voxels."""
    a, b, s = F.col("a"), F.col("b"), F.col("s")
    percent, mixed = lattice.modified_bounds(a, b, s, "10%", "10%"), lattice.modified_bounds(a, b, s, "5mm", "2v")
    return _extents(spark, sf_dir).select("id", r6(percent[0]).alias("pa"), r6(percent[1]).alias("pb"), r6(mixed[0]).alias("ma"), r6(mixed[1]).alias("vb"))


@query(f"WITH {_EXT} SELECT id, round(ceil(3 * greatest(8.0, abs(a)) / 2.35482 / abs(s)) * abs(s), 6) + 0 AS pad, round(3 * abs(a) / 2.35482, 6) + 0 AS unpad FROM e")
def pad_amounts(spark, sf_dir):
    """K9: three sigmas of the widest blur, up to whole steps."""
    fwhm = F.abs("a")
    return _extents(spark, sf_dir).select("id", r6(lattice.pad_amount([F.lit(8.0), fwhm], F.col("s"))).alias("pad"), r6(lattice.unpad_amounts([fwhm])[0]).alias("unpad"))


@query("SELECT * FROM (VALUES ('volume', 'x', -8.0::DOUBLE, 12.0::DOUBLE), ('volume', 'y', 5.0, -4.0), ('standard', 'x', -72.0, 72.0), ('standard', 'z', -44.0, 80.0), ('box', 'x', -4.0, 4.0), ('box', 'y', 4.0, -1.0)) t(source, axis, first, last)")
def bounds_sources(spark, sf_dir):
    """K4: bounds of a volume, of the standard space and of a bounding box."""
    g = Geometry((11, 10, 5), (2.0, -1.0, 3.0), (-8.0, 5.0, 0.0))
    volume, box = lattice.volume_bounds(g), lattice.box_bounds({"min_i": 2, "max_i": 6, "min_j": 1, "max_j": 6, "min_k": 0, "max_k": 1}, g)
    rows = [("volume", "x", *volume[0]), ("volume", "y", *volume[1]), ("standard", "x", *lattice.STANDARD_BOX[0]), ("standard", "z", *lattice.STANDARD_BOX[2]), ("box", "x", *box[0]), ("box", "y", *box[1])]
    return spark.createDataFrame([(a, b, float(c), float(d)) for a, b, c, d in rows], "source string, axis string, first double, last double")


@query("SELECT c_nationkey AS g, min(c_acctbal) AS x_first, max(c_acctbal) AS x_last, CAST(min(c_custkey) AS DOUBLE) AS y_first, CAST(max(c_custkey) AS DOUBLE) AS y_last FROM customer GROUP BY 1")
def tag_bounds(spark, sf_dir):
    """K4: bounds of landmarks."""
    tags = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("g"), F.col("c_acctbal").alias("x"), F.col("c_custkey").cast("double").alias("y"), F.lit(0.0).alias("z"))
    return lattice.point_bounds(tags, "g").select("g", "x_first", "x_last", "y_first", "y_last")


@query(f"WITH {V}, b AS (SELECT vol, (max(i) - min(i) + 1) * (max(j) - min(j) + 1) * (max(k) - min(k) + 1) AS n FROM v WHERE value > 0.15 GROUP BY vol), c AS (SELECT vol - 1 AS vol, n AS m FROM b) SELECT vol, m < n AS target, CASE WHEN m < n THEN 0.3::DOUBLE ELSE 0.1 END AS threshold FROM b JOIN c USING (vol)")
def smallest_lattice(spark, sf_dir):
    """K2: which of two volumes' live boxes is smaller and drives, with its threshold first."""
    boxes = volumes(spark, sf_dir).where("value > 0.15").groupBy("vol").agg(*measures.bounding_box(0.15))
    size = (F.col("max_i") - F.col("min_i") + 1) * (F.col("max_j") - F.col("min_j") + 1) * (F.col("max_k") - F.col("min_k") + 1)
    b = boxes.select("vol", size.alias("n"))
    both = b.join(b.select((F.col("vol") - 1).alias("vol"), F.col("n").alias("m")), "vol")
    target, threshold = lattice.chosen_lattice(F.col("n"), F.col("m"), False, 0.1, 0.3)
    return both.select("vol", target.alias("target"), threshold.alias("threshold"))


@query("SELECT * FROM (VALUES ('close', 3, 'identity'), ('far', 10, 'est_translations')) t(preset, simplex, start)")
def fit_presets(spark, sf_dir):
    """The simplex and start of the fit distances."""
    return spark.createDataFrame([(p, lattice.fit_distance(p)["simplex"], lattice.fit_distance(p)["start"]) for p in ("close", "far")], "preset string, simplex int, start string")


@query("SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN false WHEN p_size % 4 = 3 THEN true ELSE p_size % 4 = 1 AND p_size < 30 END AS ok FROM part")
def clamp_options(spark, sf_dir):
    """Clamping needs both limits, in order, or none."""
    m = F.col("p_size") % 4
    low, high = F.when(m < 2, F.lit(1.0)), F.when(m == 1, F.when(F.col("p_size") < 30, 2.0).otherwise(0.5))
    both = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), m.alias("m"), F.when(m == 3, F.lit(None)).otherwise(low).alias("low"), F.when(m == 2, F.lit(3.0)).otherwise(high).alias("high"))
    return both.select("id", lattice.clamp_is_ok(F.col("low"), F.col("high")).alias("ok"))


# --- steps of fits ----------------------------------------------------------------------------------------------------


@query(f"WITH {V}, {_DER}, o AS (SELECT vol - 1 AS vol, i, j, k, value AS v2 FROM v), r AS (SELECT vol, max(value) - min(value) AS r FROM v GROUP BY vol) SELECT vol, i, j, k, {', '.join(f'round(CASE WHEN abs({n}) > 0.02 * r THEN (value - v2) / {n} ELSE 0 END, 3) + 0 AS f{a}' for n, a in zip('uvw', 'xyz', strict=True))} FROM d JOIN o USING (vol, i, j, k) JOIN r USING (vol) WHERE {_INNER}")
def optical_flow(spark, sf_dir):
    """The flow vector of every interior voxel."""
    v = volumes(spark, sf_dir)
    d = stencil.derivatives(v).where(stencil.interior((4, 4, 4)))
    other, spread = v.select((F.col("vol") - 1).alias("vol"), *AXES, F.col("value").alias("v2")), v.groupBy("vol").agg((F.max("value") - F.min("value")).alias("r"))
    flow = nonlinear.optical_flow(F.col("value"), F.col("v2"), [F.col(n) for n in "uvw"], F.col("r"))
    return d.join(other, ["vol", *AXES]).join(spread, "vol").select("vol", *AXES, *((F.round(f, 3) + F.lit(0.0)).alias(f"f{a}") for f, a in zip(flow, "xyz", strict=True)))


@query(f"WITH {V}, {_DER}, n AS (SELECT *, sqrt(u*u + v*v + w*w) AS l FROM d WHERE {_INNER}) SELECT vol, i, j, k, {', '.join(f'round(CASE WHEN value < 3.8 * 0.03 AND l > 0 THEN -value * {n} / l ELSE 0 END, 6) + 0 AS f{a}' for n, a in zip('uvw', 'xyz', strict=True))} FROM n")
def chamfer_vector(spark, sf_dir):
    """Steps against a distance's gradient within its capture range."""
    d = stencil.derivatives(volumes(spark, sf_dir)).where(stencil.interior((4, 4, 4)))
    step = nonlinear.chamfer_step(F.col("value"), [F.col(n) for n in "uvw"], 0.03)
    return d.select("vol", *AXES, *(r6(f).alias(f"f{a}") for f, a in zip(step, "xyz", strict=True)))


@query(f"WITH {V}, {_N6} SELECT vol, i, j, k, round(m - value, 6) + 0 AS sx, round(2 * (m - value), 6) + 0 AS sy, round(value - m, 6) + 0 AS sz FROM v JOIN n USING (vol, i, j, k)")
def start_from_neighbours(spark, sf_dir):
    """Where a node's search starts: what its neighbours' mean has that it hasn't."""
    out = nonlinear.start_from_neighbours(_field(spark, sf_dir))
    return out.select("vol", *AXES, *(r6(F.col(c)).alias(c) for c in ("sx", "sy", "sz")))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'diff' WHEN 2 THEN 'opticalflow' ELSE 'xcorr' END AS objective FROM part")
def nonlinear_objective(spark, sf_dir):
    """Whole names count; anything else is xcorr."""
    names = F.array(*map(F.lit, ("diff", "dif", "opticalflow", "what")))
    return table(spark, sf_dir, "part").select("p_partkey", nonlinear.objective_column(F.element_at(names, (F.col("p_partkey") % 4 + 1).cast("int"))).alias("objective"))


@query("SELECT 'xcorr' AS objective, 4 AS iterations, 0.6::DOUBLE AS weight, 0.5::DOUBLE AS stiffness, 0.5::DOUBLE AS similarity_ratio, 50.0::DOUBLE AS longest, 5 AS sub_nodes, 24.0::DOUBLE AS diameter")
def default_options(spark, sf_dir):
    """What a nonlinear fit is told unless one says otherwise."""
    o = nonlinear.Options()
    return spark.createDataFrame([(o.objective, o.iterations, o.weight, o.stiffness, o.similarity_ratio, o.longest, o.sub_nodes, o.diameter)], "objective string, iterations int, weight double, stiffness double, similarity_ratio double, longest double, sub_nodes int, diameter double")
