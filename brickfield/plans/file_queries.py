"""Queries that write and scan volumes, masks, grids, features, tags, options and logs, or generate volumes, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.transforms import decompose
from ..model import AXES, Geometry
from ..operators import measures, stencil, voxelwise, xfmops
from ..operators.sample import XYZ
from ..sources import files, phantoms, scratch
from .volume_queries import _DER, _INNER, _RAW, MEANS, V, label_means, query, r6, table, volumes


def _means(spark, sf_dir):
    """The mean volume of each label, as volumes of their own."""
    return label_means(volumes(spark, sf_dir)).select(F.col("label").cast("string").alias("vol"), *AXES, F.col("m").alias("value"))


_M = "CAST(label AS VARCHAR) AS vol, i, j, k"


def _voxels6(df):
    return df.select(F.col("vol").cast("string").alias("vol"), *AXES, r6(F.col("value")).alias("value"))


@query(f"WITH {V}, {MEANS} SELECT {_M}, round(m, 6) + 0 AS value FROM m")
def volume_round_trip(spark, sf_dir):
    """Volumes written, unquantised, and scanned again as doubles."""
    path = scratch.fresh_dir(spark, "volume")
    files.write_volume(_means(spark, sf_dir), path)
    return _voxels6(files.read_volume(spark, path))


@query(f"WITH {V}, {MEANS} SELECT {_M} FROM m WHERE m > 0.01")
def mask_scan(spark, sf_dir):
    """A2: of a mask only what is inside is read."""
    path = scratch.fresh_dir(spark, "mask")
    files.write_volume(_means(spark, sf_dir).withColumn("value", (F.col("value") > 0.01).cast("double")), path)
    return files.read_mask(spark, path).select(F.col("vol").cast("string").alias("vol"), *AXES)


@query(f"WITH {V}, {MEANS} SELECT {_M}, CAST(floor(m * 100) AS INTEGER) AS value FROM m")
def label_scan(spark, sf_dir):
    """A3: label volumes keep whole numbers."""
    path = scratch.fresh_dir(spark, "labels")
    files.write_volume(_means(spark, sf_dir).withColumn("value", F.floor(F.col("value") * 100)), path)
    return files.read_volume(spark, path, labels=True).select(F.col("vol").cast("string").alias("vol"), *AXES, "value")


_OPTIONS = ("xcorr", "DI", "sq", "Label", "cham", "corr", "op", "nothing")


@query(
    f"""SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'xcorr' WHEN 1 THEN 'xcorr' WHEN 2 THEN 'diff' WHEN 3 THEN 'sqdiff' WHEN 4 THEN 'label' WHEN 5 THEN 'chamfer' WHEN 6 THEN 'corrcoeff' WHEN 7 THEN 'opticalflow' END AS objective,
  CASE WHEN p_size > 25 THEN p_size / 10.0::DOUBLE ELSE 1.0 END AS weight, 0.0::DOUBLE AS thresh_data FROM part"""
)
def feature_registry(spark, sf_dir):
    """A3, A4: feature pairs with objectives by their first two letters, and defaults."""
    name = F.when(F.col("p_partkey") % 9 > 0, F.element_at(F.array(*map(F.lit, _OPTIONS)), (F.col("p_partkey") % 9).cast("int")))
    pairs = table(spark, sf_dir, "part").select("p_partkey", name.alias("objective"), F.when(F.col("p_size") > 25, F.col("p_size") / 10.0).alias("weight"))
    return files.feature_table(pairs).select("p_partkey", "objective", "weight", "thresh_data")


_GRID = "m AS dx, 2 * m AS dy, -m AS dz"


def _grids(spark, sf_dir):
    m = _means(spark, sf_dir)
    return m.select("vol", *AXES, F.col("value").alias("dx"), (F.col("value") * 2).alias("dy"), (-F.col("value")).alias("dz"))


@query(f"WITH {V}, {MEANS} SELECT {_M}, round(m, 6) + 0 AS dx, round(2 * m, 6) + 0 AS dy, round(-m, 6) + 0 AS dz FROM m")
def deformation_round_trip(spark, sf_dir):
    """A grid as three volumes and back."""
    path = scratch.fresh_dir(spark, "grid")
    files.write_deformation(_grids(spark, sf_dir), path)
    return files.read_deformation(spark, path).select(F.col("vol").cast("string").alias("vol"), *AXES, *(r6(F.col(c)).alias(c) for c in ("dx", "dy", "dz")))


@query(f"WITH {V}, {MEANS} SELECT {_M}, round(2 * m, 6) + 0 AS value FROM m")
def component_split(spark, sf_dir):
    """One component of a grid as a volume."""
    return _voxels6(files.component(_grids(spark, sf_dir), "dy"))


@query(f"WITH {V}, {MEANS} SELECT {_M}, round(m, 6) + 0 AS dx, round(2 * m, 6) + 0 AS dy, round(-m, 6) + 0 AS dz, round(sqrt(6 * m * m), 6) + 0 AS dxyz, round(m / 2, 6) + 0 AS blur FROM m")
def feature_scan(spark, sf_dir):
    """The five blurred features of a base name, joined."""
    g, path = stencil.magnitude(_grids(spark, sf_dir)), scratch.fresh_dir(spark, "features")
    for name, value in {"dx": F.col("dx"), "dy": F.col("dy"), "dz": F.col("dz"), "dxyz": F.col("magnitude"), "blur": F.col("dx") / 2}.items():
        files.write_volume(g.select("vol", *AXES, value.alias("value")), f"{path}_{name}")
    return files.read_features(spark, path).select(F.col("vol").cast("string").alias("vol"), *AXES, *(r6(F.col(c)).alias(c) for c in ("dx", "dy", "dz", "dxyz", "blur")))


@query(f"WITH {V} SELECT vol, i, j, k, CASE WHEN floor(value * 5) = 0 THEN 1e-6::DOUBLE ELSE CAST(floor(value * 5) AS DOUBLE) END AS value FROM v")
def without_zeros(spark, sf_dir):
    """Exact zeros become a very small value."""
    v = volumes(spark, sf_dir).withColumn("value", F.floor(F.col("value") * 5).cast("double"))
    return files.without_zeros(v).select("vol", *AXES, "value")


_TAGS = "SELECT c_nationkey AS nation, c_acctbal AS x1, CAST(c_custkey AS DOUBLE) AS y1, CAST(c_custkey % 7 AS DOUBLE) AS z1, c_acctbal / 2 AS x2, CAST(c_custkey + 1 AS DOUBLE) AS y2, CAST(c_custkey % 5 AS DOUBLE) AS z2, c_mktsegment AS label FROM customer"


@query(f"SELECT nation, round(x1, 6) + 0 AS x1, y1, z1, round(x2, 6) + 0 AS x2, y2, z2, label FROM ({_TAGS})")
def tag_round_trip(spark, sf_dir):
    """Landmark pairs as tag files, one for each nation, and read again."""
    k = F.col("c_custkey")
    whole = lambda c: c.cast("double")
    tags = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("x1"), whole(k).alias("y1"), whole(k % 7).alias("z1"), (F.col("c_acctbal") / 2).alias("x2"), whole(k + 1).alias("y2"), whole(k % 5).alias("z2"), F.col("c_mktsegment").alias("label"))
    path = scratch.fresh_dir(spark, "tags")
    files.write_tag_files(tags, "nation", path)
    out = files.read_tags(spark, path, "nation")
    return out.select(F.col("nation").cast("int").alias("nation"), r6(F.col("x1")).alias("x1"), "y1", "z1", r6(F.col("x2")).alias("x2"), "y2", "z2", "label")


@query("SELECT CAST(c_acctbal AS DOUBLE) AS x1, CAST(c_custkey AS DOUBLE) AS y1, CAST(c_nationkey AS DOUBLE) AS z1, CAST(c_custkey % 7 AS DOUBLE) AS x2, 1.5::DOUBLE AS y2, -2.0::DOUBLE AS z2 FROM customer")
def point_reader(spark, sf_dir):
    """Pairs of points from lines of six numbers."""
    path = scratch.fresh_dir(spark, "points")
    text = F.concat_ws(" ", *(F.col(c).cast("string") for c in ("c_acctbal", "c_custkey", "c_nationkey")), (F.col("c_custkey") % 7).cast("string"), F.lit("1.5 -2"))
    table(spark, sf_dir, "customer").select(text.alias("value")).write.text(path)
    return files.read_points(spark, path)


@query("SELECT CAST(s_suppkey AS DOUBLE) AS x, s_acctbal AS y, 0.0::DOUBLE AS z, CAST(s_nationkey AS DOUBLE) AS dx, 0.25::DOUBLE AS dy, -1.0::DOUBLE AS dz FROM supplier")
def grid_reader(spark, sf_dir):
    """Scattered nodes with displacements from text."""
    path = scratch.fresh_dir(spark, "nodes")
    text = F.concat_ws(" ", F.col("s_suppkey").cast("string"), F.col("s_acctbal").cast("string"), F.lit("0"), F.col("s_nationkey").cast("string"), F.lit("0.25 -1.0"))
    table(spark, sf_dir, "supplier").select(text.alias("value")).write.text(path)
    return files.read_grid_nodes(spark, path)


@query(
    """WITH o AS (SELECT n_regionkey AS f, n_nationkey AS n, 'opt' || (n_nationkey % 7) AS name, n_name || ' ' || n_nationkey AS value FROM nation)
SELECT name, arg_max(value, f * 1000 + n) AS value FROM o GROUP BY name"""
)
def option_files(spark, sf_dir):
    """A10: options of several files; later ones win."""
    k = F.col("n_nationkey")
    line = F.concat(F.lit("-opt"), (k % 7).cast("string"), F.lit(" = "), F.col("n_name"), F.lit(" "), k.cast("string"), F.lit("  # "), F.col("n_name"))
    ordered = F.array_sort(F.collect_list(F.struct(k.alias("n"), line.alias("line"))))
    texts = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("ord")).agg(F.concat(F.lit("# options\n\n"), F.array_join(F.transform(ordered, lambda s: s["line"]), "\n")).alias("text"))
    return files.option_table(texts)


@query("SELECT 'one>>> blur -fwhm 8' || chr(10) || 'two>>> resample -like x' AS history, CAST(count(*) AS BIGINT) AS n FROM embeddings")
def history_note(spark, sf_dir):
    """Command lines that a stored volume carries."""
    path = scratch.fresh_dir(spark, "history")
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("double").alias("value"))
    noted = files.with_history(files.with_history(e, ["blur", "-fwhm", "8"], "one"), ["resample", "-like", "x"], "two")
    noted.write.parquet(path)
    got = spark.read.parquet(path)
    return got.agg(F.lit(files.history_of(got)).alias("history"), F.count("*").alias("n"))


@query(f"WITH {V}, {MEANS} SELECT CAST(t.n AS INTEGER) AS iteration, {_M}, round(m * (t.n + 1), 6) + 0 AS value FROM m, range(3) t(n)")
def iteration_snapshots(spark, sf_dir):
    """The state after each iteration, kept and read back."""
    path, now = scratch.fresh_dir(spark, "snapshots"), _means(spark, sf_dir)
    for n in range(3):
        files.write_snapshot(now.withColumn("value", F.col("value") * (n + 1)), path, n)
    return files.read_snapshots(spark, path).select("iteration", F.col("vol").cast("string").alias("vol"), *AXES, r6(F.col("value")).alias("value"))


@query(
    f"""WITH {V}, {MEANS}, e AS (SELECT vol, count(*) AS points, round(1 - {_RAW.format(a='value', b='m')}, 6) + 0 AS value FROM v JOIN m USING (label, i, j, k) GROUP BY vol)
SELECT CAST(row_number() OVER (ORDER BY vol) AS INTEGER) AS evaluation, vol, points, value, min(value) OVER (ORDER BY vol ROWS UNBOUNDED PRECEDING) AS best FROM e"""
)
def evaluation_log(spark, sf_dir):
    """Evaluations of an objective, numbered, with the best so far. One row for each evaluation."""
    v = volumes(spark, sf_dir)
    both = v.join(label_means(v), ["label", *AXES]).groupBy("vol").agg(F.count("*").alias("points"), r6(measures.xcorr(F.col("value"), F.col("m"))).alias("value"))
    return files.evaluation_log(both, ["vol"], "value").select("evaluation", "vol", "points", "value", "best")


@query(
    f"""WITH o AS (SELECT event_id AS pid, value AS v1, value * 0.8::DOUBLE + event_id % 7 AS v2 FROM events), s AS (SELECT avg(v1) AS m1, stddev_samp(v1) AS s1, avg(v2) AS m2, stddev_samp(v2) AS s2, min(v1) AS lo, max(v1) AS hi FROM o),
  g AS (SELECT floor(1.0 + (v1 - lo) * (256 - 1e-5) / (hi - lo)) AS g, count(*) AS n, var_samp(v1 / v2) AS s FROM o, s WHERE v2 <> 0 GROUP BY 1),
  c AS (SELECT pid, sign(v1 - v2) AS s FROM o), z AS (SELECT *, last_value(CASE WHEN s <> 0 THEN s END IGNORE NULLS) OVER (ORDER BY pid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM c)
SELECT 'zscore' AS name, round(sqrt(sum(pow((v1 - m1) / s1 - (v2 - m2) / s2, 2))) / count(*), 6) + 0 AS value FROM o, s
UNION ALL SELECT 'xcorr', round(1 - {_RAW.format(a='v1', b='v2')}, 6) + 0 FROM o
UNION ALL SELECT 'var_ratio', round(sum(CASE WHEN n > 1 THEN n * s ELSE 0 END) / sum(n), 6) + 0 FROM g
UNION ALL SELECT 'ssc', CAST(-sum(CASE WHEN s = 0 THEN 1 WHEN b IS NOT NULL AND b <> s THEN 1 ELSE 0 END) AS DOUBLE) FROM z"""
)
def measure_sink(spark, sf_dir):
    """The four measures of two aligned volumes as rows."""
    t = table(spark, sf_dir, "events").select(F.col("event_id").alias("pid"), F.col("value").alias("v1"), (F.col("value") * 0.8 + F.col("event_id") % 7).alias("v2"))
    return measures.measures(t, "v1", "v2").select("name", r6(F.col("value")).alias("value"))


@query(f"WITH {V}, {MEANS} SELECT label AS vol, CAST(i * 2 + 1 AS DOUBLE) AS x1, CAST(j * 2 AS DOUBLE) AS y1, CAST(k * 2 - 1 AS DOUBLE) AS z1, round(i * 2.0 + 1 + 3 * m, 6) + 0 AS x2, round(j * 2.0 + 6 * m, 6) + 0 AS y2, round(k * 2.0 - 1 - 3 * m, 6) + 0 AS z2 FROM m")
def vectors_to_lines(spark, sf_dir):
    """An arrow from every node to three times its displacement."""
    g = Geometry((4, 4, 4), (2.0, 2.0, 2.0), (1.0, 0.0, -1.0))
    grids = _grids(spark, sf_dir)
    out = xfmops.field_lines(grids, g, 3.0, keep=("vol",))
    return out.select(F.col("vol").cast("int").alias("vol"), *(r6(F.col(f"{a}1")).alias(f"{a}1") for a in XYZ), *(r6(F.col(f"{a}2")).alias(f"{a}2") for a in XYZ))


@query("SELECT c.c_custkey AS a, c.c_nationkey AS b, c.c_acctbal AS x1, CAST(c.c_custkey % 10 AS DOUBLE) AS y1, n.c_acctbal AS x2, CAST(n.c_custkey % 10 AS DOUBLE) AS y2 FROM customer c JOIN customer n ON n.c_custkey = c.c_nationkey + (SELECT min(c_custkey) FROM customer)")
def tree_to_lines(spark, sf_dir):
    """The segments of a tree from its nodes and edges."""
    c = table(spark, sf_dir, "customer")
    nodes = c.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 10).cast("double").alias("y"), F.lit(0.0).alias("z"))
    low = F.broadcast(c.agg(F.min("c_custkey").alias("_n")))  # one row
    edges = c.crossJoin(low).select(F.col("c_custkey").alias("a"), (F.col("c_nationkey") + F.col("_n")).alias("b"), "_n")
    out = xfmops.tree_lines(nodes, edges)
    return out.select("a", (F.col("b") - F.col("_n")).cast("int").alias("b"), "x1", "y1", "x2", "y2")


_BOX = Geometry((40, 30, 20), (2.0, 2.0, 2.0), (-40.0, -30.0, -20.0))
_AT = "floor((x + 40) / 2 + 0.5) AS i, floor((y + 30) / 2 + 0.5) AS j, floor((z + 20) / 2 + 0.5) AS k"


@query(
    f"""WITH p AS (SELECT p_partkey AS ord, p_size AS label, (p_partkey % 97) - 48.0 AS x, (p_partkey % 71) - 35.0 AS y, (p_partkey % 41) - 20.0 AS z FROM part), v AS (SELECT ord, label, {_AT} FROM p)
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(k AS INTEGER) AS k, arg_max(label, ord) AS value FROM v WHERE i BETWEEN 0 AND 39 AND j BETWEEN 0 AND 29 AND k BETWEEN 0 AND 19 GROUP BY 1, 2, 3"""
)
def rasterise_points(spark, sf_dir):
    """The label of the last object that touches each voxel."""
    k = F.col("p_partkey")
    at = lambda n, o: (k % n - o).cast("double")
    p = table(spark, sf_dir, "part").select(k.alias("ord"), F.col("p_size").alias("label"), at(97, 48).alias("x"), at(71, 35).alias("y"), at(41, 20).alias("z"))
    return xfmops.rasterise(p, _BOX)


_TRI = """t AS (SELECT s_suppkey AS ord, CAST(s_nationkey AS INTEGER) AS label, (s_suppkey % 31) - 15.0 AS x1, (s_suppkey % 23) - 11.0 AS y1, (s_suppkey % 13) - 6.0 AS z1,
  (s_suppkey % 29) - 9.0 AS x2, (s_suppkey % 19) - 3.0 AS y2, (s_suppkey % 7) - 1.0 AS z2, (s_suppkey % 17) - 4.0 AS x3, (s_suppkey % 11) + 3.0 AS y3, (s_suppkey % 5) + 2.0 AS z3 FROM supplier)"""


@query(
    f"""WITH {_TRI}, e AS (SELECT *, CAST(ceil(greatest({", ".join(f"abs({a}{p} - {a}{q})" for a in "xyz" for p, q in ((1, 2), (2, 3), (3, 1)))}, 1) / 1.0) AS INTEGER) AS n FROM t),
  s AS (SELECT *, unnest(range(n + 1)) AS u FROM e), w AS (SELECT *, unnest(range(n - u + 1)) AS v FROM s),
  p AS (SELECT ord, label, {", ".join(f"{a}1 + ({a}2 - {a}1) * (u / n::DOUBLE) + ({a}3 - {a}1) * (v / n::DOUBLE) AS {a}" for a in "xyz")} FROM w), g AS (SELECT ord, label, {_AT} FROM p)
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(k AS INTEGER) AS k, arg_max(label, ord) AS value FROM g WHERE i BETWEEN 0 AND 39 AND j BETWEEN 0 AND 29 AND k BETWEEN 0 AND 19 GROUP BY 1, 2, 3"""
)
def rasterise_surfaces(spark, sf_dir):
    """Voxels touched by the triangles of surfaces."""
    k = F.col("s_suppkey")
    corners = {"x1": (31, 15), "y1": (23, 11), "z1": (13, 6), "x2": (29, 9), "y2": (19, 3), "z2": (7, 1), "x3": (17, 4), "y3": (11, -3), "z3": (5, -2)}
    t = table(spark, sf_dir, "supplier").select(k.alias("ord"), F.col("s_nationkey").cast("int").alias("label"), *((k % n - o).cast("double").alias(c) for c, (n, o) in corners.items()))
    return xfmops.rasterise(xfmops.surface_points(t, 1.0), _BOX)


@query(f"WITH {V}, {_DER}, g AS (SELECT vol, sqrt(u*u + v*v + w*w) AS value FROM d WHERE {_INNER}) SELECT vol, count(*) AS n, round(min(value), 6) + 0 AS low, round(max(value), 6) + 0 AS high FROM g GROUP BY vol")
def gradient_volume_range(spark, sf_dir):
    """A gradient volume written with its range."""
    path = scratch.fresh_dir(spark, "gradient")
    d = stencil.derivatives(volumes(spark, sf_dir)).where(stencil.interior((4, 4, 4)))
    d.select("vol", *AXES, voxelwise.gradient_magnitude(F.col("u"), F.col("v"), F.col("w")).alias("value")).write.parquet(path)
    return spark.read.parquet(path).groupBy("vol").agg(F.count("*").alias("n"), r6(F.min("value")).alias("low"), r6(F.max("value")).alias("high"))


@query(f"WITH {V}, {MEANS}, c AS (SELECT i, j, k, label, m, row_number() OVER (PARTITION BY i, j, k ORDER BY m DESC, label) AS r, max(m) OVER (PARTITION BY i, j, k) AS hi FROM m) SELECT i, j, k, CAST(CASE WHEN hi > 0 THEN label ELSE 0 END AS INTEGER) AS label FROM c WHERE r = 1")
def crisp_volume(spark, sf_dir):
    """Class volumes in an order, the label of the largest value, written and read."""
    m, path = label_means(volumes(spark, sf_dir)), scratch.fresh_dir(spark, "crisp")
    labels = sorted(r[0] for r in m.select("label").distinct().collect())  # one for each class
    pairs = [(m.where(F.col("label") == n).select(*AXES, F.col("m").alias("value")), n) for n in labels]
    measures.argmax_label(files.class_volumes(pairs)).withColumn("vol", F.lit("crisp")).withColumnRenamed("label", "value").write.partitionBy("vol").parquet(path)
    return spark.read.parquet(path).select(*AXES, F.col("value").cast("int").alias("label"))


@query(f"WITH {V} SELECT vol, CAST(max(i) + 1 AS INTEGER) AS ni, CAST(max(j) + 1 AS INTEGER) AS nj, CAST(max(k) + 1 AS INTEGER) AS nk, max(k) = (SELECT max(k) FROM v WHERE vol = (SELECT min(vol) FROM v) AND NOT (vol % 5 = 0 AND k = 3)) AS ok FROM v WHERE NOT (vol % 5 = 0 AND k = 3) GROUP BY vol")
def shape_check(spark, sf_dir):
    """Volumes of another size than the first are told."""
    v = volumes(spark, sf_dir).where("not (vol % 5 = 0 and k = 3)")
    return files.same_shape(v)


# --- generators -------------------------------------------------------------------------------------------------------

_G = Geometry((24, 24, 24), (2.0, 2.0, 2.0), (-24.0, -24.0, -24.0))
_N = 24**3


@query("SELECT * FROM (VALUES ('i', -30.0::DOUBLE, 30.0::DOUBLE, -3.0::DOUBLE, 27.0::DOUBLE), ('j', -40.0, 40.0, -8.0, 32.0), ('k', -15.0, 15.0, 4.5, 19.5)) t(axis, world_min, world_max, voxel_min, voxel_max)")
def phantom_limits(spark, sf_dir):
    """The object's box in the world and in voxels."""
    b = phantoms.object_limits(_G)
    rows = [(a, *(float(b[c][n]) for c in ("world_min", "world_max", "voxel_min", "voxel_max"))) for n, a in enumerate(AXES)]
    return spark.createDataFrame(rows, "axis string, world_min double, world_max double, voxel_min double, voxel_max double")


def _about(df, column, std):
    """Whether values are as many, as wide and as even about 0 as noise of that deviation is; and whether they differ."""
    c = F.col(column)
    return df.agg(F.count("*").alias("n"), (F.abs(F.avg(c)) < 0.05 * std).alias("centred"), (F.abs(F.stddev_samp(c) / std - 1) < 0.05).alias("wide"), (F.approx_count_distinct(c) > F.count("*") / 2).alias("differs"))


_NOISE = f"SELECT CAST({{n}} AS BIGINT) AS n, true AS centred, true AS wide, true AS differs"


@query(_NOISE.format(n=_N))
def random_volume(spark, sf_dir):
    """Gaussian noise; generators have streams of their own, so their moments are held, not their values."""
    return _about(phantoms.gaussian_volume(spark, _G.size, 3.0, 7), "value", 3.0)


@query(f"WITH {V} SELECT count(*) AS n, true AS centred, true AS wide, true AS differs FROM v")
def randomised_volume(spark, sf_dir):
    """Every value replaced by noise within five deviations."""
    out = phantoms.randomised(volumes(spark, sf_dir), 0.5, 3)
    return _about(out.where(F.abs("value") <= 2.5), "value", 0.5)


@query(_NOISE.format(n=3 * _N))
def random_deformation(spark, sf_dir):
    """Random vectors on a grid."""
    d = phantoms.random_deformation(spark, _G.size, 2.0, 5)
    return _about(d.select(F.explode(F.array("dx", "dy", "dz")).alias("value")), "value", 2.0)


@query("SELECT count(*) AS n, true AS same, true AS close FROM part")
def random_tags(spark, sf_dir):
    """Noise on the second point of every pair, none on the first."""
    k = F.col("p_partkey").cast("double")
    tags = table(spark, sf_dir, "part").select(*(k.alias(f"{a}{n}") for n in (1, 2) for a in "xyz"), F.lit("t").alias("label"))
    out = phantoms.random_tags(tags, 0.5, 2)
    moved = F.col("x2") - F.col("x1")
    return out.agg(F.count("*").alias("n"), F.bool_and((F.col("x1") == F.col("y1")) & (F.col("y1") == F.col("z1"))).alias("same"), ((F.abs(F.avg(moved)) < 0.2) & (F.stddev(moved) < 0.7) & (F.stddev(moved) > 0.3)).alias("close"))


@query("SELECT CAST(1 AS BIGINT) AS n, true AS rotations, true AS scales, true AS shifts, true AS uniform, true AS gaussian")
def random_parameters(spark, sf_dir):
    """Parts of a random transform within their limits, and the two number generators."""
    p = decompose(phantoms.random_parameters(4))
    u, g = phantoms.uniform(5000, -1, 3, 2), phantoms.gaussian(5000, 2.0, 2)
    row = (1, bool(np.abs(np.degrees(p.rotations)).max() <= 10.001), bool(np.abs(p.scales - 1).max() <= 0.201), bool(np.abs(p.translations).max() <= 10.001), bool(u.min() >= -1 and u.max() < 3 and abs(u.mean() - 1) < 0.1), bool(abs(g.mean()) < 0.1 and abs(g.std() - 2) < 0.1))
    return spark.createDataFrame([row], "n long, rotations boolean, scales boolean, shifts boolean, uniform boolean, gaussian boolean")


@query(
    """WITH s AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS i, value AS b FROM events),
  n AS (SELECT *, lag(b) OVER w AS a, lead(b) OVER w AS c, lead(b, 2) OVER w AS d FROM s WINDOW w AS (PARTITION BY user_id ORDER BY i))
SELECT user_id, i, round((-a + 9 * b + 9 * c - d) / 16, 6) + 0 AS middle, round((0.25 * a - 2.75 * b + 2.75 * c - 0.25 * d) / 2, 6) + 0 AS slope, round((a - b - c + d) / 2, 6) + 0 AS bend FROM n WHERE a IS NOT NULL AND d IS NOT NULL"""
)
def cubic_line(spark, sf_dir):
    """The cubic through four neighbours on a line: value, first and second derivative half way."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = table(spark, sf_dir, "events").select("user_id", F.row_number().over(w).alias("i"), F.col("value"))
    return stencil.cubic_middle(s, "i", ("user_id",)).select("user_id", "i", *(r6(F.col(c)).alias(c) for c in ("middle", "slope", "bend"))).where("middle is not null")
