"""Queries over the driver's tables standing in for volumes, each with the SQL that must give the same.

`embeddings` holds a 4 x 4 x 4 volume in each row, `lineitem` two aligned intensities with masks, `events` a signal for
each user. Sums of doubles have no fixed order, so results are rounded to six decimals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import symmetric_eigenvalues
from ..model import AXES
from ..operators import masks, measures, stencil, voxelwise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c):
    """Six decimals, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vol, label, i, j, k, value of all embedding volumes."""
    e = table(spark, sf_dir, "embeddings")
    p = F.col("pos")
    flat = e.select(F.col("vec_id").alias("vol"), "label", F.posexplode("embedding"))
    return flat.select("vol", "label", F.floor(p / 16).cast("int").alias("i"), F.pmod(F.floor(p / 4), F.lit(4)).cast("int").alias("j"), F.pmod(p, F.lit(4)).cast("int").alias("k"), F.col("col").cast("double").alias("value"))


V = """v AS (SELECT vec_id AS vol, label, CAST(p // 16 AS INTEGER) AS i, CAST((p // 4) % 4 AS INTEGER) AS j, CAST(p % 4 AS INTEGER) AS k, CAST(embedding[p + 1] AS DOUBLE) AS value
  FROM embeddings, range(64) t(p))"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as paired intensities: v1 quantity, v2 price / 1000."""
    t = table(spark, sf_dir, "lineitem")
    return t.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_discount", F.col("l_quantity").alias("v1"), (F.col("l_extendedprice") / 1000).alias("v2"))


L = "l AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_discount, l_quantity AS v1, l_extendedprice / 1000 AS v2 FROM lineitem)"


def label_means(v: DataFrame) -> DataFrame:
    return v.groupBy("label", *AXES).agg(F.avg("value").alias("m"))


MEANS = "m AS (SELECT label, i, j, k, avg(value) AS m FROM v GROUP BY ALL)"
_RAW = "sum({a} * {b}) / (sqrt(sum({a} * {a})) * sqrt(sum({b} * {b})))"


@query(f"WITH {V}, {MEANS} SELECT vol, label, round({_RAW.format(a='value', b='m')}, 6) + 0 AS xcorr FROM v JOIN m USING (label, i, j, k) GROUP BY vol, label")
def xcorr_to_label_mean(spark, sf_dir):
    v = volumes(spark, sf_dir)
    both = v.join(label_means(v), ["label", *AXES])
    return both.groupBy("vol", "label").agg(r6(measures.raw_correlation(F.col("value"), F.col("m"))).alias("xcorr"))


@query(f"WITH {V}, w AS (SELECT vol - 1 AS vol, i, j, k, value AS v2 FROM v) SELECT vol, round({_RAW.format(a='value', b='v2')}, 6) + 0 AS xcorr FROM v JOIN w USING (vol, i, j, k) GROUP BY vol")
def xcorr_pair(spark, sf_dir):
    v = volumes(spark, sf_dir)
    other = v.select((F.col("vol") - 1).alias("vol"), *AXES, F.col("value").alias("v2"))
    return v.join(other, ["vol", *AXES]).groupBy("vol").agg(r6(measures.raw_correlation(F.col("value"), F.col("v2"))).alias("xcorr"))


@query(f"WITH {L} SELECT l_returnflag, round(1 - {_RAW.format(a='v1', b='v2')}, 6) + 0 AS objective, count(*) AS n FROM l WHERE l_linestatus = 'O' AND v1 > 5 AND v2 > 2 GROUP BY l_returnflag")
def xcorr_masked_threshold(spark, sf_dir):
    live = lines(spark, sf_dir).where((F.col("l_linestatus") == "O") & masks.above(F.col("v1"), F.col("v2"), 5, 2))
    return live.groupBy("l_returnflag").agg(r6(measures.xcorr(F.col("v1"), F.col("v2"))).alias("objective"), F.count("*").alias("n"))


_Z = "greatest(least((value - ms) / sd, 5.0), -5.0)"


@query(f"WITH {V}, s AS (SELECT vol, avg(value) AS ms, stddev_samp(value) AS sd FROM v WHERE value > 0 GROUP BY vol) SELECT v.vol, i, j, k, round(CASE WHEN value > 0 THEN {_Z} END, 6) + 0 AS z FROM v LEFT JOIN s ON v.vol = s.vol")
def zscore_volume(spark, sf_dir):
    return voxelwise.zscore(volumes(spark, sf_dir)).select("vol", *AXES, r6(F.col("z")).alias("z"))


@query(f"WITH {L} SELECT l_returnflag, round(sqrt(sum((v1 - v2) * (v1 - v2))) / count(*), 6) + 0 AS objective FROM l GROUP BY 1")
def zscore_objective(spark, sf_dir):
    return lines(spark, sf_dir).groupBy("l_returnflag").agg(r6(measures.zscore_difference(F.col("v1"), F.col("v2"))).alias("objective"))


@query(f"WITH {L}, s AS (SELECT avg(v1) AS m1, stddev_samp(v1) AS s1, avg(v2) AS m2, stddev_samp(v2) AS s2 FROM l) SELECT round(avg(abs((v1 - m1) / s1 - (v2 - m2) / s2)), 6) + 0 AS mean_abs FROM l, s")
def zscore_mean_abs(spark, sf_dir):
    t = lines(spark, sf_dir)
    s = t.agg(F.avg("v1").alias("m1"), F.stddev_samp("v1").alias("s1"), F.avg("v2").alias("m2"), F.stddev_samp("v2").alias("s2"))
    z = t.crossJoin(F.broadcast(s))  # one row
    return z.agg(r6(F.avg(F.abs((F.col("v1") - F.col("m1")) / F.col("s1") - (F.col("v2") - F.col("m2")) / F.col("s2")))).alias("mean_abs"))


@query(
    f"""WITH {L}, b AS (SELECT min(v1) AS lo, max(v1) AS hi FROM l),
  g AS (SELECT floor(0.5 + 0.5 + (v1 - lo) * (8 - 1e-5) / (hi - lo)) AS g, count(*) AS n, var_samp(v1 / v2) AS s FROM l, b WHERE v2 <> 0 GROUP BY 1)
SELECT round(sum(CASE WHEN n > 1 THEN n * s ELSE 0 END) / sum(n), 6) + 0 AS variance_ratio FROM g"""
)
def variance_ratio(spark, sf_dir):
    t = lines(spark, sf_dir)
    b = F.broadcast(t.agg(F.min("v1").alias("lo"), F.max("v1").alias("hi")))  # one row
    group = voxelwise.segment(F.col("v1"), F.col("lo"), F.col("hi"), 8)
    return measures.variance_ratio(t.crossJoin(b), group, F.col("v1"), F.col("v2")).select(r6(F.col("variance_ratio")).alias("variance_ratio"))


@query(
    """WITH s AS (SELECT user_id, ts, event_id, sign(value - avg(value) OVER (PARTITION BY user_id)) AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  z AS (SELECT *, last_value(CASE WHEN s <> 0 THEN s END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM s)
SELECT user_id, CAST(-sum(CASE WHEN s = 0 THEN 1 WHEN b IS NOT NULL AND b <> s THEN 1 ELSE 0 END) AS DOUBLE) AS ssc FROM z GROUP BY user_id"""
)
def ssc_rows(spark, sf_dir):
    """Where a value equals the mean, rounding of the sum decides the sign: as the SQL does, it is added up in the order of the rows."""
    whole = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    e = table(spark, sf_dir, "events").withColumn("m", F.avg("value").over(whole))
    return measures.sign_changes(e, F.col("value") - F.col("m"), ["ts", "event_id"], ("user_id",))


_BIN = "CAST(least(floor((v{n} - lo{n}) / (hi{n} - lo{n}) * 16), 15) AS INTEGER)"
_HIST = f"""{L}, b AS (SELECT min(v1) AS lo1, max(v1) AS hi1, min(v2) AS lo2, max(v2) AS hi2 FROM l),
  h AS (SELECT {_BIN.format(n=1)} AS b1, {_BIN.format(n=2)} AS b2, CAST(count(*) AS DOUBLE) AS w FROM l, b GROUP BY 1, 2)"""
_MI = f"""{_HIST}, p AS (SELECT b1, b2, w / sum(w) OVER () AS p FROM h), q AS (SELECT p, sum(p) OVER (PARTITION BY b1) AS px, sum(p) OVER (PARTITION BY b2) AS py FROM p)"""


def _line_histogram(spark, sf_dir):
    t = lines(spark, sf_dir)
    b = F.broadcast(t.agg(*(f(c).alias(n) for f, c, n in ((F.min, "v1", "lo1"), (F.max, "v1", "hi1"), (F.min, "v2", "lo2"), (F.max, "v2", "hi2")))))  # one row
    at = lambda n: F.least(F.floor((F.col(f"v{n}") - F.col(f"lo{n}")) / (F.col(f"hi{n}") - F.col(f"lo{n}")) * 16), F.lit(15)).cast("int")
    return measures.joint_histogram(t.crossJoin(b).withColumn("b1", at(1)).withColumn("b2", at(2)), "b1", "b2")


@query(f"WITH {_MI} SELECT round(-sum(p * ln(p / (px * py))), 6) + 0 AS mi FROM q")
def mutual_info(spark, sf_dir):
    return measures.mutual_information(_line_histogram(spark, sf_dir), "b1", "b2").select(r6(F.col("mi")).alias("mi"))


@query(f"WITH {_MI} SELECT round(-sum(p * ln(p / (px * py))) / (-sum(p * ln(px)) - sum(p * ln(py))), 6) + 0 AS nmi, round(-sum(p * ln(px)), 6) + 0 AS hx, round(-sum(p * ln(py)), 6) + 0 AS hy FROM q")
def normalized_mutual_info(spark, sf_dir):
    return measures.mutual_information(_line_histogram(spark, sf_dir), "b1", "b2").select(*(r6(F.col(c)).alias(c) for c in ("nmi", "hx", "hy")))


@query(
    f"""WITH {L}, b AS (SELECT min(v1) AS lo1, max(v1) AS hi1 FROM l), h AS (SELECT {_BIN.format(n=1)} AS bin, count(*) AS n FROM l, b GROUP BY 1),
  d AS (SELECT CAST(t.bin AS INTEGER) AS bin, coalesce(n, 0) / 1.0 AS n FROM range(16) t(bin) LEFT JOIN h ON t.bin = h.bin)
SELECT bin, round(CASE WHEN bin IN (0, 15) THEN n ELSE avg(n) OVER (ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) END, 6) + 0 AS blurred FROM d"""
)
def pdf_blur(spark, sf_dir):
    h = _line_histogram(spark, sf_dir).groupBy(F.col("b1").alias("bin")).agg(F.sum("w").alias("n"))
    d = spark.range(16).select(F.col("id").cast("int").alias("bin")).join(h, "bin", "left").fillna(0.0)
    return d.select("bin", r6(measures.blur_line(d, "n", "bin", 16)).alias("blurred"))


@query(
    f"""WITH {_HIST}, d AS (SELECT CAST(x.b AS INTEGER) AS b1, CAST(y.b AS INTEGER) AS b2, coalesce(w, 0.0) AS w FROM range(16) x(b) CROSS JOIN range(16) y(b) LEFT JOIN h ON h.b1 = x.b AND h.b2 = y.b),
  r AS (SELECT *, CASE WHEN b2 IN (0, 15) THEN w ELSE avg(w) OVER (PARTITION BY b1 ORDER BY b2 ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) END AS a FROM d)
SELECT b1, b2, round(CASE WHEN b1 IN (0, 15) THEN a ELSE avg(a) OVER (PARTITION BY b2 ORDER BY b1 ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) END, 6) + 0 AS blurred FROM r"""
)
def jpdf_blur(spark, sf_dir):
    bins = spark.range(256).select(F.floor(F.col("id") / 16).cast("int").alias("b1"), F.pmod("id", F.lit(16)).cast("int").alias("b2"))
    d = bins.join(_line_histogram(spark, sf_dir), ["b1", "b2"], "left").fillna(0.0)
    return measures.blur_joint(d, "b1", "b2", "w", 16).select("b1", "b2", r6(F.col("blurred")).alias("blurred"))


_LOCAL_SQL = {
    "diff": "-avg(abs(value - m))",
    "sqdiff": "-avg((value - m) * (value - m))",
    "label": "avg(CASE WHEN abs(value - m) < 0.01 THEN 1.0 ELSE 0.0 END)",
    "corrcoeff": "CASE WHEN var_pop(value) < 1e-5 OR var_pop(m) < 1e-5 THEN 0.0 ELSE covar_pop(value, m) / sqrt(var_pop(value) * var_pop(m)) END",
    "chamfer": "coalesce(1 - avg(CASE WHEN value > 0 THEN m END) / 20.0, 2.0)",
    "xcorr": f"CASE WHEN sum(value * value) < 1e-5 AND sum(m * m) < 1e-5 THEN 1.0 WHEN sum(value * value) < 1e-5 OR sum(m * m) < 1e-5 THEN 0.0 ELSE {_RAW.format(a='value', b='m')} END",
}


def _local(name):
    def f(spark, sf_dir):
        v = volumes(spark, sf_dir)
        both = v.join(label_means(v), ["label", *AXES])
        return both.groupBy("vol").agg(r6(measures.LOCAL[name](F.col("value"), F.col("m"))).alias("similarity"))

    f.__name__ = f"local_{name}"
    return query(f"WITH {V}, {MEANS} SELECT vol, round({_LOCAL_SQL[name]}, 6) + 0 AS similarity FROM v JOIN m USING (label, i, j, k) GROUP BY vol")(f)


for _name in _LOCAL_SQL:
    _local(_name)


@query(
    f"""WITH {V}, {MEANS}, s AS (SELECT vol, avg(CASE WHEN abs(value - m) < 0.01 THEN 1.0 ELSE 0.0 END) AS a, -avg(abs(value - m)) AS b FROM v JOIN m USING (label, i, j, k) GROUP BY vol)
SELECT vol, round((2 * a + 1 * b) / 3, 6) + 0 AS similarity, round(1 - (2 * a + 1 * b) / 3 * 0.5 + 0.2 * 8 / (1000 - 8) * 0.5, 6) + 0 AS objective FROM s"""
)
def local_objective(spark, sf_dir):
    v = volumes(spark, sf_dir)
    both = v.join(label_means(v), ["label", *AXES])
    parts = both.groupBy("vol").agg(measures.local_label(F.col("value"), F.col("m")).alias("a"), measures.local_diff(F.col("value"), F.col("m")).alias("b"))
    sim = measures.similarity([2.0, 1.0], [F.col("a"), F.col("b")])
    price = voxelwise.cost(F.lit(2.0), F.lit(0.0), F.lit(0.0), 1000.0)
    return parts.select("vol", r6(sim).alias("similarity"), r6(measures.local_objective(sim, price, 0.5)).alias("objective"))


_MOMENTS = "sum({a} * {b} * value) / sum(value) - sum({a} * value) / sum(value) * (sum({b} * value) / sum(value))"


@query(f"WITH {V} SELECT vol, round(sum(i * value) / sum(value), 6) + 0 AS cx, round(sum(j * value) / sum(value), 6) + 0 AS cy, round(sum(k * value) / sum(value), 6) + 0 AS cz FROM (SELECT vol, i, j, k, abs(value) AS value FROM v) GROUP BY vol")
def cog(spark, sf_dir):
    v = volumes(spark, sf_dir).withColumn("value", F.abs("value"))
    out = v.groupBy("vol").agg(*measures.centre_of_gravity(*(F.col(a) for a in AXES), F.col("value")))
    return out.select("vol", *(r6(F.col(c)).alias(c) for c in ("cx", "cy", "cz")))


@query(
    f"WITH {V} SELECT vol, "
    + ", ".join(f"round({_MOMENTS.format(a=dict(x='i', y='j', z='k')[p[0]], b=dict(x='i', y='j', z='k')[p[1]])}, 6) + 0 AS c{p}" for p in ("xx", "xy", "xz", "yy", "yz", "zz"))
    + " FROM (SELECT vol, i, j, k, abs(value) AS value FROM v) GROUP BY vol"
)
def covariance(spark, sf_dir):
    v = volumes(spark, sf_dir).withColumn("value", F.abs("value"))
    out = v.groupBy("vol").agg(*measures.covariance(*(F.col(a) for a in AXES), F.col("value")))
    return out.select("vol", *(r6(F.col(f"c{p}")).alias(f"c{p}") for p in ("xx", "xy", "xz", "yy", "yz", "zz")))


_COV = ", ".join(f"{_MOMENTS.format(a=dict(x='i', y='j', z='k')[p[0]], b=dict(x='i', y='j', z='k')[p[1]])} AS {p}" for p in ("xx", "xy", "xz", "yy", "yz", "zz"))


@query(
    f"""WITH {V}, c AS (SELECT label, {_COV} FROM (SELECT label, i, j, k, abs(value) AS value FROM v) GROUP BY label)
SELECT label, round(xx + yy + zz, 5) + 0 AS total, round(xx*(yy*zz - yz*yz) - xy*(xy*zz - yz*xz) + xz*(xy*yz - yy*xz), 5) + 0 AS product, true AS sorted FROM c"""
)
def principal_axes(spark, sf_dir):
    """Lengths of each label's axes, largest first; their squares are held by sum and product."""
    v = volumes(spark, sf_dir).withColumn("value", F.abs("value"))
    m = v.groupBy("label").agg(*measures.covariance(*(F.col(a) for a in AXES), F.col("value")))
    lengths = [F.sqrt(F.abs(e)) for e in symmetric_eigenvalues(*(F.col(f"c{p}") for p in ("xx", "xy", "xz", "yy", "yz", "zz")))]
    a = m.select("label", *(c.alias(f"a{n}") for n, c in enumerate(lengths, 1)))
    squares = [F.col(f"a{n}") * F.col(f"a{n}") for n in (1, 2, 3)]
    r5 = lambda c: F.round(c, 5) + F.lit(0.0)
    return a.select("label", r5(squares[0] + squares[1] + squares[2]).alias("total"), r5(squares[0] * squares[1] * squares[2]).alias("product"), ((F.col("a1") >= F.col("a2")) & (F.col("a2") >= F.col("a3"))).alias("sorted"))


@query(f"WITH {V} SELECT vol, count(*) AS n, round(avg(value), 6) + 0 AS mean, round(stddev_samp(value), 6) + 0 AS sd, round(sqrt(avg(value * value)), 6) + 0 AS rms, round(var_samp(value), 6) + 0 AS variance, round(min(value), 6) + 0 AS low, round(max(value), 6) + 0 AS high, round(avg(abs(value)), 6) + 0 AS mean_abs FROM v GROUP BY vol")
def volume_stats(spark, sf_dir):
    out = volumes(spark, sf_dir).groupBy("vol").agg(*measures.statistics(F.col("value")))
    return out.select("vol", "n", *(r6(F.col(c)).alias(c) for c in ("mean", "sd", "rms", "variance", "low", "high", "mean_abs")))


@query(
    f"""WITH {V}, b AS (SELECT vol, min(value) AS lo, max(value) AS hi FROM v GROUP BY vol), h AS (SELECT vol, CAST(least(greatest(floor(255 * (value - lo) / (hi - lo)), 0), 255) AS INTEGER) AS bin, count(*) AS n FROM v JOIN b USING (vol) GROUP BY 1, 2)
SELECT b.vol, CAST(t.bin AS INTEGER) AS bin, coalesce(h.n, 0) AS n FROM b CROSS JOIN range(256) t(bin) LEFT JOIN h ON h.vol = b.vol AND h.bin = t.bin"""
)
def histogram_256(spark, sf_dir):
    return measures.histogram(volumes(spark, sf_dir).select("vol", *AXES, "value"))


@query("SELECT CAST(sum(quality > 0) AS DOUBLE) AS volume1, CAST(sum(toxic > 0) AS DOUBLE) AS volume2, round(100.0 * (sum(quality > 0) - sum(toxic > 0)) / sum(quality > 0), 6) + 0 AS difference, round(sum(quality > 0 AND toxic > 0) / sum(quality > 0), 6) + 0 AS overlap1, round(sum(quality > 0 AND toxic > 0) / sum(toxic > 0), 6) + 0 AS overlap2, round(sum(quality * toxic) / (sqrt(sum(quality * quality)) * sqrt(sum(toxic * toxic))), 6) + 0 AS correlation FROM labels")
def overlap(spark, sf_dir):
    a, b = F.col("quality").cast("double"), F.col("toxic").cast("double")
    out = table(spark, sf_dir, "labels").agg(*measures.overlap(a, b))
    return out.select("volume1", "volume2", *(r6(F.col(c)).alias(c) for c in ("difference", "overlap1", "overlap2", "correlation")))


@query(f"WITH {V} SELECT vol, min(i) AS min_i, min(j) AS min_j, min(k) AS min_k, max(i) AS max_i, max(j) AS max_j, max(k) AS max_k FROM v WHERE value > 0.15 GROUP BY vol")
def bbox(spark, sf_dir):
    return volumes(spark, sf_dir).where("value > 0.15").groupBy("vol").agg(*measures.bounding_box(0.15))


@query(f"WITH {V} SELECT vol, min(value) AS low, max(value) AS high, round(max(value) * 0.1, 6) + 0 AS threshold FROM v GROUP BY vol")
def minmax(spark, sf_dir):
    return volumes(spark, sf_dir).groupBy("vol").agg(F.min("value").alias("low"), F.max("value").alias("high"), r6(measures.feature_threshold(F.col("value"))).alias("threshold"))


@query(f"WITH {V}, m AS (SELECT label, i, j, k, avg(value) AS m FROM v GROUP BY ALL), b AS (SELECT i, j, k, max(m) AS hi, arg_max(label, m) AS l FROM m GROUP BY ALL) SELECT i, j, k, CASE WHEN hi > 0 THEN l ELSE 0 END AS label FROM b")
def argmax_label(spark, sf_dir):
    m = label_means(volumes(spark, sf_dir)).withColumnRenamed("m", "value").withColumn("ord", F.col("label"))
    return measures.argmax_label(m)


@query(f"WITH {V} SELECT label, count(*) AS n, round(avg(i), 6) + 0 AS cx, round(avg(j), 6) + 0 AS cy, round(avg(k), 6) + 0 AS cz, round(avg(i * i) - avg(i) * avg(i), 6) + 0 AS cxx, round(avg(j * k) - avg(j) * avg(k), 6) + 0 AS cyz FROM (SELECT i, j, k, floor(value * 10) AS label FROM v) WHERE label > 0 GROUP BY label")
def label_moments(spark, sf_dir):
    v = volumes(spark, sf_dir).withColumn("value", F.floor(F.col("value") * 10).cast("double"))
    return measures.label_moments(v).select("label", "n", *(r6(F.col(c)).alias(c) for c in ("cx", "cy", "cz", "cxx", "cyz")))


@query(
    f"""WITH {V}, {MEANS}, q AS (SELECT vol, value / m AS q FROM v JOIN m USING (label, i, j, k) WHERE value > 0 AND m > 0),
  r AS (SELECT vol, q, row_number() OVER (PARTITION BY vol ORDER BY q) AS r, count(*) OVER (PARTITION BY vol) AS n FROM q), d AS (SELECT vol, q FROM r WHERE r = n // 2 + 1)
SELECT v.vol, i, j, k, round(value / q, 6) + 0 AS value FROM v JOIN d ON v.vol = d.vol"""
)
def median_normalise(spark, sf_dir):
    v = volumes(spark, sf_dir)
    target = v.join(label_means(v), ["label", *AXES]).select("vol", *AXES, F.col("m").alias("value"))
    out = voxelwise.median_normalise(v.drop("label"), target)
    return out.select("vol", *AXES, r6(F.col("value")).alias("value"))


def _ramp_sql(axis: str) -> str:
    values = voxelwise.ramp(4, 1.0, 2.0)
    return "CASE least({a}, 3 - {a}) ".format(a=axis) + " ".join(f"WHEN {n} THEN {v!r}" for n, v in enumerate(values)) + " ELSE 1.0 END"


@query(f"WITH {V} SELECT vol, i, j, k, round(value * {_ramp_sql('i')} * {_ramp_sql('j')} * {_ramp_sql('k')}, 6) + 0 AS value FROM v")
def apodize(spark, sf_dir):
    out = voxelwise.apodize(volumes(spark, sf_dir), (4, 4, 4), (1.0, 1.0, 1.0), (2.0, 2.0, 2.0))
    return out.select("vol", *AXES, r6(F.col("value")).alias("value"))


@query(f"WITH {V} SELECT vol, i, j, k, round(least(greatest(value, -0.1), 0.1), 6) + 0 AS value FROM v")
def clamp_range(spark, sf_dir):
    return voxelwise.clamp(volumes(spark, sf_dir), -0.1, 0.1).select("vol", *AXES, r6(F.col("value")).alias("value"))


@query(f"WITH {V}, b AS (SELECT vol, min(value) AS lo, max(value) AS hi FROM v GROUP BY vol) SELECT v.vol, i, j, k, CAST(CASE WHEN hi > lo THEN floor((value - lo) / (hi - lo) * 255 + 0.5) ELSE 0 END AS INTEGER) AS byte FROM v JOIN b ON v.vol = b.vol")
def byte_requantise(spark, sf_dir):
    return voxelwise.byte_requantise(volumes(spark, sf_dir)).select("vol", *AXES, "byte")


@query(f"WITH {V} SELECT vol, i, j, k, round(value * (1 + CASE WHEN ((i * 4 + j) * 4 + k) % 2 = 0 THEN 1.0 ELSE -1.0 END * 5.0 / 100), 6) + 0 AS value FROM v")
def speckle(spark, sf_dir):
    return voxelwise.speckle(volumes(spark, sf_dir), 5.0, (4, 4, 4)).select("vol", *AXES, r6(F.col("value")).alias("value"))


def _neighbour_sql(where: str) -> str:
    return f"WITH {V} SELECT a.vol, a.i, a.j, a.k, round(avg(b.value), 6) + 0 AS mean, CAST(count(*) AS INTEGER) AS n FROM v a JOIN v b ON a.vol = b.vol AND {where} AND NOT (a.i = b.i AND a.j = b.j AND a.k = b.k) GROUP BY a.vol, a.i, a.j, a.k"


def _box_sql(r: int) -> str:
    return " AND ".join(f"b.{a} BETWEEN a.{a} - {r} AND a.{a} + {r}" for a in AXES)


def _neighbours(kind: int, where: str):
    def f(spark, sf_dir):
        out = stencil.neighbour_mean(volumes(spark, sf_dir), ("value",), kind)
        return out.select("vol", *AXES, r6(F.col("mean_value")).alias("mean"), F.col("n_neighbours").alias("n"))

    f.__name__ = f"neighbour_mean_{kind}"
    return query(_neighbour_sql(where))(f)


_neighbours(6, "abs(a.i - b.i) + abs(a.j - b.j) + abs(a.k - b.k) = 1")
_neighbours(26, _box_sql(1))
_neighbours(124, _box_sql(2))


def _field(spark, sf_dir):
    """A displacement field on the embedding nodes."""
    v = volumes(spark, sf_dir)
    return v.select("vol", *AXES, F.col("value").alias("dx"), (F.col("value") * 2).alias("dy"), (-F.col("value")).alias("dz"), (F.col("value") > 0).alias("estimated"))


_N26 = f"n AS (SELECT a.vol, a.i, a.j, a.k, avg(b.value) AS m, sum(CASE WHEN b.value > 0 THEN b.value ELSE 0 END) AS e FROM v a JOIN v b ON a.vol = b.vol AND {_box_sql(1)} AND NOT (a.i = b.i AND a.j = b.j AND a.k = b.k) GROUP BY a.vol, a.i, a.j, a.k)"


@query(f"WITH {V}, {_N26} SELECT vol, i, j, k, round(value * 0.5 + m * 0.5, 6) + 0 AS dx, round(2 * value * 0.5 + 2 * m * 0.5, 6) + 0 AS dy, round(-value * 0.5 - m * 0.5, 6) + 0 AS dz FROM v JOIN n USING (vol, i, j, k)")
def smooth_warp(spark, sf_dir):
    return stencil.smooth(_field(spark, sf_dir), 0.5).select("vol", *AXES, *(r6(F.col(c)).alias(c) for c in stencil.DISPLACEMENT))


@query(f"WITH {V}, {_N26} SELECT vol, i, j, k, round(CASE WHEN value > 0 THEN value ELSE e / 26 + (m - value) / 2 END, 6) + 0 AS dx FROM v JOIN n USING (vol, i, j, k)")
def extrapolate(spark, sf_dir):
    return stencil.extrapolate(_field(spark, sf_dir)).select("vol", *AXES, r6(F.col("dx")).alias("dx"))


_WINDOWS = ", ".join(f"l{a} AS (PARTITION BY vol, {', '.join(x for x in AXES if x != a)} ORDER BY {a})" for a in AXES)
_D1 = dict(zip("uvw", AXES, strict=True))
_DERIVED = {n: f"(lead(value) OVER l{a} - lag(value) OVER l{a}) / 2" for n, a in _D1.items()}
_DERIVED |= {n * 2: f"lead(value) OVER l{a} - 2 * value + lag(value) OVER l{a}" for n, a in _D1.items()}
_MIXED = {"uv": ("u", "j"), "uw": ("u", "k"), "vw": ("v", "k")}
_DER = f"""d1 AS (SELECT vol, i, j, k, value, {', '.join(f'{e} AS {n}' for n, e in _DERIVED.items())} FROM v WINDOW {_WINDOWS}),
  d AS (SELECT *, {', '.join(f'(lead({c}) OVER l{a} - lag({c}) OVER l{a}) / 2 AS {n}' for n, (c, a) in _MIXED.items())} FROM d1 WINDOW {_WINDOWS})"""
_NAMES9 = (*_DERIVED, *_MIXED)


@query(f"WITH {V}, {_DER} SELECT vol, i, j, k, {', '.join(f'round({n}, 6) + 0 AS {n}' for n in _NAMES9)} FROM d")
def derivatives_central(spark, sf_dir):
    d = stencil.derivatives(volumes(spark, sf_dir))
    return d.select("vol", *AXES, *(r6(F.col(n)).alias(n) for n in _NAMES9))


_LINE3 = "sum(b.value * {w})"


@query(
    f"""WITH {V} SELECT a.vol, a.i, a.j, a.k, round(sum(b.value * (b.i - a.i)) / 18, 6) + 0 AS u, round(sum(b.value * (b.j - a.j)) / 18, 6) + 0 AS v, round(sum(b.value * (b.k - a.k)) / 18, 6) + 0 AS w,
  round(sum(b.value * CASE WHEN b.i = a.i THEN -2 ELSE 1 END) / 9, 6) + 0 AS uu, round(sum(b.value * (b.i - a.i) * (b.j - a.j)) / 12, 6) + 0 AS uv
FROM v a JOIN v b ON a.vol = b.vol AND {_box_sql(1)} GROUP BY a.vol, a.i, a.j, a.k HAVING count(*) = 27"""
)
def derivatives_smoothed(spark, sf_dir):
    d = stencil.smoothed_derivatives(volumes(spark, sf_dir)).where(stencil.interior((4, 4, 4)))
    return d.select("vol", *AXES, *(r6(F.col(n)).alias(n) for n in ("u", "v", "w", "uu", "uv")))


_INNER = " AND ".join(f"{a} BETWEEN 1 AND 2" for a in AXES)


@query(
    f"""WITH {V}, {_DER} SELECT vol, i, j, k, round(CASE WHEN u*u + v*v + w*w > 1e-12 THEN -0.5 * (u*u*(vv + ww) + v*v*(uu + ww) + w*w*(uu + vv) - 2*(u*v*uv + u*w*uw + v*w*vw)) / sqrt(u*u + v*v + w*w) ELSE 0.0 END, 6) + 0 AS lvv FROM d WHERE {_INNER}"""
)
def lvv(spark, sf_dir):
    d = stencil.derivatives(volumes(spark, sf_dir)).where(stencil.interior((4, 4, 4)))
    return d.select("vol", *AXES, r6(stencil.lvv()).alias("lvv"))


@query(f"WITH {V}, {_DER} SELECT vol, i, j, k, round(sqrt(u*u + v*v + w*w), 6) + 0 AS magnitude FROM d WHERE {_INNER}")
def gradient_magnitude(spark, sf_dir):
    d = stencil.derivatives(volumes(spark, sf_dir)).where(stencil.interior((4, 4, 4)))
    return d.select("vol", *AXES, r6(voxelwise.gradient_magnitude(F.col("u"), F.col("v"), F.col("w"))).alias("magnitude"))


@query(f"WITH {V}, {_DER} SELECT vol, i, j, k, round(CASE WHEN u*u + v*v + w*w < 0.01 THEN 0.0 ELSE (u*u*vv*ww + v*v*uu*ww + w*w*uu*vv) / pow(u*u + v*v + w*w, 2) END, 5) + 0 AS curvature FROM d WHERE {_INNER}")
def curvature(spark, sf_dir):
    d = stencil.derivatives(volumes(spark, sf_dir)).where(stencil.interior((4, 4, 4)))
    c = voxelwise.gaussian_curvature(*(F.col(n) for n in ("u", "v", "w", "uu", "vv", "ww")), 0.1)
    return d.select("vol", *AXES, (F.round(c, 5) + F.lit(0.0)).alias("curvature"))


_DET = "(uu*(vv*ww - vw*vw) - uv*(uv*ww - vw*uw) + uw*(uv*vw - vv*uw))"


@query(f"WITH {V}, {_DER} SELECT vol, i, j, k, uu > 0 AND uu*vv - uv*uv > 0 AND {_DET} > 0 AS positive, uu < 0 AND uu*vv - uv*uv > 0 AND {_DET} < 0 AS negative FROM d WHERE {_INNER}")
def definiteness(spark, sf_dir):
    d = stencil.derivatives(volumes(spark, sf_dir)).where(stencil.interior((4, 4, 4)))
    h = {n: F.col(n) for n in ("uu", "vv", "ww", "uv", "uw", "vw")}
    return d.select("vol", *AXES, masks.positive_definite(h).alias("positive"), masks.negative_definite(h).alias("negative"))


@query(
    f"""WITH {V}, {_DER}, s AS (SELECT *, uu > 0 AND uu*vv - uv*uv > 0 AND {_DET} > 0 AS good,
  -((vv*ww - vw*vw)*u + (uw*vw - uv*ww)*v + (uv*vw - uw*vv)*w) / {_DET} AS du, -((uw*vw - uv*ww)*u + (uu*ww - uw*uw)*v + (uv*uw - uu*vw)*w) / {_DET} AS dv,
  -((uv*vw - uw*vv)*u + (uv*uw - uu*vw)*v + (uu*vv - uv*uv)*w) / {_DET} AS dw FROM d WHERE {_INNER})
SELECT vol, i, j, k, round(du, 4) + 0 AS du, round(dv, 4) + 0 AS dv, round(dw, 4) + 0 AS dw FROM s WHERE good AND sqrt(du*du + dv*dv + dw*dw) < 2"""
)
def quadratic_min_3d(spark, sf_dir):
    d = stencil.derivatives(volumes(spark, sf_dir)).where(stencil.interior((4, 4, 4)))
    return d.select("vol", *AXES, *((F.round(c, 4) + F.lit(0.0)).alias(n) for n, c in stencil.quadratic_step().items())).where("du is not null")


_SIGNAL = "e AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS i, value FROM events)"


def _signal(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", F.row_number().over(w).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("k"), "value")


def _weights_sql(weights: list[float]) -> str:
    lag = lambda n: f"coalesce(lag(value, {n}) OVER w, 0.0) + coalesce(lead(value, {n}) OVER w, 0.0)"
    return f"value * {weights[0]!r}" + "".join(f" + {x!r} * ({lag(n)})" for n, x in enumerate(weights[1:], 1))


def _blur_1d(name, kind):
    weights = stencil.kernel(1.0, 4.0 if kind == "rect" else 2.0, kind)

    def f(spark, sf_dir):
        out = stencil.blur_axis(_signal(spark, sf_dir), "i", weights, ("user_id",))
        return out.select("user_id", "i", r6(F.col("value")).alias("value"))

    f.__name__ = name
    return query(f"WITH {_SIGNAL} SELECT user_id, i, round({_weights_sql(weights)}, 6) + 0 AS value FROM e WINDOW w AS (PARTITION BY user_id ORDER BY i)")(f)


_blur_1d("blur_rect_1d", "rect")
_blur_1d("blur_gauss_1d", "gaussian")


@query(
    f"""WITH {V}, w AS (SELECT vol, i, j, k, value, lag(value) OVER q AS a, lead(value) OVER q AS c, lead(value, 2) OVER q AS d FROM v WINDOW q AS (PARTITION BY vol, j, k ORDER BY i))
SELECT vol, CAST(2 * i AS INTEGER) AS i, j, k, round(value, 6) + 0 AS value FROM w
UNION ALL SELECT vol, CAST(2 * i + 1 AS INTEGER), j, k, round(coalesce((-a + 9 * value + 9 * c - d) / 16, (value + c) / 2), 6) + 0 FROM w WHERE c IS NOT NULL"""
)
def supersample_x2(spark, sf_dir):
    out = stencil.supersample_axis(volumes(spark, sf_dir), "i", 4)
    return out.select("vol", *AXES, r6(F.col("value")).alias("value"))


@query(
    f"""WITH {V}, p(axis, a, b, c) AS (VALUES (0, 1, 0, 0), (1, 0, 1, 0), (2, 0, 0, 1)), n AS (
  SELECT x.vol, x.i, x.j, x.k, sqrt(pow(y.value - x.value + s.d * (axis = 0)::INT, 2) + pow(2 * (y.value - x.value) + s.d * (axis = 1)::INT, 2) + pow(x.value - y.value + s.d * (axis = 2)::INT, 2)) AS r
  FROM v x CROSS JOIN p CROSS JOIN (VALUES (-1), (1)) s(d) JOIN v y ON y.vol = x.vol AND y.i = x.i + s.d * p.a AND y.j = x.j + s.d * p.b AND y.k = x.k + s.d * p.c)
SELECT vol, i, j, k, round(avg(r), 6) + 0 AS scale FROM n GROUP BY ALL"""
)
def local_scale(spark, sf_dir):
    return stencil.local_scale(_field(spark, sf_dir)).select("vol", *AXES, r6(F.col("scale")).alias("scale"))
