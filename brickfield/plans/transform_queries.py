"""Queries on tables of transforms: one set of parameters in each row of `part`, with their SQL.

The SQL gets its figures another way where there is one: inverses from inverted factors, quaternions from half angles,
and what a decomposition must give back from the parameters themselves.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..functions import columns as cx
from ..functions import transforms as tr
from ..operators import xfmops
from ..sources import files, scratch
from .volume_queries import query, r6, table

#: Parameter: (factor, modulus, offset, unit, base); its value is base + unit ((key factor) mod modulus - offset).
_DEGREE = math.pi / 180
PARAMETERS = {
    "tx": (1, 37, 18, 1.0, 0.0),
    "ty": (1, 23, 11, 1.0, 0.0),
    "tz": (1, 17, 8, 1.0, 0.0),
    "cx": (1, 13, 6, 0.5, 0.25),
    "cy": (1, 11, 5, 0.5, 0.25),
    "cz": (1, 7, 3, 0.5, 0.25),
    "rx": (7, 121, 60, _DEGREE, 0.0),
    "ry": (5, 101, 50, _DEGREE, 0.0),
    "rz": (3, 131, 65, _DEGREE, 0.0),
    "sx": (1, 9, 0, 0.05, 0.8),
    "sy": (1, 7, 0, 0.05, 0.85),
    "sz": (1, 5, 0, 0.1, 0.9),
    "h1": (1, 11, 5, 0.04, 0.0),
    "h2": (1, 13, 6, 0.03, 0.0),
    "h3": (1, 5, 2, 0.05, 0.0),
    "wide": (11, 341, 170, _DEGREE, 0.0),
}
TWELVE = ("tx", "ty", "tz", "rx", "ry", "rz", "sx", "sy", "sz", "h1", "h2", "h3")


def parameters(spark, sf_dir):
    t, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    return t.select(k.alias("id"), *((F.lit(b) + ((k * f) % m - o) * F.lit(u)).alias(n) for n, (f, m, o, u, b) in PARAMETERS.items()))


P = "p AS (SELECT p_partkey AS id, " + ", ".join(f"{b!r}::DOUBLE + ((p_partkey * {f}) % {m} - {o}) * {u!r}::DOUBLE AS {n}" for n, (f, m, o, u, b) in PARAMETERS.items()) + " FROM part)"
_R = """r AS (SELECT *, cos(rz)*cos(ry) AS r00, cos(rz)*sin(ry)*sin(rx) - sin(rz)*cos(rx) AS r01, cos(rz)*sin(ry)*cos(rx) + sin(rz)*sin(rx) AS r02,
  sin(rz)*cos(ry) AS r10, sin(rz)*sin(ry)*sin(rx) + cos(rz)*cos(rx) AS r11, sin(rz)*sin(ry)*cos(rx) - cos(rz)*sin(rx) AS r12,
  -sin(ry) AS r20, cos(ry)*sin(rx) AS r21, cos(ry)*cos(rx) AS r22 FROM p)"""
_A = "a AS (SELECT *, " + ", ".join(f"sx*r0{c} AS m0{c}, sy*(h1*r0{c} + r1{c}) AS m1{c}, sz*(h2*r0{c} + h3*r1{c} + r2{c}) AS m2{c}" for c in range(3)) + " FROM r)"
_M = "m AS (SELECT *, " + ", ".join(f"t{a} + c{a} - (m{k}0*cx + m{k}1*cy + m{k}2*cz) AS m{k}3" for k, a in enumerate("xyz")) + " FROM a)"
MATRIX = f"{P}, {_R}, {_A}, {_M}"
_Q = """q AS (SELECT *, sin(rx/2)*cos(ry/2)*cos(rz/2) - cos(rx/2)*sin(ry/2)*sin(rz/2) AS qx, cos(rx/2)*sin(ry/2)*cos(rz/2) + sin(rx/2)*cos(ry/2)*sin(rz/2) AS qy,
  cos(rx/2)*cos(ry/2)*sin(rz/2) - sin(rx/2)*sin(ry/2)*cos(rz/2) AS qz, cos(rx/2)*cos(ry/2)*cos(rz/2) + sin(rx/2)*sin(ry/2)*sin(rz/2) AS qw FROM p)"""
_SH = {(0, 0): "1", (1, 0): "-h1", (1, 1): "1", (2, 0): "(h1*h3 - h2)", (2, 1): "-h3", (2, 2): "1"}
_INV = "i AS (SELECT *, " + ", ".join("(" + " + ".join(f"r{k}{a} * {_SH[k, b]}" for k in range(3) if (k, b) in _SH) + f") / s{'xyz'[b]} AS n{a}{b}" for a in range(3) for b in range(3)) + " FROM m)"
_ENTRIES = [f"{r}{c}" for r in range(3) for c in range(4)]


def _sql6(names, prefix=""):
    return ", ".join(f"round({prefix}{n}, 6) + 0 AS {n}" for n in names)


_M_OUT = _sql6(f"m{e}" for e in _ENTRIES)
_INV_OUT = ", ".join([*(f"round(n{a}{b}, 6) + 0 AS n{a}{b}" for a in range(3) for b in range(3)), *(f"round(-(n{a}0*m03 + n{a}1*m13 + n{a}2*m23), 6) + 0 AS n{a}3" for a in range(3))])


def _out(df, names):
    return df.select("id", *(r6(F.col(n)).alias(n) for n in names))


def _matrices(spark, sf_dir):
    return cx.compose(parameters(spark, sf_dir))


def _euler_quaternion():
    """Turns about x, y and z, one after the other."""
    unit = lambda k: [F.lit(1.0 if n == k else 0.0) for n in range(3)]
    x, y, z = (cx.axis_quaternion(unit(k), F.col(a)) for k, a in enumerate(("rx", "ry", "rz")))
    return cx.quaternion_sum(cx.quaternion_sum(x, y), z)


_Q4 = ("qx", "qy", "qz", "qw")


def _with_quaternion(df):
    return df.withColumns(dict(zip(_Q4, _euler_quaternion(), strict=True)))


@query(f"WITH {MATRIX} SELECT id, {_M_OUT} FROM m")
def compose_matrix(spark, sf_dir):
    """T C S SH R -C of every parameter set."""
    return _out(_matrices(spark, sf_dir), [f"m{e}" for e in _ENTRIES])


@query(f"WITH {MATRIX}, {_INV} SELECT id, {_INV_OUT} FROM i")
def compose_inverse(spark, sf_dir):
    """The inverse of every composed matrix."""
    df = _matrices(spark, sf_dir)
    return _out(df.withColumns(cx.named(cx.affine_inverse(cx.entries()), "n")), [f"n{e}" for e in _ENTRIES])


@query(f"WITH {MATRIX} SELECT id, {_M_OUT} FROM m")
def compose_quaternion_matrix(spark, sf_dir):
    """The same matrices, their rotations given as quaternions."""
    df = _with_quaternion(parameters(spark, sf_dir))
    return _out(cx.compose(df, cx.quaternion_matrix(cx.normalised([F.col(n) for n in _Q4]))), [f"m{e}" for e in _ENTRIES])


@query(f"WITH {MATRIX}, {_INV} SELECT id, {_INV_OUT} FROM i")
def compose_inverse_quaternion(spark, sf_dir):
    """Inverses of matrices composed from quaternions."""
    df = _with_quaternion(parameters(spark, sf_dir))
    df = cx.compose(df, cx.quaternion_matrix([F.col(n) for n in _Q4]))
    return _out(df.withColumns(cx.named(cx.affine_inverse(cx.entries()), "n")), [f"n{e}" for e in _ENTRIES])


_BACK = ("otx", "oty", "otz", "orx", "ory", "orz", "osx", "osy", "osz", "oh1", "oh2", "oh3")


@query(f"WITH {P} SELECT id, " + ", ".join(f"round({n}, 6) + 0 AS o{n}" for n in TWELVE) + " FROM p")
def decompose_matrix(spark, sf_dir):
    """Composing and decomposing gives the parameters back."""
    return _out(cx.decompose(_matrices(spark, sf_dir)), _BACK)


@query(f"WITH {P}, {_Q} SELECT id, {_sql6(_Q4)}, round(sx, 6) + 0 AS osx, round(h2, 6) + 0 AS oh2 FROM q")
def decompose_quaternion(spark, sf_dir):
    """The same with the rotation as a quaternion."""
    df = cx.decompose(_matrices(spark, sf_dir))
    turn = cx.rotation(F.col("orx"), F.col("ory"), F.col("orz"))
    df = df.withColumns(cx.named(turn, "_t"))
    return _out(df.withColumns(dict(zip(_Q4, cx.matrix_quaternion(cx.entries("_t", 3, 3)), strict=True))), (*_Q4, "osx", "oh2"))


@query(f"WITH {P}, t AS (SELECT *, abs(wide) <= pi() / 2 AS ok FROM p) SELECT id, " + ", ".join(f"round(CASE WHEN ok THEN {v} END, 6) + 0 AS {n}" for n, v in (("ax", "wide"), ("ay", "ry"), ("az", "rz"))) + " FROM t")
def rotation_angles(spark, sf_dir):
    """The angles of a rotation, none where one is beyond a right angle."""
    df = parameters(spark, sf_dir)
    df = df.withColumns(cx.named(cx.rotation(F.col("wide"), F.col("ry"), F.col("rz")), "_r"))
    return _out(df.withColumns(dict(zip(("ax", "ay", "az"), cx.angles(cx.entries("_r", 3, 3)), strict=True))), ("ax", "ay", "az"))


@query(
    f"""WITH {P}, {_Q}, n AS (SELECT *, sqrt((tx + 0.5) * (tx + 0.5) + ty * ty + tz * tz) AS l FROM q)
SELECT id, round((tx + 0.5) / l * sin(rx / 2), 6) + 0 AS ax, round(ty / l * sin(rx / 2), 6) + 0 AS ay, round(tz / l * sin(rx / 2), 6) + 0 AS az, round(cos(rx / 2), 6) + 0 AS aw,
  round(abs(rx), 6) + 0 AS angle, {_sql6(_Q4)}, 1.0::DOUBLE AS size FROM n"""
)
def quaternion_algebra(spark, sf_dir):
    """Axis to quaternion and back, sums, length one after normalising."""
    df = _with_quaternion(parameters(spark, sf_dir))
    axis = [F.col("tx") + 0.5, F.col("ty"), F.col("tz")]
    own = ("ax", "ay", "az", "aw")
    df = df.withColumns(dict(zip(own, cx.axis_quaternion(axis, F.col("rx")), strict=True)))
    a = [F.col(n) for n in own]
    df = df.withColumn("angle", cx.quaternion_angle(a)).withColumn("size", cx.length(cx.normalised([3 * x for x in a])))
    return _out(df, (*own, "angle", *_Q4, "size"))


@query(f"WITH {P} SELECT id, round(CASE WHEN sz > 1.15 * (sx + sy) / 2 THEN (sx + sy) / 2 ELSE sz END, 6) + 0 AS sz FROM p")
def scale_check(spark, sf_dir):
    """Z scales much above the mean of the others become that mean."""
    df = parameters(spark, sf_dir)
    return _out(df.withColumn("sz", cx.checked_scale(F.col("sx"), F.col("sy"), F.col("sz"))), ("sz",))


@query(
    f"""WITH {MATRIX} SELECT id, round(sx * sy * sz, 6) + 0 AS det, round(m00 + m11 + m22, 6) + 0 AS trace, round(m00*m00 + m01*m01 + m02*m02, 6) + 0 AS g00,
  round(m00*m10 + m01*m11 + m02*m12, 6) + 0 AS g01, round(m10*m20 + m11*m21 + m12*m22, 6) + 0 AS g12, 1.0::DOUBLE AS i00, 0.0::DOUBLE AS i12 FROM m"""
)
def matrix_basics(spark, sf_dir):
    """Determinant, trace, transposed product, and a matrix times its inverse."""
    a = cx.entries("m", 3, 3)
    df = _matrices(spark, sf_dir).withColumns(cx.named(cx.inverse(a), "_n"))
    gram, one = cx.multiply(a, cx.transpose(a)), cx.multiply(a, cx.entries("_n", 3, 3))
    df = df.withColumns({"det": cx.determinant(a), "trace": cx.trace(a), "g00": gram[0][0], "g01": gram[0][1], "g12": gram[1][2], "i00": one[0][0], "i12": one[1][2]})
    return _out(df, ("det", "trace", "g00", "g01", "g12", "i00", "i12"))


@query(
    f"""WITH {P}, v AS (SELECT id, tx + 0.5 AS x, ty AS y, tz AS z FROM p), o AS (SELECT *, CASE WHEN abs(x) <= abs(y) AND abs(x) <= abs(z) THEN 1 WHEN abs(y) <= abs(z) THEN 2 ELSE 3 END AS k FROM v),
  c AS (SELECT *, CASE k WHEN 1 THEN 0 WHEN 2 THEN -z ELSE y END AS a, CASE k WHEN 1 THEN z WHEN 2 THEN 0 ELSE -x END AS b, CASE k WHEN 1 THEN -y WHEN 2 THEN x ELSE 0 END AS d FROM o),
  n AS (SELECT *, sqrt(a*a + b*b + d*d) AS l, sqrt(x*x + y*y + z*z) AS m FROM c)
SELECT id, round(a / l, 6) + 0 AS ax, round(b / l, 6) + 0 AS ay, round(d / l, 6) + 0 AS az, round((y*d - z*b) / (l*m), 6) + 0 AS bx, round((z*a - x*d) / (l*m), 6) + 0 AS "by", round((x*b - y*a) / (l*m), 6) + 0 AS bz FROM n"""
)
def perpendicular_vectors(spark, sf_dir):
    """Two unit vectors across a given one."""
    df = parameters(spark, sf_dir)
    a, b = cx.perpendicular([F.col("tx") + 0.5, F.col("ty"), F.col("tz")])
    return _out(df.withColumns(dict(zip(("ax", "ay", "az", "bx", "by", "bz"), [*a, *b], strict=True))), ("ax", "ay", "az", "bx", "by", "bz"))


@query(
    f"""WITH {P} SELECT id, tx + cx AS sx, ty * cz - tz * cy AS crx, tz * cx - tx * cz AS cry, tx * cy - ty * cx AS crz, round(tx * cx + ty * cy + tz * cz, 6) + 0 AS dot,
  round(sqrt(tx * tx + ty * ty + tz * tz), 6) + 0 AS length, round(sqrt(pow(tx - cx, 2) + pow(ty - cy, 2) + pow(tz - cz, 2)), 6) + 0 AS distance, round(cy / sqrt(cx * cx + cy * cy + cz * cz), 6) + 0 AS ny FROM p"""
)
def vector_ops(spark, sf_dir):
    """Sum, cross and dot product, length, distance, normal."""
    a, b = ([F.col(f"{n}{c}") for c in "xyz"] for n in "tc")
    c = cx.cross(a, b)
    df = parameters(spark, sf_dir).withColumns({"sx": a[0] + b[0], "crx": c[0], "cry": c[1], "crz": c[2], "dot": cx.dot(a, b), "length": cx.length(a), "distance": cx.distance(a, b), "ny": cx.normalised(b)[1]})
    return _out(df, ("sx", "crx", "cry", "crz", "dot", "length", "distance", "ny"))


@query(
    f"""WITH {MATRIX}, w AS (SELECT *, m00*tx + m01*ty + m02*tz + m03 AS x, m10*tx + m11*ty + m12*tz + m13 AS y, m20*tx + m21*ty + m22*tz + m23 AS z, 0.01*tx + 0.02*tz + 1 AS w FROM m)
SELECT id, {", ".join(f"round(CASE WHEN w <> 0 AND w <> 1 THEN {a} / w ELSE {a} END, 6) + 0 AS {a}" for a in "xyz")} FROM w"""
)
def homogeneous_point(spark, sf_dir):
    """Points through 4x4 matrices, divided by their last coordinate."""
    m = [*cx.entries(), [F.lit(0.01), F.lit(0.0), F.lit(0.02), F.lit(1.0)]]
    p = cx.homogeneous_point(m, [F.col(c) for c in ("tx", "ty", "tz")], F.lit(1.0))
    return _out(_matrices(spark, sf_dir).withColumns(dict(zip("xyz", p, strict=True))), "xyz")


@query(f"WITH {P} SELECT id, abs(rx * 2) <= pi() / 2 AND abs(ry) <= pi() / 2 AND abs(rz) <= pi() / 2 AND sx * 3 BETWEEN 0 AND 3 AND sy BETWEEN 0 AND 3 AND sz BETWEEN 0 AND 3 AND abs(h1 * 11) <= 2 AND abs(h2) <= 2 AND abs(h3) <= 2 AS ok FROM p")
def parameter_bounds(spark, sf_dir):
    """Rotations, scales and shears within their closed limits."""
    c = F.col
    ok = cx.parameters_in_bounds([c("rx") * 2, c("ry"), c("rz")], [c("sx") * 3, c("sy"), c("sz")], [c("h1") * 11, c("h2"), c("h3")])
    return parameters(spark, sf_dir).select("id", ok.alias("ok"))


@query(f"WITH {P} SELECT id, abs(tx / 8) <= 2 AND abs(ty / 5) <= 2 AND abs(rx) <= 2 AND sx BETWEEN 0 AND 3 AND sy * 2.8 BETWEEN 0 AND 3 AND sz BETWEEN 0 AND 3 AND abs(h1) <= 2 AND abs(h2) <= 2 AND abs(h3) <= 2 AS ok FROM p")
def quaternion_bounds(spark, sf_dir):
    """Quaternion parts within 2."""
    c = F.col
    ok = cx.quaternions_in_bounds([c("tx") / 8, c("ty") / 5, c("rx")], [c("sx"), c("sy") * 2.8, c("sz")], [c("h1"), c("h2"), c("h3")])
    return parameters(spark, sf_dir).select("id", ok.alias("ok"))


@query(
    f"""WITH {P} SELECT id, 6 AS n6, 7 AS n7, round(rx / ({_DEGREE!r}), 6) + 0 AS v4, round(sx / 0.02, 6) + 0 AS v7, round(rz, 6) + 0 AS rz, round(sx, 6) + 0 AS sy, round(sx, 6) + 0 AS sz, round(h1, 6) + 0 AS h1 FROM p"""
)
def parameter_packing(spark, sf_dir):
    """Packed free parameters and what comes back; with seven, all scales follow the first."""
    values = [F.col(n) for n in TWELVE]
    six, seven = (cx.packed(values, tr.WEIGHTS, tr.FREE[k]) for k in ("lsq6", "lsq7"))
    df = parameters(spark, sf_dir).withColumns({"_p6": six, "_p7": seven})
    back = cx.unpacked(values, tr.WEIGHTS, tr.FREE["lsq7"], F.col("_p7"))
    out = {"v4": F.element_at("_p6", 4), "v7": F.element_at("_p7", 7), "rz": back[5], "sy": back[7], "sz": back[8], "h1": back[9]}
    return df.select("id", F.size("_p6").alias("n6"), F.size("_p7").alias("n7"), *(r6(c).alias(n) for n, c in out.items()))


@query("SELECT * FROM (VALUES ('lsq3', 3), ('lsq6', 6), ('lsq7', 7), ('lsq9', 9), ('lsq10', 10), ('lsq12', 12), ('pat', 7), ('procrustes', 7), ('lsq', 12)) t(kind, n_free)")
def dof_selection(spark, sf_dir):
    """How many of the twelve weights each kind of fit leaves free."""
    rows = [(k, [float(f) * float(w) for f, w in zip(v, tr.WEIGHTS, strict=True)]) for k, v in tr.FREE.items()]
    return spark.createDataFrame(rows, "kind string, weights array<double>").select("kind", F.size(F.filter("weights", lambda w: w != 0)).alias("n_free"))


@query(f"WITH {P}, t AS (SELECT id, tx + 0.5 AS x, ty + 0.5 AS y, cx AS u, cy AS v FROM p) SELECT id, round(sqrt(x*x + y*y) * u / sqrt(u*u + v*v), 6) + 0 AS x, round(sqrt(x*x + y*y) * v / sqrt(u*u + v*v), 6) + 0 AS y FROM t")
def align_z(spark, sf_dir):
    """A vector turned about z towards another one."""
    x, y, u, v = F.col("tx") + 0.5, F.col("ty") + 0.5, F.col("cx"), F.col("cy")
    turn = F.atan2(v, u) - F.atan2(y, x)
    df = parameters(spark, sf_dir).withColumns(cx.named(cx.rotation(F.lit(0.0), F.lit(0.0), turn), "_r"))
    r = cx.entries("_r", 3, 3)
    moved = [cx.dot(r[k], [x, y, F.lit(0.0)]) for k in range(2)]
    return df.select("id", r6(moved[0]).alias("x"), r6(moved[1]).alias("y"))


# --- points -----------------------------------------------------------------------------------------------------------

_TURN, _SCALE, _SHIFT = tr.rotation(0.3, -0.2, 0.4), 1.5, (3.0, -2.0, 7.0)
_POINTS = "a AS (SELECT c_mktsegment AS g, c_acctbal / 100 AS x, CAST(c_custkey % 101 AS DOUBLE) AS y, CAST(c_custkey % 53 AS DOUBLE) AS z FROM customer)"


def _points(spark, sf_dir):
    t, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    return t.select(F.col("c_mktsegment").alias("g"), (F.col("c_acctbal") / 100).alias("x"), (k % 101).cast("double").alias("y"), (k % 53).cast("double").alias("z"))


def _turned(r: int) -> str:
    return "(" + " + ".join(f"({float(_SCALE * _TURN[r, c])!r}::DOUBLE) * avg({a})" for c, a in enumerate("xyz")) + f" + {_SHIFT[r]!r}::DOUBLE)"


@query(
    f"WITH {_POINTS} SELECT g, count(*) AS n, " + ", ".join(f"round(avg({a}), 4) + 0 AS c{a}, round({_turned(k)} - avg({a}), 4) + 0 AS t{a}" for k, a in enumerate("xyz")) + f", {_SCALE}::DOUBLE AS scale, "
    + ", ".join(f"round({float(_TURN[r, c])!r}::DOUBLE, 4) + 0 AS r{r}{c}" for r in range(3) for c in range(3))
    + " FROM a GROUP BY g"
)
def procrustes(spark, sf_dir):
    """Translation, centroid, rotation and scale of paired points, from moments that are aggregated in Spark."""
    a = _points(spark, sf_dir)
    b = {f"b{c}": sum(F.col(n) * float(_SCALE * _TURN[k, q]) for q, n in enumerate("xyz")) + _SHIFT[k] for k, c in enumerate("xyz")}
    out = ("cx", "tx", "cy", "ty", "cz", "tz", "scale", *(f"r{r}{c}" for r in range(3) for c in range(3)))
    found = xfmops.procrustes_of(a.withColumns(b), "g", ("x", "y", "z"), ("bx", "by", "bz"))
    return found.select("g", "n", *((F.round(c, 4) + F.lit(0.0)).alias(c) for c in out))


@query(f"WITH {_POINTS} SELECT g, count(*) AS n, round(avg(x), 6) + 0 AS cx, round(avg(y), 6) + 0 AS cy, round(avg(z), 6) + 0 AS cz FROM a GROUP BY g")
def point_centroid(spark, sf_dir):
    """Centroid of points."""
    return xfmops.centroid(_points(spark, sf_dir), "g").select("g", "n", *(r6(F.col(f"c{c}")).alias(f"c{c}") for c in "xyz"))


# --- transform files --------------------------------------------------------------------------------------------------


def _xfm_rows(spark, sf_dir):
    """Each parameter set as the rows of a transform file: one linear step, inverted for every third."""
    m = _matrices(spark, sf_dir).withColumn("matrix", F.array(*(F.col(f"m{e}") for e in _ENTRIES)))
    none = F.lit(None)
    return m.select(F.col("id").cast("string").alias("xfm_id"), F.lit(0).alias("seq"), F.lit("Linear").alias("type"), (F.col("id") % 3 == 0).alias("invert_flag"), "matrix", none.cast("array<array<double>>").alias("points"), none.cast("array<array<double>>").alias("displacements"), none.cast("string").alias("grid_vol"))


def _flat(df):
    return df.select(F.col("xfm_id").cast("long").alias("id"), "invert_flag", *(r6(F.element_at("matrix", k + 1)).alias(f"m{e}") for k, e in enumerate(_ENTRIES)))


@query(f"WITH {MATRIX} SELECT id, id % 3 = 0 AS invert_flag, {_M_OUT} FROM m")
def xfm_text_round_trip(spark, sf_dir):
    """Parameters to transform files' texts and parsed back, as a table of texts."""
    return _flat(files.parse_xfms(files.format_xfms(_xfm_rows(spark, sf_dir))))


_NATION = "n AS (SELECT n_nationkey AS id, n_nationkey % 2 = 0 AS inv, 1 + 0.1 * n_nationkey AS s, n_nationkey - 10.0 AS t FROM nation)"


def _nation_rows(spark, sf_dir):
    k = F.col("n_nationkey")
    s, t, zero = 1 + F.lit(0.1) * k, k - 10.0, F.lit(0.0)
    none = F.lit(None)
    matrix = F.array(s, zero, zero, t, zero, s, zero, t, zero, zero, s, t)
    return table(spark, sf_dir, "nation").select(k.cast("string").alias("xfm_id"), F.lit(0).alias("seq"), F.lit("Linear").alias("type"), (k % 2 == 0).alias("invert_flag"), matrix.alias("matrix"), none.cast("array<array<double>>").alias("points"), none.cast("array<array<double>>").alias("displacements"), none.cast("string").alias("grid_vol"))


@query(f"WITH {_NATION} SELECT CAST(id AS BIGINT) AS id, inv AS invert_flag, round(CAST(s AS DOUBLE), 6) + 0 AS scale, round(CAST(t AS DOUBLE), 6) + 0 AS shift FROM n")
def xfm_files(spark, sf_dir):
    """Transform files written and scanned again, a file for each."""
    path = scratch.fresh_dir(spark, "xfm")
    files.write_xfms(_nation_rows(spark, sf_dir), path)
    got = files.read_xfms(spark, path)
    return got.select(F.col("xfm_id").cast("long").alias("id"), "invert_flag", r6(F.element_at("matrix", 1)).alias("scale"), r6(F.element_at("matrix", 12)).alias("shift"))


@query(f"WITH {_NATION} SELECT CAST(id AS BIGINT) AS id, round(CAST(CASE WHEN inv THEN s ELSE 1 / s END AS DOUBLE), 6) + 0 AS scale, round(CAST(CASE WHEN inv THEN t ELSE -t / s END AS DOUBLE), 6) + 0 AS shift FROM n")
def xfm_invert_linear(spark, sf_dir):
    """Linear transforms inverted; an inverted one comes back as its matrix."""
    out = xfmops.inverted_linear(_nation_rows(spark, sf_dir))
    return out.select(F.col("xfm_id").cast("long").alias("id"), r6(F.element_at("matrix", 1)).alias("scale"), r6(F.element_at("matrix", 12)).alias("shift"))


_STEPS = "s AS (SELECT c_nationkey AS x, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS INTEGER) AS seq, CASE WHEN c_custkey % 4 = 0 THEN 'Grid_Transform' ELSE 'Linear' END AS type FROM customer)"


def _typed_steps(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("xfm_id"), (F.row_number().over(w) - 1).cast("int").alias("seq"), F.when(F.col("c_custkey") % 4 == 0, "Grid_Transform").otherwise("Linear").alias("type"))


@query(f"WITH {_STEPS} SELECT x AS xfm_id, seq FROM s WHERE type = 'Linear'")
def linear_part(spark, sf_dir):
    """The linear steps of every list."""
    return xfmops.linear_part(_typed_steps(spark, sf_dir)).select("xfm_id", "seq")


@query(f"WITH {_STEPS}, l AS (SELECT *, max(CASE WHEN type = 'Grid_Transform' THEN seq END) OVER (PARTITION BY x) AS l FROM s) SELECT x AS xfm_id, seq, seq = l AS warp FROM l WHERE l IS NOT NULL AND seq <= l UNION ALL SELECT x, seq, false FROM l WHERE l IS NULL")
def split_last_warp(spark, sf_dir):
    """The steps before a list's last grid, and that grid."""
    rest, warp = xfmops.split_last_warp(_typed_steps(spark, sf_dir))
    return rest.select("xfm_id", "seq", F.lit(False).alias("warp")).unionByName(warp.select("xfm_id", "seq", F.lit(True).alias("warp")))


@query(f"WITH {_STEPS} SELECT x AS xfm_id, string_agg(CAST(seq AS VARCHAR) || ':' || type, ' ' ORDER BY seq) AS line FROM s GROUP BY x")
def print_steps(spark, sf_dir):
    """Every list's steps walked in order, as one line."""
    return xfmops.printed(_typed_steps(spark, sf_dir))


_CENTRES = np.array([[0.0, 0, 0], [3, 0, 1], [0, 3, 2], [1, 2, 3], [3, 3, 0], [2, 0, 3]])
_TPS = xfmops.spline_of(_CENTRES, _CENTRES + np.array([[0.1, 0, 0.2], [0, 0.3, 0], [-0.2, 0, 0.1], [0.1, 0.1, 0.1], [0, 0, -0.2], [0.2, -0.1, 0]]))


def _num(x) -> str:
    return f"({float(x)!r}::DOUBLE)"


def _spline_sql(q: int, times: float = 1.0) -> str:
    c, w = _TPS
    n = len(c)
    own = [f"{_num(w[k, q] * times)} * sqrt(pow(x - {_num(c[k, 0])}, 2) + pow(y - {_num(c[k, 1])}, 2) + pow(z - {_num(c[k, 2])}, 2))" for k in range(n)]
    line = [f"{_num(w[n + 1 + m, q] * times + (m == q) * (1 - times))} * {a}" for m, a in enumerate("xyz")]
    return " + ".join([_num(w[n, q] * times), *own, *line])


_XYZ = "v AS (SELECT p_partkey AS pid, (p_partkey % 40) / 10.0::DOUBLE AS x, (p_partkey % 37) / 10.0::DOUBLE AS y, (p_partkey % 31) / 10.0::DOUBLE AS z FROM part)"


def _spread(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("pid"), *(((k % n) / 10.0).alias(a) for a, n in (("x", 40), ("y", 37), ("z", 31))))


def _xyz6(df):
    return df.select("pid", *(r6(F.col(a)).alias(a) for a in "xyz"))


@query(f"WITH {_XYZ} SELECT pid, {', '.join(f'round({_spline_sql(q)}, 6) + 0 AS {a}' for q, a in enumerate('xyz'))} FROM v")
def spline_forward(spark, sf_dir):
    """Points through a thin-plate spline."""
    return _xyz6(xfmops.spline_forward(_spread(spark, sf_dir), *_TPS))


@query(f"WITH {_XYZ} SELECT pid, {', '.join(f'round({a}, 6) + 0 AS {a}' for a in 'xyz')} FROM v")
def spline_inverse(spark, sf_dir):
    """A spline and its inverse give every point back."""
    return _xyz6(xfmops.apply(xfmops.spline_forward(_spread(spark, sf_dir), *_TPS), [{"type": "Thin_Plate_Spline_Transform", "points": _TPS[0], "displacements": _TPS[1]}], inverse=True))


@query(f"WITH {_XYZ} SELECT pid, {', '.join(f'round({_spline_sql(q, 0.25)}, 6) + 0 AS {a}' for q, a in enumerate('xyz'))} FROM v")
def scale_spline(spark, sf_dir):
    """A quarter of a spline's way."""
    return _xyz6(xfmops.spline_forward(_spread(spark, sf_dir), *xfmops.scaled_spline(*_TPS, 0.25)))


_LINEAR = tr.from_degrees((3, -2, 1), (10, 20, -15), (1.1, 0.9, 1.2))


def _linear_sql(m, names="xyz"):
    return [" + ".join([*(f"({float(m[r, c])!r}::DOUBLE) * {a}" for c, a in enumerate(names)), f"({float(m[r, 3])!r}::DOUBLE)"]) for r in range(3)]


@query(f"WITH {_XYZ} SELECT pid, {', '.join(f'round({e}, 6) + 0 AS {a}' for a, e in zip('xyz', _linear_sql(_LINEAR @ _LINEAR), strict=True))} FROM v")
def apply_transform(spark, sf_dir):
    """Points of objects through a list of steps, forward, forward, there and back."""
    linear = {"type": "Linear", "matrix": _LINEAR}
    user = {"type": "User_Transform", "forward": lambda p: p.withColumn("x", F.col("x") + 1), "backward": lambda p: p.withColumn("x", F.col("x") - 1)}
    df = xfmops.apply(_spread(spark, sf_dir), [user, {**user, "invert_flag": True}, linear, linear, linear])
    return _xyz6(xfmops.apply(df, [linear], inverse=True))
