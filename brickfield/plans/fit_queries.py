"""Queries on fits, searches and multi-step programs. The volume is a sum of Gaussian blobs, one for each row of `nation`; what a fit must find
is known, so the SQL states that every figure lies within its tolerance. Blurs, gradients and distances are held against direct sums."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import transforms as tr
from ..model import AXES, Geometry, affine, grid
from ..operators import lattice, measures, optimise, sample, stencil
from ..operators.sample import XYZ
from . import pipelines
from .volume_queries import V, query, r6, table, volumes

G20 = Geometry((20, 20, 20), (6.0, 6.0, 6.0), (-57.0, -57.0, -57.0))


def blobs(spark, sf_dir, g: Geometry = G20, width: float = 14.0):
    """Every voxel's sum over the nations of a weight times a Gaussian of the distance; the 25 nations are broadcast."""
    k = F.col("n_nationkey")
    n = table(spark, sf_dir, "nation").select(*((k * f % m - o).cast("double").alias(c) for c, f, m, o in (("a", 7, 61, 30), ("b", 11, 53, 26), ("c", 5, 43, 21))), (F.col("n_regionkey") + 1.0).alias("w"))
    at = grid(spark, g.size).withColumns(dict(zip(XYZ, affine(g.to_world(), *AXES), strict=True)))
    d2 = sum((F.col(p) - F.col(q)) ** 2 for p, q in zip(XYZ, "abc", strict=True))
    return at.crossJoin(F.broadcast(n)).groupBy(*AXES).agg(F.sum(F.col("w") * F.exp(-d2 / (2 * width * width))).alias("value")).select(F.lit("blobs").alias("vol"), *AXES, "value")


def _moved(spark, sf_dir, matrix):
    """The blobs as they look after a transform: sampled where each voxel came from, by the formula itself."""
    back = np.linalg.inv(matrix)
    k = F.col("n_nationkey")
    n = table(spark, sf_dir, "nation").select(*((k * f % m - o).cast("double").alias(c) for c, f, m, o in (("a", 7, 61, 30), ("b", 11, 53, 26), ("c", 5, 43, 21))), (F.col("n_regionkey") + 1.0).alias("w"))
    at = grid(spark, G20.size).withColumns(dict(zip(XYZ, affine(back @ G20.to_world(), *AXES), strict=True)))
    d2 = sum((F.col(p) - F.col(q)) ** 2 for p, q in zip(XYZ, "abc", strict=True))
    return at.crossJoin(F.broadcast(n)).groupBy(*AXES).agg(F.sum(F.col("w") * F.exp(-d2 / (2 * 14.0 * 14.0))).alias("value")).select(F.lit("moved").alias("vol"), *AXES, "value")


IDEAL = {
    "lsq3": tr.from_degrees((5, 2, -6)),
    "lsq6": tr.from_degrees((5, 2, -6), (-4, 7, 10)),
    "lsq7": tr.from_degrees((3, 2, -4), (-4, 5, 6), (1.08, 1.08, 1.08)),
    "lsq9": tr.from_degrees((3, 2, -4), (-4, 5, 6), (1.08, 0.95, 1.05)),
    "lsq12": tr.from_degrees((3, 2, -4), (-3, 4, 5), (1.05, 0.96, 1.04), (0.04, -0.03, 0.05)),
}
_SIXTEEN = 'SELECT CAST(r.n AS INTEGER) AS "row", CAST(c.n AS INTEGER) AS col, true AS close FROM range(3) r(n), range(4) c(n)'


def _closeness(spark, found, ideal, linear=0.05, shift=0.5):
    rows = [(r, c, bool(abs(found[r, c] - ideal[r, c]) < (shift if c == 3 else linear))) for r in range(3) for c in range(4)]
    return spark.createDataFrame(rows, "row int, col int, close boolean")


def _fit(kind):
    def f(spark, sf_dir):
        one, two = blobs(spark, sf_dir), _moved(spark, sf_dir, IDEAL[kind])
        p = optimise.linear_fit(one, G20, two, G20, kind, start=tr.Parameters(center=np.zeros(3)), step=(6.0,) * 3, simplex=10.0, tolerance=1e-6, most=3000 if kind == "lsq12" else 400)
        return _closeness(spark, p.matrix(), IDEAL[kind])

    f.__name__ = f"linear_fit_{kind}"
    f.__doc__ = f"L1 to L4, L6, L10, L28: the simplex finds the transform, {kind}, to 0.05 and half a millimetre."
    return query(_SIXTEEN)(f)


for _kind in IDEAL:
    _fit(_kind)


@query(_SIXTEEN)
def linear_fit_quaternion(spark, sf_dir):
    """The same with the rotation as a quaternion."""
    one, two = blobs(spark, sf_dir), _moved(spark, sf_dir, IDEAL["lsq6"])
    p = optimise.linear_fit(one, G20, two, G20, "lsq6", start=tr.Parameters(center=np.zeros(3)), step=(6.0,) * 3, simplex=5.0, tolerance=1e-5, quaternions=True)
    return _closeness(spark, p.matrix(), IDEAL["lsq6"])


@query(_SIXTEEN)
def linear_fit_bfgs(spark, sf_dir):
    """The same by limited-memory BFGS with forward differences."""
    one, two = blobs(spark, sf_dir), _moved(spark, sf_dir, IDEAL["lsq6"])
    p = optimise.linear_fit(one, G20, two, G20, "lsq6", start=tr.Parameters(center=np.zeros(3)), step=(6.0,) * 3, optimiser="bfgs")
    return _closeness(spark, p.matrix(), IDEAL["lsq6"])


@query("SELECT * FROM (VALUES ('mi'), ('nmi'), ('ssc'), ('vr'), ('xcorr'), ('zscore')) t(objective) CROSS JOIN (VALUES (0), (1)) c(candidate) CROSS JOIN (SELECT true AS same)")
def fit_objectives(spark, sf_dir):
    """All six objectives of two candidates, in Spark and in numpy, to the same values."""
    one, two = blobs(spark, sf_dir).persist(), _moved(spark, sf_dir, IDEAL["lsq6"]).persist()
    rows = []
    for name in ("mi", "nmi", "ssc", "vr", "xcorr", "zscore"):
        got = []
        for local in (False, True):
            e = optimise.Evaluator(one, G20, two, G20, name, (12.0,) * 3, local=local)
            got.append(e([np.eye(4), IDEAL["lsq6"]]))
            e.close()
        rows += [(name, k, bool(abs(a - b) <= 1e-9 * max(1.0, abs(a)))) for k, (a, b) in enumerate(zip(*got, strict=True))]
    return spark.createDataFrame(rows, "objective string, candidate int, same boolean")


@query("SELECT CAST(p.n AS INTEGER) AS parameter, CAST(11 AS BIGINT) AS n, true AS lowest_in_the_middle FROM range(12) p(n)")
def objective_curve(spark, sf_dir):
    """The objective along each of the twelve parameters, lowest where the volumes agree."""
    one = blobs(spark, sf_dir)
    e = optimise.Evaluator(one, G20, one, G20, step=(6.0,) * 3)
    rows = optimise.objective_curves(e, tr.Parameters(), 5)
    e.close()
    curve = spark.createDataFrame([(int(a), float(b), float(c), float(d)) for a, b, c, d in rows], "parameter int, offset double, value double, objective double")
    return curve.groupBy("parameter").agg(F.count("*").alias("n"), (F.abs(F.min_by("offset", "objective")) < 1e-9).alias("lowest_in_the_middle"))


@query("SELECT * FROM (VALUES ('centre', true), ('rotation', true), ('quaternion', true), ('scale', true)) t(part, ok)")
def principal_axis_start(spark, sf_dir):
    """Where a fit starts: centres of gravity, axes of covariance, scales of 1."""
    wide = blobs(spark, sf_dir).withColumn("value", F.greatest(F.col("value") - 6, F.lit(0.0)))
    moved = _moved(spark, sf_dir, IDEAL["lsq3"]).withColumn("value", F.greatest(F.col("value") - 6, F.lit(0.0)))
    p = optimise.principal_axis_start(wide, G20, moved, G20)
    q = tr.matrix_quaternion(tr.rotation(*p.rotations))
    rows = [("centre", bool(np.abs(p.translations - [5, 2, -6]).max() < 1)), ("rotation", bool(np.abs(p.rotations).max() < 0.1)), ("quaternion", bool(abs(q[3] - 1) < 0.01)), ("scale", bool((p.scales == 1).all()))]
    return spark.createDataFrame(rows, "part string, ok boolean")


def _search(spark, sf_dir, work, schema):
    """work(a, b) for each nation's two numbers, in Python, row by row of a table of any length."""
    k = F.col("n_nationkey")
    t = table(spark, sf_dir, "nation").select("n_nationkey", (k * 7 % 11 / 2.0).alias("a"), (k * 5 % 13 / 3.0 - 2).alias("b"))

    def run(parts):
        for p in parts:
            yield pd.DataFrame([(n, *work(a, b)) for n, a, b in p.itertuples(index=False)], columns=[c.split()[0] for c in schema.split(", ")])

    return t.mapInPandas(run, schema)


_AB = "n AS (SELECT n_nationkey, n_nationkey * 7 % 11 / 2.0::DOUBLE AS a, n_nationkey * 5 % 13 / 3.0::DOUBLE - 2 AS b FROM nation)"


@query(f"WITH {_AB} SELECT n_nationkey, round(a, 3) + 0 AS x, round(b, 3) + 0 AS y FROM n")
def simplex_search(spark, sf_dir):
    """L1, L2, L3: the simplex on bowls whose minima are known."""

    def work(a, b):
        s = optimise.Simplex([0.0, 0.0], 2.0, lambda ps: [float((p[0] - a) ** 2 + 3 * (p[1] - b) ** 2 + 1) for p in ps], 1e-14, 2000)
        return tuple(float(round(v, 3)) + 0.0 for v in s.run())

    return _search(spark, sf_dir, work, "n_nationkey int, x double, y double")


@query(f"WITH {_AB} SELECT n_nationkey, round(a, 3) + 0 AS x, true AS bracketed FROM n")
def line_search(spark, sf_dir):
    """Bracketing a minimum and golden section."""

    def work(a, b):
        def f(x):
            return (x - a) ** 2 + abs(b)

        p, q, r = optimise.bracket(f, -1.0, -0.9)
        return float(round(optimise.golden(f, min(p, r), max(p, r)), 3)) + 0.0, bool(f(q) <= f(p) and f(q) <= f(r))

    return _search(spark, sf_dir, work, "n_nationkey int, x double, bracketed boolean")


@query(f"WITH {_AB} SELECT n_nationkey, round(a, 3) + 0 AS x, round(b, 3) + 0 AS y FROM n")
def bfgs_search(spark, sf_dir):
    """Limited-memory BFGS on the same bowls."""

    def work(a, b):
        x = optimise.lbfgs([0.0, 0.0], lambda ps: [float((p[0] - a) ** 2 + 3 * (p[1] - b) ** 2) for p in ps], 1e-6, tolerance=0.0)
        return tuple(float(round(v, 3)) + 0.0 for v in x)

    return _search(spark, sf_dir, work, "n_nationkey int, x double, y double")


# --- programs ---------------------------------------------------------------------------------------------------------


def _kernel_sql(weights: list[float], a: str, b: str) -> str:
    return f"list_extract([{', '.join(repr(float(w)) for w in weights)}], CAST(abs({a} - {b}) + 1 AS BIGINT))"


_GAUSS = [math.exp(-d * d / (2 * (2 / 2.35482) ** 2)) / (2 / 2.35482 * math.sqrt(2 * math.pi)) for d in range(4)]
_EVERY = "v x JOIN v y ON y.vol = x.vol"


@query(f"WITH {V} SELECT CAST(x.vol AS VARCHAR) AS vol, x.i, x.j, x.k, round(sum(y.value * {' * '.join(_kernel_sql(_GAUSS, f'x.{a}', f'y.{a}') for a in AXES)}), 6) + 0 AS value FROM {_EVERY} GROUP BY x.vol, x.i, x.j, x.k")
def blur_fft_3d(spark, sf_dir):
    """H2, H3, H5, H6: separable blur by the Fourier transform of padded lines, held against the direct sum over the volume."""
    v = volumes(spark, sf_dir).select(F.col("vol").cast("string").alias("vol"), *AXES, "value")
    return stencil.fft_blur(v, (1.0, 1.0, 1.0), (2.0, 2.0, 2.0)).select("vol", *AXES, r6(F.col("value")).alias("value"))


def _slope_weights(length: int = 4) -> list[list[float]]:
    """What the Fourier derivative of a line padded to twice its length, from its last value straight to its first, makes of each value:
    plain sums of cosines and sines."""
    n = 2 * length
    out = [[0.0] * length for _ in range(length)]
    for q in range(length):
        line = [float(k == q) for k in range(length)]
        a, b = line[-1], line[0]
        line += [a + (b - a) * (k + 1) / (n - length + 1) for k in range(n - length)]
        for x in range(length):
            total = 0.0
            for f in range(n):
                rate = 2 * math.pi * (f if f < n / 2 else f - n) / n
                re = sum(v * math.cos(2 * math.pi * f * k / n) for k, v in enumerate(line))
                im = -sum(v * math.sin(2 * math.pi * f * k / n) for k, v in enumerate(line))
                # The real part of i rate (re + i im) e^(2 pi i f x / n).
                total += rate * (-re * math.sin(2 * math.pi * f * x / n) - im * math.cos(2 * math.pi * f * x / n))
            out[x][q] = total / n
    return out


_SLOPE = _slope_weights()


def _slope_sql(axis: str) -> str:
    cells = "[" + ", ".join(repr(float(v)) for row in _SLOPE for v in row) + "]"
    others = [a for a in AXES if a != axis]
    return f"SELECT x.vol, x.i, x.j, x.k, sum(y.value * list_extract({cells}, CAST(x.{axis} * 4 + y.{axis} + 1 AS BIGINT))) AS d FROM v x JOIN v y ON y.vol = x.vol AND " + " AND ".join(f"y.{a} = x.{a}" for a in others) + " GROUP BY x.vol, x.i, x.j, x.k"


@query(
    f"""WITH {V}, dx AS ({_slope_sql("i")}), dy AS ({_slope_sql("j")}), dz AS ({_slope_sql("k")})
SELECT CAST(vol AS VARCHAR) AS vol, i, j, k, round(dx.d, 6) + 0 AS dx, round(dy.d, 6) + 0 AS dy, round(dz.d, 6) + 0 AS dz, round(sqrt(dx.d*dx.d + dy.d*dy.d + dz.d*dz.d), 6) + 0 AS dxyz FROM dx JOIN dy USING (vol, i, j, k) JOIN dz USING (vol, i, j, k)"""
)
def gradient_fft_3d(spark, sf_dir):
    """Fourier derivatives along each axis and their magnitude."""
    v = volumes(spark, sf_dir).select(F.col("vol").cast("string").alias("vol"), *AXES, "value")
    return stencil.fft_gradient(v, (1.0, 1.0, 1.0)).select("vol", *AXES, *(r6(F.col(c)).alias(c) for c in ("dx", "dy", "dz", "dxyz")))


def _chamfer_sql() -> str:
    """The two raster passes of a 4 x 4 x 4 volume spelled out: a column for each voxel, replaced in turn; the border stays."""
    at = lambda p: (p // 16, p // 4 % 4, p % 4)
    inner = [p for p in range(64) if all(1 <= x <= 2 for x in at(p))]
    before = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) < (0, 0, 0)]
    steps, source = [], "s0"
    for n, (p, sign) in enumerate([(p, 1) for p in inner] + [(p, -1) for p in reversed(inner)], 1):
        i, j, k = at(p)
        near = [f"d{(i + sign * a) * 16 + (j + sign * b) * 4 + k + sign * c} + {math.sqrt(a * a + b * b + c * c)!r}" for a, b, c in before]
        steps.append(f"s{n} AS (SELECT * REPLACE (least(d{p}, {', '.join(near)}) AS d{p}) FROM {source})")
        source = f"s{n}"
    first = ", ".join(f"CASE WHEN embedding[{p + 1}] > 0.2 THEN 0.0::DOUBLE ELSE 50.0 END AS d{p}" for p in range(64))
    return f"""WITH s0 AS (SELECT vec_id AS vol, {first} FROM embeddings), {", ".join(steps)}, l AS (SELECT vol, [{", ".join(f"d{p}" for p in range(64))}] AS d FROM {source})
SELECT CAST(vol AS VARCHAR) AS vol, CAST(p // 16 AS INTEGER) AS i, CAST(p // 4 % 4 AS INTEGER) AS j, CAST(p % 4 AS INTEGER) AS k, round(d[p + 1], 6) + 0 AS value FROM l, range(64) t(p)"""


@query(_chamfer_sql())
def chamfer_distance(spark, sf_dir):
    """Chamfer distances by two raster passes from voxels that are not zero."""
    v = volumes(spark, sf_dir).select(F.col("vol").cast("string").alias("vol"), *AXES, (F.col("value") > 0.2).cast("double").alias("value"))
    return stencil.chamfer(v, (4, 4, 4), (1.0, 1.0, 1.0)).select("vol", *AXES, r6(F.col("value")).alias("value"))


def _box_sql_of(first, count) -> str:
    return f"SELECT CAST({count[0]} * {count[1]} * {count[2]} AS BIGINT) AS n, {first[0]}::DOUBLE AS x, {first[1]}::DOUBLE AS y, {first[2]}::DOUBLE AS z"


@query(f"{_box_sql_of((-33.0, -39.0, -21.0), (12, 11, 8))}, true AS same")
def crop_program(spark, sf_dir):
    """Bounds fixed to whole steps, and the volume resampled on what they hold."""
    v = blobs(spark, sf_dir)
    out, g = pipelines.crop_volume(v, G20, [(-33.0, 32.0), (-39.0, 20.0), (-21.0, 19.0)])
    shift = [round((a - b) / s) for a, b, s in zip(g.start, G20.start, G20.step, strict=True)]
    old = v.select(*((F.col(a) - n).alias(a) for a, n in zip(AXES, shift, strict=True)), F.col("value").alias("old"))
    both = out.join(old, list(AXES))
    return both.agg(F.count("*").alias("n"), *(F.lit(float(x)).alias(c) for x, c in zip(g.start, XYZ, strict=True)), F.bool_and(F.abs(F.col("value") - F.col("old")) < 1e-9).alias("same"))


@query("SELECT CAST(26 * 26 * 26 AS BIGINT) AS n, true AS same, true AS empty, CAST(10 * 10 * 10 AS BIGINT) AS reduced, 2.5::DOUBLE AS step")
def pad_and_reduce(spark, sf_dir):
    """Room for the widest blur, filled with zeros; fine steps doubled."""
    v = blobs(spark, sf_dir)
    out, g = pipelines.pad_volume(v, G20, [8.0, 14.0])
    n = [round((a - b) / s) for a, b, s in zip(G20.start, g.start, G20.step, strict=True)]
    old = v.select(*((F.col(a) + k).alias(a) for a, k in zip(AXES, n, strict=True)), F.col("value").alias("old"))
    both = out.join(old, list(AXES), "left")
    fine = Geometry((20, 20, 20), (1.25, 1.25, 1.25))
    small, s = pipelines.reduce_volume(v, fine)
    got = both.agg(F.count("*").alias("n"), F.bool_and(F.abs(F.col("value") - F.coalesce("old", "value")) < 1e-9).alias("same"), F.bool_and(F.col("old").isNotNull() | (F.col("value") == 0)).alias("empty"))
    return got.crossJoin(F.broadcast(small.agg(F.count("*").alias("reduced")))).withColumn("step", F.lit(float(s.step[0])))  # one row


@query("SELECT CAST(8000 AS BIGINT) AS n, true AS smoother, true AS mass, true AS border")
def blur_program(spark, sf_dir):
    """Apodised and blurred: smaller range, nearly all of the inner mass, little at the border."""
    v = blobs(spark, sf_dir)
    plain, apodised = pipelines.blurred(v, G20, 12.0, apodise=False), pipelines.blurred(v, G20, 12.0)
    both = v.join(plain.select(*AXES, F.col("value").alias("p")), list(AXES)).join(apodised.select(*AXES, F.col("value").alias("q")), list(AXES))
    edge = F.least("i", "j", "k") == 0
    return both.agg(F.count("*").alias("n"), (F.max("p") < F.max("value")).alias("smoother"), (F.abs(F.sum("p") / F.sum("value") - 1) < 0.1).alias("mass"), (F.sum(F.when(edge, F.col("q"))) <= F.sum(F.when(edge, F.col("p")))).alias("border"))


@query("SELECT CAST(b.n AS DOUBLE) AS fwhm, CAST(8000 AS BIGINT) AS n, true AS ordered FROM (VALUES (16), (8), (4), (2)) b(n)")
def model_levels(spark, sf_dir):
    """M8: a model's blurs, each flatter than the next finer one."""
    out, last = None, None
    for f, df in pipelines.build_model(blobs(spark, sf_dir), G20).items():
        top = df.agg(F.max("value").alias("top"), F.count("*").alias("n")).first()
        row = (float(f), int(top["n"]), bool(last is None or top["top"] >= last))
        last = top["top"]
        out = [*(out or []), row]
    return spark.createDataFrame(out, "fwhm double, n long, ordered boolean")


@query("SELECT CAST(8000 AS BIGINT) AS n, true AS alike")
def resample_program(spark, sf_dir):
    """A volume seen through a transform on another's grid."""
    m = IDEAL["lsq6"]
    got = sample.resample(blobs(spark, sf_dir), G20, G20, m)
    want = _moved(spark, sf_dir, m).select(*AXES, F.col("value").alias("w"))
    inner = got.join(want, list(AXES))
    return inner.agg(F.count("*").alias("n"), (measures.raw_correlation(F.col("value"), F.col("w")) > 0.98).alias("alike"))


@query(_SIXTEEN)
def intra_subject(spark, sf_dir):
    """Threshold, fits at two blurs, resampling."""
    ideal = tr.from_degrees((4, -2, 3), (2, -3, 2))
    p, moved = pipelines.intra_subject(blobs(spark, sf_dir), G20, _moved(spark, sf_dir, ideal), G20)
    assert moved.count() == 8000
    return _closeness(spark, p.matrix(), ideal, 0.1, 2.0)


@query(_SIXTEEN)
def stereotaxic(spark, sf_dir):
    """The coarse-to-fine fit to a model, one step of it within the model's mask."""
    ideal = tr.from_degrees((4, -2, 3), (2, -3, 2), (1.05, 1.05, 1.05))
    model = _moved(spark, sf_dir, ideal)
    p = pipelines.stereotaxic(blobs(spark, sf_dir), G20, model, G20, model.withColumn("value", (F.col("value") > 1).cast("double")))
    return _closeness(spark, p.matrix(), ideal, 0.1, 3.0)


@query("SELECT * FROM (VALUES (0, true), (1, true), (2, true)) t(axis, ok)")
def register_call(spark, sf_dir):
    """The library call, timed."""
    ideal = IDEAL["lsq3"]
    p = optimise.timed("register", lambda: pipelines.register(blobs(spark, sf_dir), G20, _moved(spark, sf_dir, ideal), G20, "lsq3", start=tr.Parameters(), step=(6.0,) * 3, simplex=5.0, tolerance=1e-5))
    return spark.createDataFrame([(k, bool(abs(p.matrix()[k, 3] - ideal[k, 3]) < 0.5)) for k in range(3)], "axis int, ok boolean")


@query("SELECT CAST(14 * 14 * 14 AS BIGINT) AS n, true AS masked, true AS cropped")
def special_preprocess(spark, sf_dir):
    """M6: the mask brought onto the volume through a transform, the head cropped to it, blurred, and the field's grid cropped alike."""
    v = blobs(spark, sf_dir)
    mask = v.withColumn("value", (F.least("i", "j", "k") >= 3).cast("double") * (F.greatest("i", "j", "k") <= 16).cast("double"))
    out, g = pipelines.special_preprocess(v, G20, mask, G20, np.eye(4), 8.0)
    box = lattice.volume_bounds(g)
    inside = all(a >= -39.0 - 1e-9 and b <= 39.0 + 1e-9 for a, b in box)
    return out.agg(F.count("*").alias("n"), (F.max("value") > 0).alias("masked"), F.lit(inside).alias("cropped"))
