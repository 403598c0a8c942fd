"""Transforms as tables: lists of steps, tolerances, applying them to points, deformation fields."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import affine_inverse
from ..functions.transforms import procrustes_moments
from ..model import AXES, Geometry, affine, grid, rounded
from .sample import XYZ, evaluate, trilinear_columns

DISPLACEMENT = ("dx", "dy", "dz")


def concat(first: DataFrame, second: DataFrame) -> DataFrame:
    """second's steps after first's, numbered on."""
    last = first.agg(F.coalesce(F.max("seq") + 1, F.lit(0)).alias("_n"))
    return first.unionByName(second.crossJoin(F.broadcast(last)).withColumn("seq", (F.col("seq") + F.col("_n")).cast("int")).drop("_n"))


def invert(xfm: DataFrame, by: str = "xfm_id") -> DataFrame:
    """Steps in reverse, flags turned."""
    top = F.max("seq").over(Window.partitionBy(by))
    return xfm.withColumn("seq", (top - F.col("seq")).cast("int")).withColumn("invert_flag", ~F.col("invert_flag"))


def parse_numbers(text: str) -> list[int]:
    """"1-3,5" to 1, 2, 3, 5."""
    out: list[int] = []
    for part in text.replace(" ", "").split(","):
        a, dash, b = part.partition("-")
        out += range(int(a), int(b or a) + 1) if dash else [int(a)]
    return out


def extract(xfm: DataFrame, numbers: str, by: str = "xfm_id") -> DataFrame:
    """The named steps (from 0), renumbered."""
    kept = xfm.where(F.col("seq").isin(parse_numbers(numbers)))
    return kept.withColumn("seq", (F.row_number().over(Window.partitionBy(by).orderBy("seq")) - 1).cast("int"))


def linear_part(xfm: DataFrame) -> DataFrame:
    return xfm.where(F.col("type") == "Linear")


def split_last_warp(xfm: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all steps before the last grid step, that step)."""
    last = F.max(F.when(F.col("type") == "Grid_Transform", F.col("seq"))).over(Window.partitionBy("xfm_id"))
    marked = xfm.withColumn("_l", last)
    return marked.where("_l is null or seq < _l").drop("_l"), marked.where("seq = _l").drop("_l")


def displacement_at(points: DataFrame, field: DataFrame, g: Geometry, degree: int = 0) -> DataFrame:
    """points (world) with dx, dy, dz of a grid; 0 outside."""
    voxel = points.withColumns({f"_p{c}": F.col(c) for c in XYZ}).withColumns(dict(zip(XYZ, affine(g.to_voxel(), *XYZ), strict=True)))
    if degree == 0:
        voxel = trilinear_columns(voxel, field, g.size, DISPLACEMENT)
    else:
        for d in DISPLACEMENT:
            voxel = evaluate(voxel, field.select(*AXES, F.col(d).alias("value")), g.size, degree, d)
    return voxel.withColumns({d: F.coalesce(d, F.lit(0.0)) for d in DISPLACEMENT}).withColumns({c: F.col(f"_p{c}") for c in XYZ}).drop(*(f"_p{c}" for c in XYZ))


def grid_forward(points: DataFrame, field: DataFrame, g: Geometry, degree: int = 0) -> DataFrame:
    moved = displacement_at(points, field, g, degree)
    return moved.withColumns({c: F.col(c) + F.col(d) for c, d in zip(XYZ, DISPLACEMENT, strict=True)}).drop(*DISPLACEMENT)


def grid_inverse(points: DataFrame, field: DataFrame, g: Geometry, tries: int = 10, step: float = 0.67, tolerance: float = 0.05) -> DataFrame:
    """Fixed-point inverse: up to `tries` corrections by `step` of what is missing; keeps each point's best guess, stops when all are near."""
    aim = points.select("pid", *(F.col(c).alias(f"_t{c}") for c in XYZ))
    rest = [c for c in points.columns if c not in ("pid", *XYZ)]
    now = displacement_at(points.select("pid", *XYZ), field, g)
    now = now.select("pid", *((F.col(c) - F.col(d)).alias(c) for c, d in zip(XYZ, DISPLACEMENT, strict=True)))
    best = None
    for _ in range(tries):
        ahead = displacement_at(now, field, g).join(aim, "pid")
        miss = [F.col(f"_t{c}") - F.col(c) - F.col(d) for c, d in zip(XYZ, DISPLACEMENT, strict=True)]
        ahead = ahead.withColumns({f"_m{c}": m for c, m in zip(XYZ, miss, strict=True)}).withColumn("_e", F.sqrt(sum(F.col(f"_m{c}") ** 2 for c in XYZ)))
        if best is not None:
            ahead = ahead.join(best.select("pid", F.col("_e").alias("_be"), *(F.col(c).alias(f"_b{c}") for c in XYZ)), "pid")
            better = F.col("_e") < F.col("_be")
            kept = {c: F.when(better, F.col(c)).otherwise(F.col(f"_b{c}")) for c in XYZ}
            best = ahead.select("pid", *(v.alias(c) for c, v in kept.items()), F.least("_e", "_be").alias("_e"))
        else:
            best = ahead.select("pid", *XYZ, "_e")
        best = best.persist()
        if best.where(F.col("_e") > tolerance).isEmpty():
            break
        now = ahead.select("pid", *((F.col(c) + step * F.col(f"_m{c}")).alias(c) for c in XYZ))
    return points.select("pid", *rest).join(best.select("pid", *XYZ), "pid")


def apply(points: DataFrame, steps: list[dict], inverse: bool = False) -> DataFrame:
    """Points through a list of steps: {"type": "Linear", "matrix"}, {"type": "Grid_Transform", "field", "geometry"},
    {"type": "Thin_Plate_Spline_Transform", "points", "displacements"} or {"type": "User_Transform", "forward", "backward"}, each with "invert_flag"."""
    for s in reversed(steps) if inverse else steps:
        back = bool(s.get("invert_flag")) != inverse
        if s["type"] == "Linear":
            m = np.linalg.inv(s["matrix"]) if back else np.asarray(s["matrix"])
            points = points.withColumns(dict(zip(XYZ, affine(m, *XYZ), strict=True)))
        elif s["type"] == "Grid_Transform":
            points = (grid_inverse if back else grid_forward)(points, s["field"], s["geometry"])
        elif s["type"] == "Thin_Plate_Spline_Transform":
            points = (spline_inverse if back else spline_forward)(points, s["points"], s["displacements"])
        else:
            points = s["backward" if back else "forward"](points)
    return points


def spline_forward(points: DataFrame, centres, weights) -> DataFrame:
    """Thin-plate spline in 3-D: the first rows of weights belong to the centres (times distance), the last four are constant and linear."""
    c, w = np.asarray(centres, float), np.asarray(weights, float)
    at = [F.col(a) for a in XYZ]
    r = [F.sqrt(sum((p - F.lit(float(x))) ** 2 for p, x in zip(at, row, strict=True))) for row in c]
    n = len(c)
    out = {a: sum((d * F.lit(float(w[k, q])) for k, d in enumerate(r)), F.lit(float(w[n, q]))) + sum(p * F.lit(float(w[n + 1 + m, q])) for m, p in enumerate(at)) for q, a in enumerate(XYZ)}
    return points.withColumns(out)


def spline_inverse(points: DataFrame, centres, weights, tries: int = 30) -> DataFrame:
    """Newton steps with the spline's own derivative, in vectorised Python."""
    c, w = np.asarray(centres, float), np.asarray(weights, float)
    n = len(c)

    def run(parts):
        for t in parts:
            aim = t[list(XYZ)].to_numpy(float)
            x = aim.copy()
            for _ in range(tries):
                d = x[:, None, :] - c
                r = np.sqrt((d * d).sum(-1))
                f = r @ w[:n] + w[n] + x @ w[n + 1 : n + 4]
                j = np.einsum("pnk,nq->pqk", d / np.maximum(r, 1e-12)[..., None], w[:n]) + w[n + 1 : n + 4].T
                x = x + np.linalg.solve(j, (aim - f)[..., None])[..., 0]
                if np.abs(aim - f).max(initial=0) < 1e-9:
                    break
            t[list(XYZ)] = x
            yield t

    return points.mapInPandas(run, points.schema)


def spline_of(source, target) -> tuple[np.ndarray, np.ndarray]:
    """(centres, weights) of the spline that takes source landmarks to target landmarks."""
    a, b = np.asarray(source, float), np.asarray(target, float)
    n = len(a)
    k = np.sqrt(((a[:, None] - a[None]) ** 2).sum(-1))
    p = np.column_stack([np.ones(n), a])
    whole = np.block([[k, p], [p.T, np.zeros((4, 4))]])
    return a, np.linalg.lstsq(whole, np.vstack([b, np.zeros((4, 3))]), rcond=None)[0]


def scaled_spline(centres, weights, fraction: float) -> tuple[np.ndarray, np.ndarray]:
    """A spline that goes a fraction of the way of another one."""
    w = np.asarray(weights, float) * fraction
    w[len(centres) + 1 :] += np.eye(3) * (1 - fraction)
    return np.asarray(centres, float), w


def inverted_linear(xfms: DataFrame) -> DataFrame:
    """The inverse matrices of linear steps, flags cleared: an inverted step's matrix is its inverse already."""
    m = [[F.element_at("matrix", 4 * r + c + 1) for c in range(4)] for r in range(3)]
    back = F.array(*(x for row in affine_inverse(m) for x in row))
    kept = F.when(F.col("invert_flag"), F.col("matrix")).otherwise(back)
    return linear_part(xfms).withColumn("matrix", kept).withColumn("invert_flag", F.lit(False))


def printed(xfms: DataFrame, by: str = "xfm_id") -> DataFrame:
    """One line for each list of steps, in their order."""
    steps = F.array_sort(F.collect_list(F.struct("seq", "type")))
    return xfms.groupBy(by).agg(F.array_join(F.transform(steps, lambda s: F.concat_ws(":", s["seq"], s["type"])), " ").alias("line"))


def centroid(points: DataFrame, by: str, names=XYZ) -> DataFrame:
    return points.groupBy(by).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"c{a}") for a, c in zip(XYZ, names, strict=True)))


def procrustes_of(pairs: DataFrame, by: str, a=XYZ, b=("bx", "by", "bz")) -> DataFrame:
    """Translation, centroid, rotation and scale that bring each group's points a onto b: one row of moments a group, then 3x3 algebra."""
    n, s = F.count("*"), lambda c: F.sum(F.col(c))
    cross = [(F.sum(F.col(p) * F.col(q)) - s(p) * s(q) / n).alias(f"m{j}{k}") for j, p in enumerate(a) for k, q in enumerate(b)]
    spread = sum((F.sum(F.col(p) * F.col(p)) - s(p) * s(p) / n for p in a), F.lit(0.0)).alias("spread")
    moments = pairs.groupBy(by).agg(n.alias("n"), *(F.avg(p).alias(f"c{x}") for p, x in zip(a, XYZ, strict=True)), *(F.avg(q).alias(f"d{x}") for q, x in zip(b, XYZ, strict=True)), *cross, spread)
    turn = [f"r{r}{c}" for r in range(3) for c in range(3)]
    schema = ", ".join([f"{by} {dict(moments.dtypes)[by]}", "n long", *(f"c{x} double" for x in XYZ), *(f"t{x} double" for x in XYZ), "scale double", *(f"{t} double" for t in turn)])

    def run(parts):
        for t in parts:
            rows = []
            for r in t.to_dict("records"):
                shift, centre, rot, scale = procrustes_moments(r["n"], [r[f"c{x}"] for x in XYZ], [r[f"d{x}"] for x in XYZ], np.array([[r[f"m{j}{k}"] for k in range(3)] for j in range(3)]), r["spread"])
                rows.append([r[by], r["n"], *centre, *shift, scale, *rot.ravel()])
            yield t.__class__(rows, columns=[by, "n", *(f"c{x}" for x in XYZ), *(f"t{x}" for x in XYZ), "scale", *turn])

    return moments.mapInPandas(run, schema)


def scale_field(field: DataFrame, fraction: float) -> DataFrame:
    return field.withColumns({c: F.col(c) * fraction for c in DISPLACEMENT})


def new_field(spark, g: Geometry, extra: int = 5, vol: str = "field") -> tuple[DataFrame, Geometry]:
    """A field of zeros over a lattice, a few nodes wider and shifted by half of that."""
    size = tuple(n + extra if n > 1 else 1 for n in g.size)
    start = tuple(b - s * extra / 2 if n > 1 else b for b, s, n in zip(g.start, g.step, g.size, strict=True))
    wide = Geometry(size, g.step, start, g.dircos)
    return grid(spark, size).select(F.lit(vol).alias("vol"), *AXES, *(F.lit(0.0).alias(c) for c in DISPLACEMENT)), wide


def resample_field(spark, g: Geometry, steps: list[dict], vol: str = "field") -> DataFrame:
    """A field on a lattice: where a transform takes each node, less the node."""
    world = grid(spark, g.size).withColumns(dict(zip(XYZ, affine(g.to_world(), *AXES), strict=True)))
    raster = (F.col("i").cast("long") * g.size[1] + F.col("j")) * g.size[2] + F.col("k")
    start = world.withColumn("pid", raster).withColumns({f"_o{c}": F.col(c) for c in XYZ})
    moved = apply(start, steps)
    return moved.select(F.lit(vol).alias("vol"), *AXES, *((F.col(c) - F.col(f"_o{c}")).alias(d) for c, d in zip(XYZ, DISPLACEMENT, strict=True)))


def field_of(spark, g: Geometry, parts: dict, vol: str = "field") -> DataFrame:
    """A field whose displacements are columns over the nodes' world coordinates x, y, z."""
    world = grid(spark, g.size).withColumns(dict(zip(XYZ, affine(g.to_world(), *AXES), strict=True)))
    return world.select(F.lit(vol).alias("vol"), *AXES, *(parts[c].alias(c) for c in DISPLACEMENT))


def reverse_field(spark, field: DataFrame, g: Geometry, like: Geometry | None = None) -> DataFrame:
    return resample_field(spark, like or g, [{"type": "Grid_Transform", "field": field, "geometry": g, "invert_flag": True}])


def field_lines(field: DataFrame, g: Geometry, times: float = 1.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """A segment from each node to where it is moved."""
    a = affine(g.to_world(), *AXES)
    return field.select(*keep, *(x.alias(f"{c}1") for x, c in zip(a, XYZ, strict=True)), *((x + F.col(d) * times).alias(f"{c}2") for x, c, d in zip(a, XYZ, DISPLACEMENT, strict=True)))


def tree_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Segments of a spanning tree: nodes(id, x, y, z), edges(a, b)."""
    end = lambda n: nodes.select(F.col("id").alias("ab"[n - 1]), *(F.col(c).alias(f"{c}{n}") for c in XYZ))
    return edges.join(end(1), "a").join(end(2), "b")


def line_points(lines: DataFrame, spacing: float) -> DataFrame:
    """Points along each segment (x1..z2), its ends among them, no further apart than `spacing` on any axis."""
    n = F.greatest(*(F.abs(F.col(f"{c}2") - F.col(f"{c}1")) for c in XYZ), F.lit(float(spacing)))
    each = lines.withColumn("_n", F.ceil(n / spacing).cast("int")).withColumn("_u", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    return each.withColumns({c: F.col(f"{c}1") + (F.col(f"{c}2") - F.col(f"{c}1")) * (F.col("_u") / F.col("_n")) for c in XYZ}).drop("_n", "_u")


def surface_points(triangles: DataFrame, spacing: float) -> DataFrame:
    """Points of each triangle (x1..z3), its corners among them: a lattice along two edges, fine enough for the spacing on every axis.

    Polygons with more corners are fans of triangles.
    """
    sides = [F.abs(F.col(f"{c}{p}") - F.col(f"{c}{q}")) for c in XYZ for p, q in ((1, 2), (2, 3), (3, 1))]
    n = F.ceil(F.greatest(*sides, F.lit(float(spacing))) / spacing).cast("int")
    rows = triangles.withColumn("_n", n).withColumn("_u", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    each = rows.withColumn("_v", F.explode(F.sequence(F.lit(0), F.col("_n") - F.col("_u"))))
    at = {c: F.col(f"{c}1") + (F.col(f"{c}2") - F.col(f"{c}1")) * (F.col("_u") / F.col("_n")) + (F.col(f"{c}3") - F.col(f"{c}1")) * (F.col("_v") / F.col("_n")) for c in XYZ}
    return each.withColumns(at).drop("_n", "_u", "_v")


def rasterise(points: DataFrame, g: Geometry, label: str = "label", order: str = "ord") -> DataFrame:
    """The label of the last object that touches each voxel."""
    at = points.withColumns(dict(zip(AXES, (rounded(c) for c in affine(g.to_voxel(), *XYZ)), strict=True)))
    inside = F.lit(True)
    for a, n in zip(AXES, g.size, strict=True):
        inside = inside & F.col(a).between(0, n - 1)
    return at.where(inside).groupBy(*AXES).agg(F.max_by(label, order).alias("value"))
