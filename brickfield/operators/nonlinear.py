"""Nonlinear fits: displacement of every lattice node, iteration by iteration.

One iteration is a fixed number of joins whatever the number of nodes: candidate shifts of each node's sub-lattice are rows,
gathered in the target and reduced to a similarity for each (node, shift); a quadratic through the 27 similarities gives the
displacement. Then neighbours are averaged. The field so far is staged by checkpoint() where a checkpoint folder is set.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import AXES, Geometry, affine, grid
from . import measures
from .sample import XYZ, nearest, sub_lattice, transformed, trilinear
from .stencil import DISPLACEMENT, extrapolate, neighbour_mean, quadratic_step, smooth
from .xfmops import grid_forward


@dataclass
class Options:
    """What a fit is told; the numbers are the documented defaults."""

    objective: str = "xcorr"
    iterations: int = 4
    weight: float = 0.6
    stiffness: float = 0.5
    similarity_ratio: float = 0.5
    longest: float = 50.0
    sub_nodes: int = 5
    diameter: float = 24.0
    threshold: float = 0.0
    #: How far candidate shifts reach, in node distances, at first; each iteration's reach is `narrowing` of the one before, not under `finest`.
    reach: float = 1.0
    narrowing: float = 0.75
    finest: float = 0.2


OBJECTIVE_NAMES = ("xcorr", "diff", "sqdiff", "label", "chamfer", "corrcoeff", "opticalflow")


def objective_option(name: str) -> str:
    """The whole name is needed; anything else is xcorr."""
    return name if name in OBJECTIVE_NAMES else "xcorr"


def objective_column(name: Column) -> Column:
    """The same for a column of names."""
    return F.when(name.isin(*OBJECTIVE_NAMES), name).otherwise("xcorr")


def start_from_neighbours(field: DataFrame, by=("vol",)) -> DataFrame:
    """sx, sy, sz: the six neighbours' mean displacement less a node's own, where its search starts; 0 without neighbours."""
    m = neighbour_mean(field, DISPLACEMENT, 6, by)
    out = {f"s{c[1]}": F.when(F.col("n_neighbours") > 0, F.col(f"mean_{c}") - F.col(c)).otherwise(0.0) for c in DISPLACEMENT}
    return m.withColumns(out).drop("n_neighbours", *(f"mean_{c}" for c in DISPLACEMENT))


def optical_flow(v1: Column, v2: Column, slopes: list[Column], spread: float) -> list[Column]:
    """(v1 - v2) / slope on each axis whose slope is over 2 % of the range; else 0."""
    return [F.when(F.abs(s) > 0.02 * spread, (v1 - v2) / s).otherwise(0.0) for s in slopes]


def chamfer_step(distance: Column, slopes: list[Column], capture: float) -> list[Column]:
    """A step of the distance against its gradient, up to 3.8 times the capture range."""
    norm = F.sqrt(sum(s * s for s in slopes))
    near = (distance < 3.8 * capture) & (norm > 0)
    return [F.when(near, -distance * s / norm).otherwise(0.0) for s in slopes]


def _settle(df: DataFrame) -> DataFrame:
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def node_shifts(field: DataFrame, g: Geometry, source: DataFrame, source_g: Geometry, target: DataFrame, target_g: Geometry, o: Options) -> DataFrame:
    """du, dv, dw (in shifts, of o.reach nodes) for every node where a quadratic through 27 shifted similarities has a maximum; null elsewhere."""
    raster = (F.col("i").cast("long") * g.size[1] + F.col("j")) * g.size[2] + F.col("k")
    world = affine(g.to_world(), *AXES)
    nodes = field.select(raster.alias("node"), *AXES, *DISPLACEMENT, *(w.alias(c) for w, c in zip(world, XYZ, strict=True)))
    points = sub_lattice(nodes, (o.diameter,) * 3, o.sub_nodes).withColumn("pid", F.col("node") * max(1, o.sub_nodes) ** 3 + F.col("point"))
    near = nearest(transformed(points, source_g.to_voxel()), source, source_g.size, "v1").where(F.col("v1") > o.threshold)
    back = source_g.to_world()
    live = near.withColumns(dict(zip(XYZ, affine(back, *XYZ), strict=True)))
    shifts = F.array(*(F.struct(F.lit(n).alias("n"), *(F.lit(float(d)).alias(f"s{c}") for d, c in zip(s, XYZ, strict=True))) for n, s in enumerate(itertools.product((-1, 0, 1), repeat=3))))
    each = live.withColumn("_s", F.explode(shifts))
    moved = each.select("node", F.col("_s.n").alias("n"), "v1", (F.col("pid") * 27 + F.col("_s.n")).alias("pid"), *((F.col(c) + F.col(d) + F.col(f"_s.s{c}") * abs(s) * o.reach).alias(c) for c, d, s in zip(XYZ, DISPLACEMENT, g.step, strict=True)))
    both = trilinear(transformed(moved, target_g.to_voxel()), target, target_g.size, "v2").where("v2 is not null")
    sim = both.groupBy("node", "n").agg(measures.LOCAL[objective_option(o.objective)](F.col("v1"), F.col("v2")).alias("s"))
    wide = sim.groupBy("node").agg(*(F.max(F.when(F.col("n") == n, F.col("s"))).alias(f"q{n}") for n in range(27)))
    at = lambda a, b, c: F.col(f"q{(a + 1) * 9 + (b + 1) * 3 + c + 1}")
    e = [(1, 0, 0), (0, 1, 0), (0, 0, 1)]
    p = lambda *v: at(*(int(sum(x)) for x in zip(*v, strict=True)))
    neg = lambda v: tuple(-x for x in v)
    made = {n: (p(v) - p(neg(v))) / 2 for n, v in zip("uvw", e, strict=True)}
    made |= {n * 2: p(v) - 2 * at(0, 0, 0) + p(neg(v)) for n, v in zip("uvw", e, strict=True)}
    made |= {m: (p(a, b) - p(a, neg(b)) - p(neg(a), b) + p(neg(a), neg(b))) / 4 for m, a, b in (("uv", e[0], e[1]), ("uw", e[0], e[2]), ("vw", e[1], e[2]))}
    fitted = wide.withColumns(made).select("node", *(c.alias(n) for n, c in quadratic_step(-1.0).items()))
    return nodes.select("node", *AXES).join(fitted, "node", "left").drop("node")


def iterate(field: DataFrame, g: Geometry, shifts: DataFrame, o: Options) -> DataFrame:
    """The field after one iteration: weighted additions where estimated, extrapolation elsewhere, smoothing."""
    parts = dict(zip(DISPLACEMENT, zip(("du", "dv", "dw"), g.step, strict=True), strict=True))
    extra = field.select("vol", *AXES).join(shifts, list(AXES), "left")
    extra = extra.select("vol", *AXES, *(F.coalesce(F.col(n) * abs(s) * o.reach, F.lit(0.0)).alias(c) for c, (n, s) in parts.items()), F.col("du").isNotNull().alias("estimated"))
    filled = extrapolate(extra).select("vol", *AXES, *(F.col(c).alias(f"_{c}") for c in DISPLACEMENT))
    added = field.join(filled, ["vol", *AXES])
    limit = F.sqrt(sum((F.col(c) + o.weight * F.col(f"_{c}")) ** 2 for c in DISPLACEMENT)) <= o.longest
    added = added.withColumns({c: F.when(limit, F.col(c) + o.weight * F.col(f"_{c}")).otherwise(F.col(c)) for c in DISPLACEMENT}).drop(*(f"_{c}" for c in DISPLACEMENT))
    return smooth(added, o.stiffness)


def nonlinear_fit(source: DataFrame, source_g: Geometry, target: DataFrame, target_g: Geometry, node_step: float = 8.0, options: Options | None = None, start: DataFrame | None = None) -> tuple[DataFrame, Geometry]:
    """(displacement field, its geometry): source world point + field = target world point."""
    o = options or Options()
    low = np.array([min(a, b) for a, b in zip(source_g.start, (s + (n - 1) * d for s, n, d in zip(source_g.start, source_g.size, source_g.step, strict=True)), strict=True)])
    extent = np.abs(np.asarray(source_g.step)) * (np.asarray(source_g.size) - 1)
    g = Geometry(tuple(int(x) + 1 for x in extent // node_step), (node_step,) * 3, tuple(low))
    field = start if start is not None else grid(source.sparkSession, g.size).select(F.lit("field").alias("vol"), *AXES, *(F.lit(0.0).alias(c) for c in DISPLACEMENT))
    for k in range(o.iterations):
        now = replace(o, reach=max(o.finest, o.reach * o.narrowing**k))
        field = _settle(iterate(field, g, node_shifts(field, g, source, source_g, target, target_g, now), now))
    return field, g


def resample_through(source: DataFrame, source_g: Geometry, like: Geometry, field: DataFrame, g: Geometry, vol: str = "warped") -> DataFrame:
    """source pulled back to the grid of `like`: each voxel takes the value where the field sends it."""
    raster = (F.col("i").cast("long") * like.size[1] + F.col("j")) * like.size[2] + F.col("k")
    nodes = grid(source.sparkSession, like.size)
    points = nodes.select(raster.alias("pid"), *AXES, *(w.alias(c) for w, c in zip(affine(like.to_world(), *AXES), XYZ, strict=True)))
    moved = transformed(grid_forward(points, field, g), source_g.to_voxel())
    return trilinear(moved, source, source_g.size).select(F.lit(vol).alias("vol"), *AXES, F.coalesce("sample", F.lit(0.0)).alias("value"))
