"""Multi-step programs: coarse-to-fine linear and nonlinear fits, preprocessing, cropping, class volumes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.transforms import Parameters, check_scale
from ..model import AXES, Geometry
from ..operators import lattice, measures, nonlinear, optimise, stencil, voxelwise
from ..operators.sample import resample
from ..operators.xfmops import grid_forward


@dataclass
class LinearStep:
    kind: str
    fwhm: float
    simplex: float
    step: float = 4.0
    tolerance: float = 0.004
    gradient: bool = False
    masked: bool = False


# The steps of the stereotaxic fit; None checks the scales.
STEREOTAXIC: list[LinearStep | None] = [
    LinearStep("lsq7", 16, 20, tolerance=0.01),
    LinearStep("lsq7", 8, 5),
    LinearStep("lsq7", 8, 2, gradient=True, masked=True),
    LinearStep("lsq9", 8, 5),
    None,
    LinearStep("lsq9", 8, 2),
]
#: Nonlinear levels: blur, node distance, iterations.
LEVELS = [(16.0, 16.0, 10), (8.0, 8.0, 10), (4.0, 4.0, 5), (4.0, 4.0, 5), (2.0, 2.0, 3)]
INTRA_SUBJECT = [LinearStep("lsq6", 7.3, 3), LinearStep("lsq6", 4.3, 2)]


def blurred(voxels: DataFrame, g: Geometry, fwhm: float, gradient: bool = False, apodise: bool = True) -> DataFrame:
    """Apodised, blurred, and turned into its gradient magnitude if asked for."""
    if apodise:
        voxels = voxelwise.apodize(voxels, g.size, g.step, (fwhm,) * 3)
    out = stencil.blur(voxels, g.step, (fwhm,) * 3)
    if gradient:
        d = stencil.derivatives(out)
        out = d.select("vol", *AXES, F.coalesce(voxelwise.gradient_magnitude(F.col("u"), F.col("v"), F.col("w")), F.lit(0.0)).alias("value"))
    return out


def reduce_volume(voxels: DataFrame, g: Geometry) -> tuple[DataFrame, Geometry]:
    """Fine steps doubled, by resampling."""
    step = lattice.guess_subsample(g.step)
    size = tuple(max(1, int(np.ceil(n * s / t))) for n, s, t in zip(g.size, g.step, step, strict=True))
    like = Geometry(size, tuple(step), g.start, g.dircos)
    return resample(voxels, g, like, np.eye(4)), like


def pad_volume(voxels: DataFrame, g: Geometry, fwhms: list[float]) -> tuple[DataFrame, Geometry]:
    """Room for the widest blur on every side, filled with 0."""
    n = [round(lattice.pad_amount(fwhms, s) / abs(s)) for s in g.step]
    like = Geometry(tuple(a + 2 * b for a, b in zip(g.size, n, strict=True)), g.step, tuple(b - k * s for b, k, s in zip(g.start, n, g.step, strict=True)), g.dircos)
    return resample(voxels, g, like, np.eye(4), -1), like


def crop_volume(voxels: DataFrame, g: Geometry, bounds: list[tuple[float, float]]) -> tuple[DataFrame, Geometry]:
    fixed = lattice.fix_bounds(bounds, g.step)
    size = tuple(round((b - a) / s) + 1 for (a, b), s in zip(fixed, g.step, strict=True))
    like = Geometry(size, g.step, tuple(a for a, _ in fixed), g.dircos)
    return resample(voxels, g, like, np.eye(4), -1), like


def special_preprocess(voxels: DataFrame, g: Geometry, mask: DataFrame, mask_g: Geometry, transform: np.ndarray, fwhm: float) -> tuple[DataFrame, Geometry]:
    """The mask seen through a transform on the volume's grid, the volume within it, cropped to the mask's box and blurred; and the
    geometry of that box, which a field's grid is cropped to as well."""
    own = resample(mask, mask_g, g, transform, -1).select(*AXES, F.col("value").alias("_m"))
    inside = own.where("_m > 0")
    box = inside.agg(*(f(a).alias(f"{n}_{a}") for n, f in (("min", F.min), ("max", F.max)) for a in AXES)).first().asDict()
    masked = voxels.join(own, list(AXES)).withColumn("value", F.when(F.col("_m") > 0, F.col("value")).otherwise(0.0)).drop("_m")
    cropped, small = crop_volume(masked, g, lattice.box_bounds(box, g))
    return blurred(cropped, small, fwhm, apodise=False), small


def stereotaxic(source: DataFrame, source_g: Geometry, model: DataFrame, model_g: Geometry, model_mask: DataFrame | None = None, steps=STEREOTAXIC, objective: str = "xcorr") -> Parameters:
    """The linear fit to a model, coarse to fine; steps marked so look at what the model's mask holds only."""
    p = optimise.principal_axis_start(source, source_g, model, model_g)
    for s in steps:
        if s is None:
            p = check_scale(p)
            continue
        a, b = blurred(source, source_g, s.fwhm, s.gradient).persist(), blurred(model, model_g, s.fwhm, s.gradient).persist()
        p = optimise.linear_fit(a, source_g, b, model_g, s.kind, objective, p, (s.step,) * 3, s.simplex, s.tolerance, target_mask=model_mask if s.masked else None)
        a.unpersist()
        b.unpersist()
    return p


def stereotaxic_nonlinear(source: DataFrame, source_g: Geometry, model: DataFrame, model_g: Geometry, levels=LEVELS) -> tuple[DataFrame, Geometry]:
    """The field of each level starts from the one before, interpolated onto its nodes."""
    field, g = None, None
    for fwhm, nodes, iterations in levels:
        a, b = blurred(source, source_g, fwhm), blurred(model, model_g, fwhm)
        o = nonlinear.Options(iterations=iterations, diameter=3 * nodes)
        if field is None:
            field, g = nonlinear.nonlinear_fit(a, source_g, b, model_g, nodes, o)
            continue
        old, old_g = field, g
        _, g = nonlinear.nonlinear_fit(a, source_g, b, model_g, nodes, nonlinear.Options(iterations=0))
        from ..operators.xfmops import resample_field

        start = resample_field(a.sparkSession, g, [{"type": "Grid_Transform", "field": old, "geometry": old_g}])
        field, g = nonlinear.nonlinear_fit(a, source_g, b, model_g, nodes, o, start)
    return field, g


def intra_subject(source: DataFrame, source_g: Geometry, target: DataFrame, target_g: Geometry, threshold: float = 0.1) -> tuple[Parameters, DataFrame]:
    """Mask by threshold, fit at two blurs, resample."""
    p = Parameters(center=optimise.moments(source, source_g)[0])
    for s in INTRA_SUBJECT:
        a, b = blurred(source, source_g, s.fwhm), blurred(target, target_g, s.fwhm)
        t = [float(v.agg(measures.feature_threshold(F.col("value"), threshold)).first()[0]) for v in (a, b)]
        p = optimise.linear_fit(a, source_g, b, target_g, s.kind, "xcorr", p, (s.step,) * 3, s.simplex, s.tolerance, tuple(t))
    return p, resample(source, source_g, target_g, p.matrix())


def build_model(voxels: DataFrame, g: Geometry, fwhms=(16.0, 8.0, 4.0, 2.0)) -> dict[float, DataFrame]:
    return {f: blurred(voxels, g, f) for f in fwhms}


def register(source: DataFrame, source_g: Geometry, target: DataFrame, target_g: Geometry, model: str = "lsq6", objective: str = "xcorr", nonlinear_nodes: float | None = None, **options):
    """The library call: a linear fit, and a nonlinear one behind it if a node distance is given."""
    p = optimise.linear_fit(source, source_g, target, target_g, model, objective, **options)
    if nonlinear_nodes is None:
        return p
    moved = resample(source, source_g, target_g, p.matrix())
    return p, nonlinear.nonlinear_fit(moved, target_g, target, target_g, nonlinear_nodes)


__all__ = ["build_model", "crop_volume", "grid_forward", "intra_subject", "pad_volume", "reduce_volume", "register", "stereotaxic", "stereotaxic_nonlinear"]
