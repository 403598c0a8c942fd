"""Predicates on points, derivatives, labels and metadata."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import AXES, Geometry, affine, rounded


def not_masked_voxel(points: DataFrame, mask: DataFrame | None, at=("x", "y", "z")) -> DataFrame:
    """Points (voxel coordinates) whose nearest voxel is in the mask; outside the mask's box goes; no mask keeps all."""
    if mask is None:
        return points
    live = mask.where("value > 0").select(*(F.col(a).alias(f"_m{a}") for a in AXES))
    same = [rounded(F.col(c)) == F.col(f"_m{a}") for c, a in zip(at, AXES, strict=True)]
    return points.join(live, same, "left_semi")


def not_masked_world(points: DataFrame, mask: DataFrame | None, g: Geometry, at=("x", "y", "z")) -> DataFrame:
    if mask is None:
        return points
    mapped = affine(g.to_voxel(), *at)
    names = ("_vx", "_vy", "_vz")
    return not_masked_voxel(points.withColumns(dict(zip(names, mapped, strict=True))), mask, names).drop(*names)


def above(v1: Column, v2: Column, t1: float, t2: float, magnitude: bool = False) -> Column:
    """Both values strictly above their thresholds; for z-scores their magnitudes."""
    return (F.abs(v1) > t1) & (F.abs(v2) > t2) if magnitude else (v1 > t1) & (v2 > t2)


def in_limits(v: Column, low, high) -> Column:
    return v.between(low, high)


def ellipsoidal(tx: Column, ty: Column, tz: Column) -> Column:
    return tx * tx + ty * ty + tz * tz <= 0.55 * 0.55


def eligible(nodes: DataFrame, masks: list[DataFrame], value: str = "value", threshold: float = 0.0) -> DataFrame:
    """Nodes that at least one mask accepts, with a model value above the threshold."""
    kept = nodes.where(F.col(value) > threshold)
    if not masks:
        return kept
    live = masks[0].where("value > 0").select(*AXES)
    for m in masks[1:]:
        live = live.unionByName(m.where("value > 0").select(*AXES))
    return kept.join(live, list(AXES), "left_semi")


def _minors(h: dict[str, Column]) -> tuple[Column, Column, Column]:
    uu, vv, ww, uv, uw, vw = (h[n] for n in ("uu", "vv", "ww", "uv", "uw", "vw"))
    two = uu * vv - uv * uv
    return uu, two, uu * (vv * ww - vw * vw) - uv * (uv * ww - vw * uw) + uw * (uv * vw - vv * uw)


def positive_definite(h: dict[str, Column]) -> Column:
    a, b, c = _minors(h)
    return (a > 0) & (b > 0) & (c > 0)


def positive_semidefinite(h: dict[str, Column], slack: float = -1e-9) -> Column:
    uu, vv, ww, uv, uw, vw = (h[n] for n in ("uu", "vv", "ww", "uv", "uw", "vw"))
    minors = [uu, vv, ww, uu * vv - uv * uv, uu * ww - uw * uw, vv * ww - vw * vw, _minors(h)[2]]
    out = minors[0] > slack
    for m in minors[1:]:
        out = out & (m > slack)
    return out


def negative_definite(h: dict[str, Column]) -> Column:
    a, b, c = _minors(h)
    return (a < 0) & (b > 0) & (c < 0)


def negative_definite_2d(uu: Column, vv: Column, uv: Column) -> Column:
    return (uu < 0) & (uu * vv - uv * uv > 0)


def is_tube(volume: Column, longest: Column, middle: Column, shortest: Column, smallest: float, largest: float, ratio: float = 3.0) -> Column:
    """Volume in range, one axis much longer than the others, the others alike."""
    return volume.between(smallest, largest) & (longest > ratio * middle) & (middle < ratio * shortest)


def matrix_rows(spark, matrix, name: str = "value") -> DataFrame:
    m = np.asarray(matrix, float)
    return spark.createDataFrame([(r, c, float(m[r, c])) for r in range(m.shape[0]) for c in range(m.shape[1])], f"row int, col int, {name} double")


def transform_differences(a: DataFrame, b: DataFrame, linear_tolerance: float, shift_tolerance: float) -> DataFrame:
    """Elements of two matrices that differ by more than the tolerance of their part."""
    both = a.join(b.withColumnRenamed("value", "other"), ["row", "col"])
    limit = F.when(F.col("col") == 3, shift_tolerance).otherwise(linear_tolerance)
    return both.withColumn("difference", F.abs(F.col("value") - F.col("other"))).where(F.col("difference") > limit)


def needs_sub_lattice(features: DataFrame) -> Column:
    return F.bool_or(~F.col("objective").isin("opticalflow", "chamfer"))
