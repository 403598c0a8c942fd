"""Voxel-wise maps: expressions on rows, at most with one row of statistics for each volume."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import AXES, per_volume


def to_voxel_value(v: Column, real: tuple[float, float], voxel: tuple[float, float]) -> Column:
    return (v - real[0]) / (real[1] - real[0]) * (voxel[1] - voxel[0]) + voxel[0]


def to_real_value(v: Column, real: tuple[float, float], voxel: tuple[float, float]) -> Column:
    return to_voxel_value(v, voxel, real)


def byte_requantise(voxels: DataFrame) -> DataFrame:
    """floor((v - min) / (max - min) * 255 + 0.5) over each volume's true range; 0 where the range is empty."""
    df = per_volume(voxels, F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    scaled = F.floor((F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 255 + 0.5).cast("int")
    return df.withColumn("byte", F.when(F.col("_hi") > F.col("_lo"), scaled).otherwise(0)).drop("_lo", "_hi")


def clamp(voxels: DataFrame, low: float, high: float) -> DataFrame:
    return voxels.withColumn("value", F.least(F.greatest("value", F.lit(float(low))), F.lit(float(high))))


def masked(voxels: DataFrame, mask: DataFrame | None) -> DataFrame:
    """Voxels whose index is in the mask (value > 0); no mask: all."""
    if mask is None:
        return voxels
    keys = [c for c in ("vol", *AXES) if c in mask.columns]
    live = mask.where("value > 0") if "value" in mask.columns else mask
    return voxels.join(live.select(*keys), keys, "left_semi")


def zscore(voxels: DataFrame, mask: DataFrame | None = None, threshold: float = 0.0) -> DataFrame:
    """(v - mean) / deviation, within 5, of values above the threshold; null below; threshold_z is the threshold's own score."""
    stats = masked(voxels, mask).where(F.col("value") > threshold).groupBy("vol").agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
    df = voxels.join(stats, "vol", "left")
    z = F.least(F.greatest((F.col("value") - F.col("_m")) / F.col("_s"), F.lit(-5.0)), F.lit(5.0))
    return df.withColumn("z", F.when(F.col("value") > threshold, z)).withColumn("threshold_z", (F.lit(float(threshold)) - F.col("_m")) / F.col("_s")).drop("_m", "_s")


def speckle(voxels: DataFrame, percent: float, size) -> DataFrame:
    """Values times 1 +- percent / 100, the sign changing along the raster scan."""
    raster = (F.col("i") * size[1] + F.col("j")) * size[2] + F.col("k")
    sign = F.when(F.pmod(raster, F.lit(2)) == 0, 1.0).otherwise(-1.0)
    return voxels.withColumn("value", F.col("value") * (1 + sign * percent / 100))


def upper_median(df: DataFrame, value: str, by: str) -> DataFrame:
    """Per group, the element at index n div 2 of the sorted values. A group is sorted with spilling, not held."""
    order, whole = Window.partitionBy(by).orderBy(value), Window.partitionBy(by)
    ranked = df.select(by, value, F.row_number().over(order).alias("_r"), F.count("*").over(whole).alias("_n"))
    return ranked.where(F.col("_r") == F.floor(F.col("_n") / 2) + 1).select(by, F.col(value).alias("median"))


def median_normalise(source: DataFrame, target: DataFrame, t1: float = 0.0, t2: float = 0.0) -> DataFrame:
    """Source values over the upper median of the ratios source / target where both are above their thresholds."""
    other = target.select("vol", *AXES, F.col("value").alias("_v2"))
    ratio = source.join(other, ["vol", *AXES]).where((F.col("value") > t1) & (F.col("_v2") > t2)).select("vol", (F.col("value") / F.col("_v2")).alias("_q"))
    return source.join(upper_median(ratio, "_q", "vol"), "vol").withColumn("value", F.col("value") / F.col("median"))


def zeros(voxels: DataFrame) -> DataFrame:
    return voxels.withColumn("value", F.lit(0.0))


def gaussian_height(x: Column, fwhm: float, mu: float = 0.0) -> Column:
    sigma = fwhm / 2.35482
    return F.exp(-((x - mu) * (x - mu)) / (2 * sigma * sigma))


def gaussian_density(x: Column, fwhm: float, mu: float = 0.0, c: float = 1.0) -> Column:
    sigma = fwhm / 2.35482
    return gaussian_height(x, fwhm, mu) * (c / (sigma * math.sqrt(2 * math.pi)))


def rect_density(x: Column, fwhm: float, c: float = 1.0) -> Column:
    return F.when((x >= -fwhm / 2) & (x < fwhm / 2), c / fwhm).otherwise(0.0)


def ramp(n: int, step: float, fwhm: float) -> list[float]:
    """Factors of the first slices of an axis: a blend of two Gaussian flanks, 1.25 fwhm deep."""
    depth = min(n // 2, int(1.25 * fwhm / abs(step)))
    sigma = lambda f: f * fwhm / 2.35482
    out = []
    for s in range(depth):
        x = abs(step) * (depth - s)
        out.append(0.5 * (math.exp(-x * x / (2 * sigma(0.75) ** 2)) + math.exp(-x * x / (2 * sigma(0.9) ** 2))))
    return out


def apodize(voxels: DataFrame, size, step, fwhm) -> DataFrame:
    """Border slices scaled down along each axis. The ramps are short literal arrays."""
    factor = F.lit(1.0)
    for axis, n, s, f in zip(AXES, size, step, fwhm, strict=True):
        if values := ramp(n, s, f):
            near = F.least(F.col(axis), F.lit(n - 1) - F.col(axis))
            table = F.array(*(F.lit(v) for v in values))
            factor = factor * F.when(near < len(values), F.element_at(table, (near + 1).cast("int"))).otherwise(1.0)
    return voxels.withColumn("value", F.col("value") * factor)


def gradient_magnitude(dx: Column, dy: Column, dz: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def gaussian_curvature(dx: Column, dy: Column, dz: Column, dxx: Column, dyy: Column, dzz: Column, threshold: float = 0.0) -> Column:
    m = dx * dx + dy * dy + dz * dz
    return F.when(m < threshold * threshold, 0.0).when(m == 0, 0.0).otherwise((dx * dx * dyy * dzz + dy * dy * dxx * dzz + dz * dz * dxx * dyy) / (m * m))


def remove_label(voxels: DataFrame, label: float) -> DataFrame:
    return voxels.withColumn("value", F.when(F.col("value") == label, 0.0).otherwise(F.col("value")))


def to_grid_space(dx: Column, dy: Column, dz: Column, dircos: np.ndarray) -> tuple[Column, ...]:
    """World displacement to displacement along the grid's axes; the transpose goes back."""
    d = np.asarray(dircos, float)
    return tuple(F.lit(float(r[0])) * dx + F.lit(float(r[1])) * dy + F.lit(float(r[2])) * dz for r in d)


def from_grid_space(dx: Column, dy: Column, dz: Column, dircos: np.ndarray) -> tuple[Column, ...]:
    return to_grid_space(dx, dy, dz, np.asarray(dircos, float).T)


def live_axes(weights, size) -> list[float]:
    """Per-axis weights without the axes of length 1."""
    return [w for w, n in zip(weights, size, strict=True) if n > 1]


def live_axes_of(weights: list[Column], sizes: list[Column]) -> Column:
    """The same for a table of sizes: an array of the weights of axes longer than 1."""
    return F.filter(F.array(*(F.when(n > 1, w) for w, n in zip(weights, sizes, strict=True))), lambda w: w.isNotNull())


def cost(x: Column, y: Column, z: Column, longest: float) -> Column:
    """0.2 v / (longest - v) for v the cubed length; 1e38 from longest on."""
    v = F.pow(F.sqrt(x * x + y * y + z * z), F.lit(3.0))
    return F.when(v < longest, v * 0.2 / (F.lit(float(longest)) - v)).otherwise(1e38)


def confidence(x: Column, low: float, high: float) -> Column:
    """0 up to low, 1 from high on, straight in between."""
    return F.when(x <= low, 0.0).when(x >= high, 1.0).otherwise((x - low) / (high - low))


def segment(v: Column, low: Column, high: Column, groups: int) -> Column:
    """Group number from 1: round(0.5 + (groups - 1e-5) (v - low) / (high - low))."""
    return F.floor(F.lit(0.5) + 0.5 + (v - low) * (groups - 1e-5) / (high - low)).cast("int")
