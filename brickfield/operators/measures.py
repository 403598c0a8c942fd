"""Statistics, similarity measures and moments, as aggregate columns or small tables.

Functions that return Columns are aggregates: use them in groupBy(...).agg(...) for any grouping.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import AXES, per_volume


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two aligned volumes as v1, v2 on the voxel index."""
    return a.select(*AXES, F.col("value").alias("v1")).join(b.select(*AXES, F.col("value").alias("v2")), list(AXES))


def raw_correlation(v1: Column, v2: Column) -> Column:
    """s12 / (sqrt s11 sqrt s22), without means; null if a sum is 0."""
    norm = F.sqrt(F.sum(v1 * v1)) * F.sqrt(F.sum(v2 * v2))
    return F.when(norm != 0, F.sum(v1 * v2) / norm)


def xcorr(v1: Column, v2: Column) -> Column:
    return 1 - raw_correlation(v1, v2)


def zscore_difference(v1: Column, v2: Column) -> Column:
    """Root of the summed squared differences, over the count (the root is taken before dividing)."""
    d = v1 - v2
    return F.sqrt(F.sum(d * d)) / F.count(d)


def variance_ratio(df: DataFrame, group: Column, v1: Column, v2: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Sum over groups with more than one member of share times sample variance of v1 / v2; 1e15 with one pair or none."""
    parts = df.where(v2 != 0).groupBy(*by, group.alias("_g")).agg(F.count("*").alias("n"), F.var_samp(v1 / v2).alias("v"))
    total = F.sum("n")
    return parts.groupBy(*by).agg(F.when(total > 1, F.sum(F.when(F.col("n") > 1, F.col("n") * F.col("v")).otherwise(0.0)) / total).otherwise(1e15).alias("variance_ratio"))


def sign_changes(df: DataFrame, difference: Column, order: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Changes of the sign of a difference along an order; equality is a change each time it is met."""
    w = Window.partitionBy(*by).orderBy(*order)
    s = df.select(*by, *order, F.signum(difference).alias("_s"))
    s = s.withColumn("_nz", F.last(F.when(F.col("_s") != 0, F.col("_s")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    change = F.when(F.col("_s") == 0, 1).when(F.col("_nz").isNotNull() & (F.col("_s") != F.col("_nz")), 1).otherwise(0)
    return s.groupBy(*by).agg((-F.sum(change)).cast("double").alias("ssc"))


def joint_histogram(df: DataFrame, b1: str, b2: str, weight: Column | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by, b1, b2).agg(F.sum(F.lit(1.0) if weight is None else weight).alias("w"))


def mutual_information(hist: DataFrame, b1: str, b2: str, by: tuple[str, ...] = ()) -> DataFrame:
    """mi, hx, hy and nmi of a joint histogram (w); all to be made small, so signs are turned."""
    whole = Window.partitionBy(*by)
    p = hist.withColumn("p", F.col("w") / F.sum("w").over(whole))
    p = p.withColumn("px", F.sum("p").over(Window.partitionBy(*by, b1))).withColumn("py", F.sum("p").over(Window.partitionBy(*by, b2)))
    live = p.where("p > 0")
    mi = F.sum(F.col("p") * F.log(F.col("p") / (F.col("px") * F.col("py"))))
    hx, hy = -F.sum(F.col("p") * F.log("px")), -F.sum(F.col("p") * F.log("py"))
    return live.groupBy(*by).agg((-mi).alias("mi"), hx.alias("hx"), hy.alias("hy"), F.when(hx + hy > 0, -mi / (hx + hy)).alias("nmi"))


def blur_line(df: DataFrame, value: str, at: str, bins: int, size: int = 3, by: tuple[str, ...] = ()) -> Column:
    """Box mean of a dense line of bins. With 3, both ends stay; with more, the nth bin from an end is a mean of 2n + 1."""
    h = size // 2
    w = Window.partitionBy(*by).orderBy(at)
    out = F.avg(value).over(w.rowsBetween(-h, h))
    near = F.least(F.col(at), F.lit(bins - 1) - F.col(at))
    for n in range(h - 1, -1, -1):
        out = F.when(near == n, F.avg(value).over(w.rowsBetween(-n, n))).otherwise(out)
    return out


def blur_joint(df: DataFrame, b1: str, b2: str, value: str, bins: int, size: int = 3) -> DataFrame:
    """Rows, then columns, of a dense joint histogram."""
    df = df.withColumn("_r", blur_line(df, value, b2, bins, size, (b1,)))
    return df.withColumn("blurred", blur_line(df, "_r", b1, bins, size, (b2,))).drop("_r")


def local_xcorr(v1: Column, v2: Column) -> Column:
    a, b = F.sum(v1 * v1), F.sum(v2 * v2)
    return F.when((a < 1e-5) & (b < 1e-5), 1.0).when((a < 1e-5) | (b < 1e-5), 0.0).otherwise(F.sum(v1 * v2) / (F.sqrt(a) * F.sqrt(b)))


def local_diff(v1: Column, v2: Column) -> Column:
    return -F.avg(F.abs(v1 - v2))


def local_sqdiff(v1: Column, v2: Column) -> Column:
    return -F.avg((v1 - v2) * (v1 - v2))


def local_label(v1: Column, v2: Column) -> Column:
    return F.avg(F.when(F.abs(v1 - v2) < 0.01, 1.0).otherwise(0.0))


def local_chamfer(v1: Column, v2: Column) -> Column:
    """Mean distance (v2) where the source has a surface (v1 > 0): 1 - mean / 20; 2 if it has none."""
    return F.coalesce(1 - F.avg(F.when(v1 > 0, v2)) / 20.0, F.lit(2.0))


def local_corrcoeff(v1: Column, v2: Column) -> Column:
    a, b = F.var_pop(v1), F.var_pop(v2)
    return F.when((a < 1e-5) | (b < 1e-5), 0.0).otherwise(F.covar_pop(v1, v2) / F.sqrt(a * b))


#: Local objectives by name; add to it to plug in another: a function of two columns giving an aggregate.
LOCAL: dict[str, Callable[[Column, Column], Column]] = {
    "xcorr": local_xcorr,
    "diff": local_diff,
    "sqdiff": local_sqdiff,
    "label": local_label,
    "chamfer": local_chamfer,
    "corrcoeff": local_corrcoeff,
}


def register_objective(name: str, aggregate: Callable[[Column, Column], Column]) -> None:
    LOCAL[name] = aggregate


def similarity(weights: list[float], values: list[Column]) -> Column:
    total = sum(abs(w) for w in weights)
    return sum((w * v for w, v in zip(weights, values, strict=True)), F.lit(0.0)) / total


def local_objective(sim: Column, price: Column, ratio: float) -> Column:
    return 1 - sim * ratio + price * (1 - ratio)


def centre_of_gravity(x: Column, y: Column, z: Column, v: Column) -> list[Column]:
    return [(F.sum(c * v) / F.sum(v)).alias(n) for c, n in zip((x, y, z), ("cx", "cy", "cz"), strict=True)]


def covariance(x: Column, y: Column, z: Column, v: Column) -> list[Column]:
    """Weighted second moments about the weighted mean, in one pass."""
    p = {"x": x, "y": y, "z": z}
    s = F.sum(v)
    return [(F.sum(p[a] * p[b] * v) / s - F.sum(p[a] * v) / s * (F.sum(p[b] * v) / s)).alias(f"c{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]


def covariance_matrix(row) -> np.ndarray:
    return np.array([[row["cxx"], row["cxy"], row["cxz"]], [row["cxy"], row["cyy"], row["cyz"]], [row["cxz"], row["cyz"], row["czz"]]])


def statistics(v: Column) -> list[Column]:
    return [F.count(v).alias("n"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("sd"), F.sqrt(F.avg(v * v)).alias("rms"), F.coalesce(F.var_samp(v), F.lit(0.0)).alias("variance"), F.min(v).alias("low"), F.max(v).alias("high"), F.avg(F.abs(v)).alias("mean_abs")]


def histogram(voxels: DataFrame, bins: int = 256) -> DataFrame:
    """Count of each bin of each volume, the empty ones too; bin trunc((bins - 1) (v - min) / (max - min)) within range."""
    df = per_volume(voxels, F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    at = F.floor((bins - 1) * (F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).cast("int")
    counts = df.groupBy("vol", F.least(F.greatest(F.coalesce(at, F.lit(0)), F.lit(0)), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))
    every = voxels.select("vol").distinct().select("vol", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(counts, ["vol", "bin"], "left").fillna(0, ["n"])


def overlap(v1: Column, v2: Column, voxel_volume: float = 1.0) -> list[Column]:
    """Volumes of two labels, their difference in percent, overlap on each, raw correlation."""
    a, b = F.sum(F.when(v1 > 0, 1.0).otherwise(0.0)), F.sum(F.when(v2 > 0, 1.0).otherwise(0.0))
    both = F.sum(F.when((v1 > 0) & (v2 > 0), 1.0).otherwise(0.0))
    return [(a * voxel_volume).alias("volume1"), (b * voxel_volume).alias("volume2"), (100 * (a - b) / a).alias("difference"), (both / a).alias("overlap1"), (both / b).alias("overlap2"), raw_correlation(v1, v2).alias("correlation")]


def bounding_box(threshold: float = 0.0) -> list[Column]:
    """Smallest and largest index of values above the threshold (an aggregate over voxels)."""
    return [f(F.when(F.col("value") > threshold, F.col(a))).alias(f"{n}_{a}") for n, f in (("min", F.min), ("max", F.max)) for a in AXES]


def format_box(box: dict, start, step, style: str = "two_lines") -> str:
    """A box's text in one of the five output styles; widths in world units are max - min + 1, as they always were."""
    lo = [box[f"min_{a}"] * s + b for a, s, b in zip(AXES, step, start, strict=True)]
    hi = [box[f"max_{a}"] * s + b for a, s, b in zip(AXES, step, start, strict=True)]
    width = [y - x + 1 for x, y in zip(lo, hi, strict=True)]
    voxels = [box[f"max_{a}"] - box[f"min_{a}"] + 1 for a in AXES]
    first = [box[f"min_{a}"] for a in AXES]
    words = lambda values: " ".join(f"{v:g}" for v in values)
    # The option strings of the tools that read the box.
    return {
        "one_line": words([*lo, *width]),
        "two_lines": words(lo) + "\n" + words(width),
        "mincresample": f"-step {words(step)} -start {words(lo)} -nelements {words(voxels)}",
        "mincreshape": f"-start {words(reversed(first))} -count {words(reversed(voxels))}",
        "minccrop": f"-xlim {words([lo[0], hi[0]])} -ylim {words([lo[1], hi[1]])} -zlim {words([lo[2], hi[2]])}",
    }[style]


def argmax_label(classes: DataFrame) -> DataFrame:
    """The label of each voxel's largest positive value, the first listed among equals; 0 if none is positive."""
    best = F.max_by("label", F.struct(F.col("value"), -F.col("ord")))
    return classes.groupBy(*AXES).agg(F.when(F.max("value") > 0, best).otherwise(0).alias("label"))


def extreme_cells(voxels: DataFrame, size, by: str = "vol") -> DataFrame:
    """Raster numbers of the smallest and the largest value's cell of each volume, the first of equal ones."""
    raster = ((F.col("i") * size[1] + F.col("j")) * size[2] + F.col("k")).cast("int")
    return voxels.groupBy(by).agg(F.min_by(raster, F.struct("value", raster)).alias("lowest"), F.max_by(raster, F.struct(F.col("value"), -raster)).alias("highest"))


def label_moments(voxels: DataFrame, least: float | None = 0.0) -> DataFrame:
    """Size, centre and covariance of every label above `least` (None: all)."""
    at = [F.col(a).cast("double") for a in AXES]
    one = F.lit(1.0)
    live = voxels if least is None else voxels.where(F.col("value") > least)
    return live.groupBy(F.col("value").alias("label")).agg(F.count("*").alias("n"), *centre_of_gravity(*at, one), *covariance(*at, one))


def feature_threshold(v: Column, t: float = 0.0) -> Column:
    return F.max(v) * (t if t else 0.1)


def kernel_sums(v: Column) -> list[Column]:
    return [F.sum(v).alias("k1"), F.sum(v * v).alias("k2")]


def measures(df: DataFrame, v1: str, v2: str, groups: int = 256) -> DataFrame:
    """value, name rows of the four measures: zscore, xcorr, var_ratio, ssc (raster order pid)."""
    a, b = F.col(v1), F.col(v2)
    z = df.crossJoin(df.agg(*(f(c).alias(n) for c, n, f in ((a, "_m1", F.avg), (a, "_s1", F.stddev_samp), (b, "_m2", F.avg), (b, "_s2", F.stddev_samp)))))
    score = z.agg(zscore_difference((a - F.col("_m1")) / F.col("_s1"), (b - F.col("_m2")) / F.col("_s2")).alias("value")).select("value", F.lit("zscore").alias("name"))
    cross = df.agg(xcorr(a, b).alias("value")).select("value", F.lit("xcorr").alias("name"))
    low = df.agg(F.min(a).alias("_lo"), F.max(a).alias("_hi"))
    from .voxelwise import segment

    ratio = variance_ratio(df.crossJoin(low), segment(a, F.col("_lo"), F.col("_hi"), groups), a, b).select(F.col("variance_ratio").alias("value"), F.lit("var_ratio").alias("name"))
    changes = sign_changes(df, a - b, ["pid"]).select(F.col("ssc").alias("value"), F.lit("ssc").alias("name"))
    return score.unionByName(cross).unionByName(ratio).unionByName(changes)
