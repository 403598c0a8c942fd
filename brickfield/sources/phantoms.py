"""Generated volumes: phantoms, noise, random transforms and points."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.transforms import from_degrees
from ..model import AXES, Geometry, grid

# The default object is 60 x 80 x 30 wide, filled with 1 on 0.
WIDTH = (60.0, 80.0, 30.0)


def object_limits(g: Geometry, center=(0, 0, 0), width=WIDTH) -> dict[str, np.ndarray]:
    """Smallest and largest world and voxel coordinates of the object."""
    c, w = np.asarray(center, float), np.asarray(width, float)
    a, b = c - w / 2, c + w / 2
    voxel = lambda p: (g.to_voxel() @ [*p, 1])[:3]
    va, vb = voxel(a), voxel(b)
    return {"world_min": a, "world_max": b, "voxel_min": np.minimum(va, vb), "voxel_max": np.maximum(va, vb)}


def inside_ellipsoid(x, y, z, center, radii):
    """The squared distance in radii is at most 1.0000001."""
    return sum(((F.lit(float(c)) - p) / F.lit(float(r))) ** 2 for c, r, p in zip(center, radii, (x, y, z), strict=True)) <= F.lit(1.0000001)


def _object(g: Geometry, center, width) -> tuple[np.ndarray, np.ndarray]:
    """Centre and radii in voxels."""
    return (g.to_voxel() @ [*center, 1])[:3], np.asarray(width, float) / 2 / np.abs(np.asarray(g.step, float))


def rectangle(spark: SparkSession, g: Geometry, center=(0, 0, 0), width=WIDTH, fill: float = 1.0, background: float = 0.0, vol: str = "phantom") -> DataFrame:
    c, r = _object(g, center, width)
    inside = F.lit(True)
    for a, x, y in zip(AXES, c, r, strict=True):
        inside = inside & (F.abs(F.col(a) - F.lit(float(x))) <= F.lit(float(y)))
    return grid(spark, g.size).select(F.lit(vol).alias("vol"), *AXES, F.when(inside, float(fill)).otherwise(float(background)).alias("value"))


def partial_fraction(center, radii, samples: int = 10):
    """Share of samples**3 points of a voxel that lie in the ellipsoid, as a column; points at -0.5 + n / (samples - 1).

    Counted one plane line at a time: for each of samples**2 lines along k, the points with small enough distance
    are counted by a closed form, so the expression stays short enough to compile.
    """
    steps = [-0.5 + n / (samples - 1) for n in range(samples)]
    points = F.array(*(F.lit(s) for s in steps))

    def squared(n: int):
        return lambda s: ((F.lit(float(center[n])) - (F.col(AXES[n]) + s)) / F.lit(float(radii[n]))) ** 2

    squares = [F.transform(points, squared(n)) for n in range(3)]
    return F.aggregate(squares[0], F.lit(0.0), lambda acc, x: acc + F.aggregate(squares[1], F.lit(0.0), lambda q, y: q + F.size(F.filter(squares[2], lambda z: x + y + z <= 1.0000001)))) / float(samples**3)


def ellipsoid(spark: SparkSession, g: Geometry, center=(0, 0, 0), width=WIDTH, fill: float = 1.0, background: float = 0.0, edge: float = 1.0, partial: bool = True, byte_store: bool = True, vol: str = "phantom") -> DataFrame:
    """An ellipsoid. A voxel is full if it and its six neighbours have their centres inside, and on the edge if only some have; edge voxels
    get the filled fraction of the edge value (partial), or the edge value if their own centre is inside.

    byte_store: values are kept as bytes over the range from background to the larger of fill and edge, truncated.
    """
    c, r = _object(g, center, width)
    inside = lambda d: inside_ellipsoid(*(F.col(a) + x for a, x in zip(AXES, d, strict=True)), c, r).cast("int")
    around = [(0, 0, 0)] + [tuple(s * int(n == m) for m in range(3)) for n in range(3) for s in (-1, 1)]
    n = sum((inside(d) for d in around), F.lit(0))
    own = partial_fraction(c, r) * float(edge) if partial else F.when(inside((0, 0, 0)) == 1, float(edge)).otherwise(float(background))
    value = F.when(n == len(around), float(fill)).when(n == 0, float(background)).otherwise(own)
    out = grid(spark, g.size).select(F.lit(vol).alias("vol"), *AXES, value.alias("value"))
    if byte_store:
        top = max(fill, edge)
        scale = 255.0 / (top - background)
        out = out.withColumn("value", F.floor((F.col("value") - background) * scale + 1e-9) / scale + background)
    return out


def gaussian_volume(spark: SparkSession, size, std: float, seed: int = 0, vol: str = "noise") -> DataFrame:
    return grid(spark, size).select(F.lit(vol).alias("vol"), *AXES, (F.randn(seed) * std).alias("value"))


def randomised(voxels: DataFrame, std: float, seed: int = 0) -> DataFrame:
    """Every value replaced by noise within five deviations."""
    return voxels.withColumn("value", F.least(F.greatest(F.randn(seed) * std, F.lit(-5.0 * std)), F.lit(5.0 * std)))


def _stream(seed: int, n: int) -> int:
    """A seed far from those of other streams: a generator adds the partition's number to its seed, so seeds side by side would share numbers."""
    return (seed * 0x9E3779B97F4A7C15 + (n + 1) * 0xD1B54A32D192ED03) % (1 << 62)


def random_deformation(spark: SparkSession, size, std: float, seed: int = 0, vol: str = "random") -> DataFrame:
    return grid(spark, size).select(F.lit(vol).alias("vol"), *AXES, *((F.randn(_stream(seed, n)) * std).alias(c) for n, c in enumerate(("dx", "dy", "dz"))))


def random_tags(tags: DataFrame, std: float, seed: int = 0) -> DataFrame:
    """Noise on the second point of every pair."""
    for n, c in enumerate(("x2", "y2", "z2")):
        tags = tags.withColumn(c, F.col(c) + F.randn(_stream(seed, n)) * std)
    return tags


def random_parameters(seed: int = 0, rotation: float = 10, scale: float = 0.2, shift: float = 10, shear: float = 0.1) -> np.ndarray:
    """A matrix with uniform parts up to the given magnitudes (degrees, millimetres)."""
    r = np.random.default_rng(seed)
    u = lambda m: r.uniform(-m, m, 3)
    return from_degrees(u(shift), u(rotation), 1 + u(scale), u(shear))


def uniform(n: int, low: float = 0.0, high: float = 1.0, seed: int = 0) -> np.ndarray:
    return np.random.default_rng(seed).uniform(low, high, n)


def gaussian(n: int, std: float, seed: int = 0) -> np.ndarray:
    return np.random.default_rng(seed).normal(0, std, n)
