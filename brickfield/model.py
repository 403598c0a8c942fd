"""Volumes as tables, and their geometry.

voxels(vol, i, j, k, value): one row for each voxel, i, j, k along x, y, z from 0.
grids(vol, i, j, k, dx, dy, dz): one displacement for each node.
Geometry (sizes, steps, starts, direction cosines) is a small record kept on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOXELS = T.StructType([T.StructField("vol", T.StringType()), *(T.StructField(a, T.IntegerType()) for a in "ijk"), T.StructField("value", T.DoubleType())])
GRIDS = T.StructType([T.StructField("vol", T.StringType()), *(T.StructField(a, T.IntegerType()) for a in "ijk"), *(T.StructField(a, T.DoubleType()) for a in ("dx", "dy", "dz"))])
TAGS = T.StructType([*(T.StructField(f"{a}{n}", T.DoubleType()) for n in (1, 2) for a in "xyz"), T.StructField("label", T.StringType())])
AXES = ("i", "j", "k")

#: Storage types by name: smallest and largest voxel value (None: floating point).
STORAGE = {
    "byte": (0, 255),
    "signed byte": (-128, 127),
    "unsigned short": (0, 65535),
    "short": (-32768, 32767),
    "long": (-(2**31), 2**31 - 1),
    "float": None,
    "double": None,
    "labels": (0, 255),
}


@dataclass
class Geometry:
    size: tuple[int, int, int]
    step: tuple[float, float, float] = (1.0, 1.0, 1.0)
    start: tuple[float, float, float] = (0.0, 0.0, 0.0)
    dircos: np.ndarray = field(default_factory=lambda: np.eye(3))

    def to_world(self) -> np.ndarray:
        """4x4 matrix from voxel to world coordinates."""
        m = np.eye(4)
        m[:3, :3] = np.asarray(self.dircos, float).T * np.asarray(self.step, float)
        m[:3, 3] = np.asarray(self.dircos, float).T @ np.asarray(self.start, float)
        return m

    def to_voxel(self) -> np.ndarray:
        return np.linalg.inv(self.to_world())

    def same_shape(self, other: Geometry) -> bool:
        return tuple(self.size) == tuple(other.size)

    def corners(self) -> np.ndarray:
        """World coordinates of the eight corner voxels."""
        n = np.array([[(s - 1) * b for s, b in zip(self.size, bits, strict=True)] + [1] for bits in np.ndindex(2, 2, 2)], float)
        return (self.to_world() @ n.T).T[:, :3]


def rounded(c):
    """floor(x + 0.5), as an integer column."""
    return F.floor(c + F.lit(0.5)).cast("int")


def affine(matrix: np.ndarray, x, y, z) -> tuple:
    """Columns of a point mapped by a 4x4 matrix; divides by the last coordinate where it is neither 0 nor 1."""
    m = np.asarray(matrix, float)
    x, y, z = (F.col(c) if isinstance(c, str) else c for c in (x, y, z))
    row = lambda r: F.lit(float(m[r, 0])) * x + F.lit(float(m[r, 1])) * y + F.lit(float(m[r, 2])) * z + F.lit(float(m[r, 3]))
    out = [row(r) for r in range(3)]
    if np.allclose(m[3], [0, 0, 0, 1]):
        return tuple(out)
    w = row(3)
    return tuple(F.when((w != 0) & (w != 1), c / w).otherwise(c) for c in out)


def grid(spark, size, names=AXES) -> DataFrame:
    """All index triples of a box, made where they are used."""
    nx, ny, nz = (int(s) for s in size)
    n = F.col("id")
    return spark.range(nx * ny * nz).select(F.floor(n / (ny * nz)).cast("int").alias(names[0]), F.pmod(F.floor(n / nz), F.lit(ny)).cast("int").alias(names[1]), F.pmod(n, F.lit(nz)).cast("int").alias(names[2]))


def per_volume(voxels: DataFrame, *aggregates) -> DataFrame:
    """voxels with per-volume aggregates: one row for each volume is joined back."""
    return voxels.join(voxels.groupBy("vol").agg(*aggregates), "vol")
