"""Bounds, padding and lattice choice: small numbers on the driver, from one aggregation where data decides."""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Geometry

# The standard space's box, first and last millimetre of each axis.
STANDARD_BOX = ((-72.0, 72.0), (-107.0, 72.0), (-44.0, 80.0))


def volume_bounds(g: Geometry) -> list[tuple[float, float]]:
    return [(b, b + s * (n - 1)) for b, s, n in zip(g.start, g.step, g.size, strict=True)]


def box_bounds(box: dict, g: Geometry) -> list[tuple[float, float]]:
    """World bounds of a bounding box given in voxels (min_i ... max_k)."""
    return [(b + s * box[f"min_{a}"], b + s * box[f"max_{a}"]) for a, b, s in zip("ijk", g.start, g.step, strict=True)]


def transform_bounds(bounds, matrix: np.ndarray, invert: bool = False) -> list[tuple[float, float]]:
    """Bounds of the eight corners after a transform."""
    m = np.linalg.inv(matrix) if invert else np.asarray(matrix)
    corners = np.array([[bounds[n][b] for n, b in enumerate(bits)] + [1] for bits in np.ndindex(2, 2, 2)], float)
    moved = (m @ corners.T)[:3]
    return [(float(r.min()), float(r.max())) for r in moved]


def fix_bounds(bounds, step) -> list[tuple[float, float]]:
    """The far end moved away so that the extent is a multiple of the step; order follows the step's sign."""
    out = []
    for (a, b), s in zip(bounds, step, strict=True):
        if (b - a) * s < 0:
            a, b = b, a
        out.append((a, a + math.copysign(math.ceil(abs((b - a) / s) - 1e-9) * abs(s), s)))
    return out


def fixed_bounds(a: Column, b: Column, step: Column) -> tuple[Column, Column]:
    """The same for a table of bounds: first and last end of an axis."""
    turned = (b - a) * step < 0
    first, last = F.when(turned, b).otherwise(a), F.when(turned, a).otherwise(b)
    return first, first + step * F.ceil(F.abs((last - first) / step) - 1e-9)


def modified_bounds(a: Column, b: Column, step: Column, low: str, high: str) -> tuple[Column, Column]:
    """Both ends of an axis moved outwards by amounts such as 10%, 5mm and 2v, for a table of bounds."""

    def size(text: str) -> Column:
        m = re.fullmatch(r"([-+]?[\d.]+)(%|mm|v|)", text)
        if not m:
            raise ValueError(text)
        x = float(m[1])
        return {"%": F.abs(b - a) * x / 100, "mm": F.lit(x), "": F.lit(x), "v": F.abs(step) * x}[m[2]]

    sign = F.when(b >= a, 1.0).otherwise(-1.0)
    return a - sign * size(low), b + sign * size(high)


def point_bounds(points: DataFrame, by: str, names=("x", "y", "z")) -> DataFrame:
    """First and last coordinate of each group's points along every axis."""
    return points.groupBy(by).agg(*(f(c).alias(f"{c}_{n}") for c in names for n, f in (("first", F.min), ("last", F.max))))


def reordered(voxels: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Voxels with axes d0, d1, ... stored in the order of dimension names (xspace, yspace, zspace, ...) as i, j, k along x, y, z; an
    axis that isn't named has the one index 0."""
    place = {n[0]: k for k, n in enumerate(names)}
    found = [F.col(f"d{place[a]}").alias(x) if a in place else F.lit(0).alias(x) for a, x in zip("xyz", "ijk", strict=True)]
    return voxels.select(*(c for c in voxels.columns if c not in {f"d{k}" for k in range(len(names))}), *found)


def modify_bounds(bounds, how: str, amounts: list[str], step) -> list[tuple[float, float]]:
    """expand moves each end outwards by its own amount, extend both; iso forms take one amount for all. Amounts: 10%, 5mm, 2v."""
    each = [amounts[0]] * 6 if how.startswith("iso") or len(amounts) == 1 else amounts if len(amounts) == 6 else [a for a in amounts for _ in (0, 1)]
    out = []
    for n, ((a, b), s) in enumerate(zip(bounds, step, strict=True)):
        size = []
        for text in each[2 * n : 2 * n + 2]:
            m = re.fullmatch(r"([-+]?[\d.]+)(%|mm|v|)", text)
            if not m:
                raise ValueError(text)
            x = float(m[1])
            size.append({"%": abs(b - a) * x / 100, "mm": x, "": x, "v": abs(s) * x}[m[2]])
        sign = 1 if b >= a else -1
        out.append((a - sign * size[0], b + sign * size[1]))
    return out


def guess_subsample(step):
    """Steps under 1.5 doubled; of a column, or of a list of numbers."""
    if isinstance(step, Column):
        return F.when(F.abs(step) < 1.5, 2 * step).otherwise(step)
    return [2 * s if abs(s) < 1.5 else s for s in step]


def guess_crop(extent, most: float = 190.0):
    """What to take off the bottom so that the top `most` millimetres stay (a negative number, or 0); of a column or a number."""
    if isinstance(extent, Column):
        return F.when(extent > most, most - extent).otherwise(0.0)
    return most - extent if extent > most else 0.0


def pad_amount(fwhms: list, step):
    """Three sigmas of the widest blur, up to a whole step; of numbers or columns."""
    if isinstance(step, Column):
        return F.ceil(3 * F.greatest(*fwhms) / 2.35482 / F.abs(step)) * F.abs(step)
    return math.ceil(3 * max(fwhms) / 2.35482 / abs(step)) * abs(step)


def unpad_amounts(fwhms: list) -> list:
    return [3 * f / 2.35482 for f in fwhms]


def clamp_is_ok(low: Column, high: Column) -> Column:
    """The same for a table of options: both limits in order, or neither."""
    return F.coalesce(low < high, low.isNull() & high.isNull())


def check_clamp(options: dict) -> dict:
    """Clamping needs both limits, in order."""
    low, high = options.get("clamp_low"), options.get("clamp_high")
    if (low is None) != (high is None) or (low is not None and low >= high):
        raise ValueError("clamp limits")
    return options


def fit_distance(preset: str) -> dict:
    return {"close": {"simplex": 3, "start": "identity"}, "far": {"simplex": 10, "start": "est_translations"}}[preset]


def choose_lattice(box1: dict, box2: dict, nonlinear: bool, t1: float, t2: float) -> dict:
    """The volume with the smaller live box drives; nonlinear fits take the target. Thresholds swap when the target drives."""
    size = lambda b: np.prod([b[f"max_{a}"] - b[f"min_{a}"] + 1 for a in "ijk"])
    target = nonlinear or size(box2) < size(box1)
    return {"lattice": "target" if target else "source", "thresholds": (t2, t1) if target else (t1, t2)}


def chosen_lattice(size1: Column, size2: Column, nonlinear: bool, t1: float, t2: float) -> tuple[Column, Column]:
    """The same for a table of box sizes: whether the target drives, and the first threshold."""
    target = F.lit(True) if nonlinear else size2 < size1
    return target, F.when(target, t2).otherwise(t1)
