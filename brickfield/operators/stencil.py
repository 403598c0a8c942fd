"""Neighbourhoods: means, differences, derivatives, blurs, distances.

A box of neighbours is summed axis by axis with window frames over lines, three passes over the table, instead of joining
each voxel with 26 or 124 others. Lines are short, so no window group is large.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import symmetric_eigenvalues
from ..model import AXES, Geometry
from .masks import positive_semidefinite


def _line(axis: str, by: tuple[str, ...] = ("vol",)):
    return Window.partitionBy(*by, *(a for a in AXES if a != axis)).orderBy(axis)


def shifted(column: str, axis: str, n: int, by=("vol",)) -> Column:
    """The value n nodes further along an axis, null beyond the border or where the node is missing."""
    w = _line(axis, by).rangeBetween(n, n)
    return F.first(column).over(w)


def neighbour_mean(df: DataFrame, columns: tuple[str, ...] = ("value",), kind: int = 6, by=("vol",)) -> DataFrame:
    """mean_<column> over the 6, 26 or 124 neighbours that exist (null if none), and n_neighbours."""
    if kind == 6:
        sums = {c: F.lit(0.0) for c in columns}
        n = F.lit(0)
        for a in AXES:
            for d in (-1, 1):
                for c in columns:
                    sums[c] = sums[c] + F.coalesce(shifted(c, a, d, by), F.lit(0.0))
                n = n + F.when(shifted(columns[0], a, d, by).isNotNull(), 1).otherwise(0)
        df = df.withColumns({**{f"_b{c}": s for c, s in sums.items()}, "n_neighbours": n})
    else:
        r = {26: 1, 124: 2}[kind]
        work = {c: F.col(c) for c in columns}
        df = df.withColumns({**{f"_b{c}": v for c, v in work.items()}, "n_neighbours": F.lit(1)})
        for a in AXES:
            w = _line(a, by).rangeBetween(-r, r)
            df = df.withColumns({**{f"_b{c}": F.sum(f"_b{c}").over(w) for c in columns}, "n_neighbours": F.sum("n_neighbours").over(w)})
        df = df.withColumns({**{f"_b{c}": F.col(f"_b{c}") - F.col(c) for c in columns}, "n_neighbours": F.col("n_neighbours") - 1})
    out = {f"mean_{c}": F.when(F.col("n_neighbours") > 0, F.col(f"_b{c}") / F.col("n_neighbours")) for c in columns}
    return df.withColumns(out).withColumn("n_neighbours", F.col("n_neighbours").cast("int")).drop(*(f"_b{c}" for c in columns))


DISPLACEMENT = ("dx", "dy", "dz")


def smooth(grid: DataFrame, weight: float, by=("vol",)) -> DataFrame:
    """(1 - weight) d + weight mean26; nodes without neighbours stay."""
    m = neighbour_mean(grid, DISPLACEMENT, 26, by)
    return m.withColumns({c: F.when(F.col("n_neighbours") > 0, F.col(c) * (1 - weight) + F.col(f"mean_{c}") * weight).otherwise(F.col(c)) for c in DISPLACEMENT}).drop("n_neighbours", *(f"mean_{c}" for c in DISPLACEMENT))


def add_warps(additional: DataFrame, current: DataFrame, weight: float = 1.0) -> DataFrame:
    """current + weight additional, node by node."""
    extra = additional.select("vol", *AXES, *(F.col(c).alias(f"_{c}") for c in DISPLACEMENT))
    both = current.join(extra, ["vol", *AXES], "left")
    return both.withColumns({c: F.col(c) + weight * F.coalesce(F.col(f"_{c}"), F.lit(0.0)) for c in DISPLACEMENT}).drop(*(f"_{c}" for c in DISPLACEMENT))


def extrapolate(grid: DataFrame, estimated: str = "estimated", by=("vol",)) -> DataFrame:
    """Displacements of nodes that were not estimated: the sum of the estimated neighbours' over 26, whatever their number,
    plus half the way from there to the plain mean of all neighbours."""
    est = grid.withColumns({f"_e{c}": F.when(F.col(estimated), F.col(c)).otherwise(0.0) for c in DISPLACEMENT})
    sums = neighbour_mean(est, (*DISPLACEMENT, *(f"_e{c}" for c in DISPLACEMENT)), 26, by)
    new = {}
    for c in DISPLACEMENT:
        near = F.col(f"mean__e{c}") * F.col("n_neighbours") / 26.0
        new[c] = F.when(F.col(estimated) | (F.col("n_neighbours") == 0), F.col(c)).otherwise(near + (F.col(f"mean_{c}") - F.col(c)) / 2)
    return sums.withColumns(new).select(*grid.columns)


def interior(size) -> Column:
    """Nodes that are not on the border of an axis longer than 3."""
    out = F.lit(True)
    for a, n in zip(AXES, size, strict=True):
        if n > 3:
            out = out & F.col(a).between(1, n - 2)
    return out


def derivatives(df: DataFrame, by=("vol",), value: str = "value") -> DataFrame:
    """Central differences u v w uu vv ww uv uw vw (along i, j, k); null at the border."""
    near = {(a, d): shifted(value, a, d, by) for a in AXES for d in (-1, 1)}
    first = {n: (near[a, 1] - near[a, -1]) / 2 for n, a in zip("uvw", AXES, strict=True)}
    second = {n * 2: near[a, 1] - 2 * F.col(value) + near[a, -1] for n, a in zip("uvw", AXES, strict=True)}
    df = df.withColumns({**first, **second})
    cross = {"uv": ("u", "j"), "uw": ("u", "k"), "vw": ("v", "k")}
    return df.withColumns({n: (shifted(c, a, 1, by) - shifted(c, a, -1, by)) / 2 for n, (c, a) in cross.items()})


def smoothed_derivatives(df: DataFrame, by=("vol",), value: str = "value") -> DataFrame:
    """First and second differences averaged over the 3 x 3 lines around a voxel; the middle box only."""
    out = df
    for n, a in zip("uvw", AXES, strict=True):
        b, c = (x for x in AXES if x != a)
        out = out.withColumn("_m", F.col(value))
        for x in (b, c):
            out = out.withColumn("_m", shifted("_m", x, -1, by) + F.col("_m") + shifted("_m", x, 1, by))
        out = out.withColumns({n: (shifted("_m", a, 1, by) - shifted("_m", a, -1, by)) / 18, n * 2: (shifted("_m", a, 1, by) - 2 * F.col("_m") + shifted("_m", a, -1, by)) / 9})
    for n, (a, b) in {"uv": ("i", "j"), "uw": ("i", "k"), "vw": ("j", "k")}.items():
        c = next(x for x in AXES if x not in (a, b))
        out = out.withColumn("_m", shifted(value, c, -1, by) + F.col(value) + shifted(value, c, 1, by)).withColumn("_d", shifted("_m", a, 1, by) - shifted("_m", a, -1, by))
        out = out.withColumn(n, (shifted("_d", b, 1, by) - shifted("_d", b, -1, by)) / 12)
    return out.drop("_m", "_d")


def derivatives_2d(df: DataFrame, by=("vol", "k"), value: str = "value") -> DataFrame:
    """u v uu vv uv along i and j within each slice, first and second differences averaged over three lines; null at the border."""
    line = lambda a: Window.partitionBy(*by, "j" if a == "i" else "i").orderBy(a)
    step = lambda c, a, n: F.first(c).over(line(a).rangeBetween(n, n))
    out = df
    for n, a, b in (("u", "i", "j"), ("v", "j", "i")):
        out = out.withColumn("_m", step(value, b, -1) + F.col(value) + step(value, b, 1))
        out = out.withColumns({n: (step("_m", a, 1) - step("_m", a, -1)) / 6, n * 2: (step("_m", a, 1) - 2 * F.col("_m") + step("_m", a, -1)) / 3})
    out = out.withColumn("_d", step(value, "i", 1) - step(value, "i", -1))
    return out.withColumn("uv", (step("_d", "j", 1) - step("_d", "j", -1)) / 4).drop("_m", "_d")


def lvv_volume(df: DataFrame, size, least: float = 0.01, share: float = 0.9, by=("vol",)) -> DataFrame:
    """Lvv of interior voxels above a share of the volume's maximum, clamped to a share of its own range; others are not kept."""
    top = df.groupBy(*by).agg((F.max("value") * least).alias("_t"))
    d = derivatives(df, by).where(interior(size)).join(top, list(by)).where(F.col("value") > F.col("_t"))
    d = d.select(*by, *AXES, lvv().alias("lvv"))
    limits = d.groupBy(*by).agg((F.min("lvv") * share).alias("_a"), (F.max("lvv") * share).alias("_b"))
    return d.join(limits, list(by)).withColumn("lvv", F.least(F.greatest("lvv", F.least("_a", "_b")), F.greatest("_a", "_b"))).drop("_a", "_b")


def local_pca(df: DataFrame, by=("vol",), value: str = "value") -> DataFrame:
    """Moments about its own centre of the 27 values around each voxel that has all neighbours, and their eigenvalues, largest first.

    Sums of value times offset are window sums, axis by axis.
    """
    pair = {"x": "i", "y": "j", "z": "k"}
    sums = {"s": (0, 0, 0), "sx": (1, 0, 0), "sy": (0, 1, 0), "sz": (0, 0, 1), "sxx": (2, 0, 0), "syy": (0, 2, 0), "szz": (0, 0, 2), "sxy": (1, 1, 0), "sxz": (1, 0, 1), "syz": (0, 1, 1)}
    out = df.withColumns({f"_{n}": F.col(value) for n in sums})
    for k, a in enumerate(pair.values()):
        step = {n: [shifted(f"_{n}", a, d, by) for d in (-1, 1)] for n in sums}
        new = {}
        for n, powers in sums.items():
            low, high = step[n]
            new[f"_{n}"] = {0: low + F.col(f"_{n}") + high, 1: high - low, 2: low + high}[powers[k]]
        out = out.withColumns(new)
    out = out.where(F.col("_s").isNotNull() & (F.col("_s") != 0))
    mean = lambda n: F.col(f"_{n}") / F.col("_s")
    cov = {f"c{a}{b}": mean(f"s{a}{b}") - mean(f"s{a}") * mean(f"s{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")}
    out = out.withColumns(cov).drop(*(f"_{n}" for n in sums))
    return out.withColumns(dict(zip(("e1", "e2", "e3"), symmetric_eigenvalues(*(F.col(c) for c in cov)), strict=True)))


def lvv(threshold: float = 1e-12) -> Column:
    """Squared gradient times mean curvature, from the derivative columns."""
    u, v, w, uu, vv, ww, uv, uw, vw = (F.col(c) for c in ("u", "v", "w", "uu", "vv", "ww", "uv", "uw", "vw"))
    top = u * u * (vv + ww) + v * v * (uu + ww) + w * w * (uu + vv) - 2 * (u * v * uv + u * w * uw + v * w * vw)
    m2 = u * u + v * v + w * w
    return F.when(m2 > threshold, -0.5 * top / F.sqrt(m2)).otherwise(0.0)


def principal_curvatures() -> dict[str, Column]:
    """Gaussian (K) and mean (S) curvature of the isosurface and its principal curvatures, from the derivative columns."""
    u, v, w, uu, vv, ww, uv, uw, vw = (F.col(c) for c in ("u", "v", "w", "uu", "vv", "ww", "uv", "uw", "vw"))
    m2 = u * u + v * v + w * w
    k = (u * u * (vv * ww - vw * vw) + v * v * (uu * ww - uw * uw) + w * w * (uu * vv - uv * uv) + 2 * (u * v * (uw * vw - uv * ww) + v * w * (uv * uw - vw * uu) + u * w * (uv * vw - uw * vv))) / (m2 * m2)
    s = (u * u * (vv + ww) + v * v * (uu + ww) + w * w * (uu + vv) - 2 * (u * v * uv + u * w * uw + v * w * vw)) / (2 * F.pow(m2, F.lit(1.5)))
    root = F.sqrt(F.greatest(s * s - k, F.lit(0.0)))
    some = lambda c: F.when(m2 > 0, c)
    return {"gauss": some(k), "mean": some(s), "k1": some(s + root), "k2": some(s - root)}


def principal_curvature_2d(u: Column, v: Column, uu: Column, vv: Column, uv: Column) -> Column:
    m2 = u * u + v * v
    return F.when(m2 > 0, (2 * u * v * uv - u * u * vv - v * v * uu) / F.pow(m2, F.lit(1.5)))


def quadratic_step(sign: float = 1.0) -> dict[str, Column]:
    """The displacement -H^-1 g to the extremum of a quadratic fit: kept where sign times H is positive definite and it is
    shorter than 2; null elsewhere. sign 1: minimum, -1: maximum."""
    u, v, w, uu, vv, ww, uv, uw, vw = (F.col(c) * sign for c in ("u", "v", "w", "uu", "vv", "ww", "uv", "uw", "vw"))
    two = uu * vv - uv * uv
    det = uu * (vv * ww - vw * vw) - uv * (uv * ww - vw * uw) + uw * (uv * vw - vv * uw)
    inverse = [[vv * ww - vw * vw, uw * vw - uv * ww, uv * vw - uw * vv], [None, uu * ww - uw * uw, uv * uw - uu * vw], [None, None, two]]
    at = lambda r, c: inverse[min(r, c)][max(r, c)]
    d = [-(at(r, 0) * u + at(r, 1) * v + at(r, 2) * w) / det for r in range(3)]
    good = (uu > 0) & (two > 0) & (det > 0)
    short = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) < 2
    return {n: F.when(good, F.when(short, c)) for n, c in zip(("du", "dv", "dw"), d, strict=True)}


def quadratic_step_2d(sign: float = 1.0) -> dict[str, Column]:
    u, v, uu, vv, uv = (F.col(c) * sign for c in ("u", "v", "uu", "vv", "uv"))
    det = uu * vv - uv * uv
    du, dv = -(vv * u - uv * v) / det, -(uu * v - uv * u) / det
    good = (uu > 0) & (det > 0)
    return {n: F.when(good, F.when(F.sqrt(du * du + dv * dv) < 2, c)) for n, c in (("du", du), ("dv", dv))}


def kernel(step: float, fwhm: float, kind: str = "gaussian", reach: float = 3.0) -> list[float]:
    """Weights at 0, +-1, +-2 ... steps, normalised to sum to 1."""
    if kind == "gaussian":
        sigma = fwhm / 2.35482
        n = max(1, math.ceil(reach * sigma / abs(step)))
        half = [math.exp(-((k * step) ** 2) / (2 * sigma * sigma)) for k in range(n + 1)]
    else:
        n = max(0, int(fwhm / 2 / abs(step)))
        half = [1.0] * (n + 1)
    total = half[0] + 2 * sum(half[1:])
    return [h / total for h in half]


def blur_axis(df: DataFrame, axis: str, weights: list[float], by=("vol",), value: str = "value") -> DataFrame:
    """Weighted sum along an axis; what lies outside counts as 0."""
    out = F.col(value) * weights[0]
    for n, w in enumerate(weights[1:], 1):
        out = out + w * (F.coalesce(shifted(value, axis, n, by), F.lit(0.0)) + F.coalesce(shifted(value, axis, -n, by), F.lit(0.0)))
    return df.withColumn(value, out)


def blur(voxels: DataFrame, step, fwhm, kind: str = "gaussian") -> DataFrame:
    """Separable blur by window sums, one pass along each axis with a width."""
    for a, s, f in zip(AXES, step, fwhm, strict=True):
        if f:
            voxels = blur_axis(voxels, a, kernel(s, f, kind))
    return voxels


def next_power_of_two(n):
    """Of a number or a column."""
    if isinstance(n, Column):
        return F.when(n <= 1, 1).otherwise(F.pow(F.lit(2.0), F.length(F.bin(n.cast("long") - 1)))).cast("long")
    return 1 << max(0, (max(1, int(n)) - 1).bit_length())


def _spectrum(n: int, step: float, fwhm: float, kind: str) -> np.ndarray:
    """The transform of a kernel of area 1 laid out around index 0."""
    x = np.minimum(np.arange(n), n - np.arange(n)) * abs(step)
    if kind == "gaussian":
        s = fwhm / 2.35482
        k = np.exp(-x * x / (2 * s * s)) / (s * math.sqrt(2 * math.pi)) * abs(step)
    else:
        k = np.where(x < fwhm / 2, abs(step) / fwhm, 0.0)
    return np.fft.fft(k)


def _per_line(voxels: DataFrame, axis: str, work) -> DataFrame:
    """Each line along an axis becomes one array; lines of equal length are worked on together, as the rows of a matrix."""
    others = ["vol", *(a for a in AXES if a != axis)]
    packed = voxels.groupBy(*others).agg(F.sort_array(F.collect_list(F.struct(F.col(axis).alias("at"), "value"))).alias("p"))
    flat = packed.select(*others, F.col("p.at").alias("at"), F.col("p.value").alias("line"))
    schema = T.StructType([*flat.schema.fields[:-1], T.StructField("line", T.ArrayType(T.DoubleType()))])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in parts:
            length = t["line"].map(len)
            for n in length.unique():
                same = t[length == n].copy()
                same["line"] = list(work(np.stack(same["line"].to_numpy()).astype(float)))
                yield same

    out = flat.mapInPandas(run, schema).select(*others, F.explode(F.arrays_zip("at", "line")).alias("z"))
    return out.select(*(F.col("z.at").alias(c) if c == axis else F.col("z.line").alias(c) if c == "value" else c for c in voxels.columns))


def fft_blur(voxels: DataFrame, step, fwhm, kind: str = "gaussian", order: int = 0) -> DataFrame:
    """Convolution of every line with zero padding to a power of two, by the fast Fourier transform."""
    for a, s, f in zip(AXES, step, fwhm, strict=True):
        if not f:
            continue

        def work(v: np.ndarray, s=s, f=f) -> np.ndarray:
            n = next_power_of_two(2 * v.shape[1])
            return np.real(np.fft.ifft(np.fft.fft(v, n) * _spectrum(n, s, f, kind)))[:, : v.shape[1]]

        voxels = _per_line(voxels, a, work)
    return voxels


def fft_derivative(voxels: DataFrame, axis: str, step: float, order: int = 1) -> DataFrame:
    """First or second derivative along an axis by the Fourier ramp, on lines padded to a power of two with their end values."""

    def work(v: np.ndarray) -> np.ndarray:
        length = v.shape[1]
        n = next_power_of_two(2 * length)
        bridge = np.linspace(v[:, -1], v[:, 0], n - length + 2, axis=1)[:, 1:-1]
        ramp = 2j * np.pi * np.fft.fftfreq(n, d=step)
        return np.real(np.fft.ifft(np.fft.fft(np.concatenate([v, bridge], 1)) * ramp**order))[:, :length]

    return _per_line(voxels, axis, work)


def fft_gradient(voxels: DataFrame, step, order: int = 1) -> DataFrame:
    """dx, dy, dz and the magnitude, by Fourier derivatives."""
    out = voxels.select("vol", *AXES)
    for name, a, s in zip(DISPLACEMENT, AXES, step, strict=True):
        out = out.join(fft_derivative(voxels, a, s, order).withColumnRenamed("value", name), ["vol", *AXES])
    return out.withColumn("dxyz", F.sqrt(sum(F.col(c) * F.col(c) for c in DISPLACEMENT)))


def chamfer(voxels: DataFrame, size, step, longest: float = 50.0) -> DataFrame:
    """Distance to the nearest voxel that is not 0 by two raster passes of a 3 x 3 x 3 mask; border slices keep their start value.

    The passes are sequential within a volume, so each volume is one group; volumes run side by side.
    """
    before = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) < (0, 0, 0)]

    def run(t: pd.DataFrame) -> pd.DataFrame:
        d = np.full(size, float(longest))
        at = tuple(t[a].to_numpy() for a in AXES)
        d[at] = np.where(t["value"].to_numpy() != 0, 0.0, longest)
        for offsets in (before, [tuple(-x for x in o) for o in before]):
            back = offsets is not before
            rows = range(size[0] - 2, 0, -1) if back else range(1, size[0] - 1)
            lines = range(size[1] - 2, 0, -1) if back else range(1, size[1] - 1)
            cells = range(size[2] - 2, 0, -1) if back else range(1, size[2] - 1)
            mask = [(o, math.sqrt(sum((x * s) ** 2 for x, s in zip(o, step, strict=True)))) for o in offsets]
            flat = [(o, w) for o, w in mask if o[:2] != (0, 0)]
            own = [(o, w) for o, w in mask if o[:2] == (0, 0)]
            for i in rows:
                for j in lines:
                    best = d[i, j, 1:-1].copy()
                    for (a, b, c), w in flat:
                        np.minimum(best, d[i + a, j + b, 1 + c : size[2] - 1 + c] + w, out=best)
                    d[i, j, 1:-1] = best
                    for k in cells:
                        for (_, _, c), w in own:
                            d[i, j, k] = min(d[i, j, k], d[i, j, k + c] + w)
        return t.assign(value=d[at])

    return voxels.groupBy("vol").applyInPandas(run, voxels.schema)


def local_eigen(df: DataFrame, by=("vol",)) -> DataFrame:
    """Eigenvalues of the Hessian, largest first, of each voxel that has all derivatives and where it is positive semidefinite."""
    names = ("uu", "uv", "uw", "vv", "vw", "ww")
    live = derivatives(df, by).where(" and ".join(f"{c} is not null" for c in names))
    live = live.where(positive_semidefinite({c: F.col(c) for c in names}))
    return live.withColumns(dict(zip(("e1", "e2", "e3"), symmetric_eigenvalues(*(F.col(c) for c in names)), strict=True)))


def isotropic_smooth(weight: float) -> dict[str, Column]:
    """Displacement towards the neighbours' mean (mean_dx ...), alike in all directions."""
    return {c: F.col(c) * (1 - weight) + F.col(f"mean_{c}") * weight for c in DISPLACEMENT}


def anisotropic_smooth(grid: DataFrame, confidence: list[Column], axes: list[list[Column]], weight: float) -> dict[str, Column]:
    """Displacement towards the neighbours' mean (mean_dx ...), along each eigenvector by one minus its confidence."""
    diff = [F.col(f"mean_{c}") - F.col(c) for c in DISPLACEMENT]
    move = [F.lit(0.0)] * 3
    for conf, axis in zip(confidence, axes, strict=True):
        along = sum((d * a for d, a in zip(diff, axis, strict=True)), F.lit(0.0)) * (1 - conf) * weight
        move = [m + along * a for m, a in zip(move, axis, strict=True)]
    return {c: F.col(c) + m for c, m in zip(DISPLACEMENT, move, strict=True)}


def cubic_middle(df: DataFrame, axis: str, by: tuple[str, ...], t: float = 0.5, value: str = "value") -> DataFrame:
    """middle, slope and bend: value, first and second derivative at t between each node and the next one, of the cubic
    through four nodes of a line; null next to an end."""
    w = Window.partitionBy(*by).orderBy(axis)
    a, b, c, d = F.lag(value).over(w), F.col(value), F.lead(value).over(w), F.lead(value, 2).over(w)
    terms = [2 * b, c - a, 2 * a - 5 * b + 4 * c - d, 3 * b - a - 3 * c + d]
    power = lambda order: sum((x * float(math.perm(k, order) * t ** (k - order)) for k, x in enumerate(terms) if k >= order), F.lit(0.0)) / 2
    return df.withColumns({n: power(k) for k, n in enumerate(("middle", "slope", "bend"))})


def supersample_axis(df: DataFrame, axis: str, n: int, by=("vol",), value: str = "value") -> DataFrame:
    """Twice the nodes less one along an axis: (-a + 9 b + 9 c - d) / 16 between nodes, the mean next to an end."""
    a, c, d = (shifted(value, axis, x, by) for x in (-1, 1, 2))
    mid = F.coalesce((-a + 9 * F.col(value) + 9 * c - d) / 16, (F.col(value) + c) / 2)
    both = df.withColumn("_mid", mid).withColumn("_s", F.explode(F.array(F.lit(0), F.lit(1))))
    kept = both.where((F.col("_s") == 0) | F.col("_mid").isNotNull())
    return kept.withColumn(value, F.when(F.col("_s") == 0, F.col(value)).otherwise(F.col("_mid"))).withColumn(axis, (F.col(axis) * 2 + F.col("_s")).cast("int")).drop("_mid", "_s")


def supersample(df: DataFrame, size, by=("vol",), value: str = "value") -> DataFrame:
    """The three passes; an axis of length 1 stays."""
    for a, n in zip(AXES, size, strict=True):
        if n > 1:
            df = supersample_axis(df, a, n, by, value)
    return df


def local_scale(grid: DataFrame, kind: int = 6, by=("vol",)) -> DataFrame:
    """Mean ratio of warped to unwarped distance to the 6 neighbours: how much a field stretches."""
    ratio, n = F.lit(0.0), F.lit(0)
    for axis, own in zip(AXES, DISPLACEMENT, strict=True):
        for d in (-1, 1):
            near = {c: shifted(c, axis, d, by) for c in DISPLACEMENT}
            dist = F.sqrt(sum((near[c] - F.col(c) + (float(d) if c == own else 0.0)) ** 2 for c in DISPLACEMENT))
            ratio = ratio + F.coalesce(dist, F.lit(0.0))
            n = n + F.when(dist.isNotNull(), 1).otherwise(0)
    return grid.withColumn("_r", ratio).withColumn("_n", n).withColumn("scale", F.when(F.col("_n") > 0, F.col("_r") / F.col("_n"))).drop("_r", "_n")


def mean_warped_position(grid: DataFrame, step=(1.0, 1.0, 1.0), start=(0.0, 0.0, 0.0), by=("vol",)) -> DataFrame:
    """Where a node's six neighbours are moved to, on average, less their own mean offset: node plus mean displacement."""
    m = neighbour_mean(grid, DISPLACEMENT, 6, by)
    return m.withColumns({f"mean_{c}": F.col(a) * float(s) + float(b) + F.col(f"mean_{d}") for c, a, d, s, b in zip("xyz", AXES, DISPLACEMENT, step, start, strict=True)}).drop("n_neighbours", *(f"mean_{d}" for d in DISPLACEMENT))


def supersampled_geometry(g: Geometry) -> Geometry:
    """Half the step and twice the nodes less one, on axes longer than one."""
    size = tuple(2 * n - 1 if n > 1 else 1 for n in g.size)
    return Geometry(size, tuple(s / 2 if n > 1 else s for s, n in zip(g.step, g.size, strict=True)), g.start, g.dircos)


def magnitude(grid: DataFrame) -> DataFrame:
    return grid.withColumn("magnitude", F.sqrt(sum(F.col(c) * F.col(c) for c in DISPLACEMENT)))
