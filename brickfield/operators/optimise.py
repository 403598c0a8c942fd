"""Linear fits: a small controller on the driver around one evaluation of many candidate matrices.

The source is sampled once on the lattice. An evaluation takes a list of candidate matrices and costs one job: lattice points
times candidates (a literal array), trilinear gather in the target, one aggregate for each candidate. A lattice of at most
LOCAL_POINTS points and a target of as few voxels are checked by count and then evaluated in numpy on the driver, to the same
values; both ways have all objectives. Mutual information votes with the eight voxels around each point, weighted by their shares,
in byte bins over the whole range of either volume; a histogram has 256 x 256 bins whatever the volumes' size, and is finished
on the driver.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.transforms import FREE, WEIGHTS, Parameters, align_axes, angles, pack, principal_axes, unpack
from ..model import AXES, Geometry, affine
from . import measures
from .sample import XYZ, lattice, lattice_of, nearest, partial_volume, transformed, trilinear
from .voxelwise import segment

LOCAL_POINTS = 2_000_000
OUT_OF_BOUNDS = 1e10


class Simplex:
    """The downhill simplex: reflect 1, stretch 2, contract 0.5, shrink."""

    def __init__(self, start, step, objective: Callable[[list[np.ndarray]], list[float]], tolerance: float = 0.005, most: int = 400) -> None:
        self.objective, self.tolerance, self.most, self.used = objective, tolerance, most, 0
        start, step = np.asarray(start, float), np.broadcast_to(np.asarray(step, float), np.shape(start))
        n = len(start)
        tries = [start, *(start + s * step[k] * np.eye(n)[k] for k in range(n) for s in (1, -1))]
        values = self._values(tries)
        pick = [0, *(1 + 2 * k + int(values[2 + 2 * k] < values[1 + 2 * k]) for k in range(n))]
        self.points, self.values, self.flat = np.array([tries[p] for p in pick]), np.array([values[p] for p in pick]), 0

    def _values(self, points: list[np.ndarray]) -> list[float]:
        self.used += len(points)
        return self.objective(points)

    def _try(self, worst: int, factor: float) -> float:
        n = self.points.shape[1]
        others = self.points.sum(0) - self.points[worst]
        p = others / n * (1 - factor) + self.points[worst] * factor
        (value,) = self._values([p])
        if value < self.values[worst]:
            self.points[worst], self.values[worst] = p, value
        return value

    def step(self) -> bool:
        """One move; False when three moves in a row have changed too little, or the evaluations are used up."""
        order = np.argsort(self.values)
        low, next_high, high = order[0], order[-2], order[-1]
        spread = 2 * abs(self.values[high] - self.values[low])
        self.flat = self.flat + 1 if spread <= self.tolerance * (abs(self.values[high]) + abs(self.values[low]) + 1e-12) else 0
        if self.flat >= 3 or self.used >= self.most:
            return False
        value = self._try(high, -1.0)
        if value < self.values[low]:
            self._try(high, 2.0)
        elif value >= self.values[next_high]:
            before = self.values[high]
            if self._try(high, 0.5) >= before:
                rest = [k for k in range(len(self.points)) if k != low]
                for k in rest:
                    self.points[k] = (self.points[k] + self.points[low]) / 2
                self.values[rest] = self._values([self.points[k] for k in rest])
        return True

    def run(self) -> np.ndarray:
        while self.step():
            pass
        return self.points[np.argmin(self.values)]


def timed(text: str, work: Callable[[], object]):
    """What work() gives; how long it took goes to the log."""
    began = time.perf_counter()
    try:
        return work()
    finally:
        logging.getLogger(__name__).info("%s: %.3f s", text, time.perf_counter() - began)


def lbfgs(start, objective: Callable[[list[np.ndarray]], list[float]], delta: float = 5e-5, memory: int = 6, most: int = 60, tolerance: float = 1e-6) -> np.ndarray:
    """Limited-memory BFGS with forward differences: a gradient is one batch of n + 1 evaluations."""
    x = np.asarray(start, float)

    def slope(x):
        values = objective([x, *(x + delta * e for e in np.eye(len(x)))])
        return values[0], (np.array(values[1:]) - values[0]) / delta

    f, g = slope(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(most):
        q, alphas = g.copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (y @ s)
            alphas.append(a)
            q -= a * y
        q *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1.0, np.linalg.norm(g))
        for (s, y), a in zip(pairs, reversed(alphas), strict=True):
            q += (a - (y @ q) / (y @ s)) * s
        lengths = [4.0, 2.0, 1.0, 0.5, 0.25, 0.1, 0.03, 0.01]
        values = objective([x - t * q for t in lengths])
        best = int(np.argmin(values))
        if values[best] >= f - tolerance * abs(f):
            break
        new = x - lengths[best] * q
        f, g_new = slope(new)
        s, y = new - x, g_new - g
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y)][-memory:]
        x, g = new, g_new
    return x


def golden(f: Callable[[float], float], a: float, b: float, tolerance: float = 1e-6) -> float:
    """Minimum of a function of one number within a bracket, by golden section."""
    r = (5**0.5 - 1) / 2
    c, d = b - r * (b - a), a + r * (b - a)
    fc, fd = f(c), f(d)
    while abs(b - a) > tolerance:
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - r * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + r * (b - a)
            fd = f(d)
    return (a + b) / 2


def bracket(f: Callable[[float], float], a: float, b: float, most: int = 60) -> tuple[float, float, float]:
    """Three points with the lowest in the middle, going downhill from a and b."""
    fa, fb = f(a), f(b)
    if fb > fa:
        a, b, fa, fb = b, a, fb, fa
    c = b + 1.618034 * (b - a)
    fc = f(c)
    while fb > fc and most:
        a, b, fa, fb = b, c, fb, fc
        c = b + 1.618034 * (b - a)
        fc = f(c)
        most -= 1
    return a, b, c


def _numpy_trilinear(volume: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, inside) at voxel positions; nearest neighbour outside the inner box."""
    size = np.array(volume.shape)
    inside = np.all((p >= -0.5) & (p < size - 0.5), 1)
    inner = np.all((p >= 0) & (p < size - 1), 1)
    out = np.zeros(len(p))
    q = np.floor(p[inner]).astype(int)
    t = p[inner] - q
    total = np.zeros(len(q))
    for d in np.ndindex(2, 2, 2):
        w = np.prod(np.where(np.array(d) == 1, t, 1 - t), 1)
        total += w * volume[tuple((q + d).T)]
    out[inner] = total
    edge = inside & ~inner
    out[edge] = volume[tuple(np.floor(p[edge] + 0.5).astype(int).T)]
    return out, inside


BINS, GROUPS = 256, 256
#: Width of the box that smooths histograms, 1 for none.
BLUR = 3


def _box_mean(p: np.ndarray, width: int) -> np.ndarray:
    """Means over `width` bins along the last axis; the nth bin from an end is a mean of 2n + 1."""
    n, h = p.shape[-1], width // 2
    total = np.concatenate([np.zeros((*p.shape[:-1], 1)), np.cumsum(p, -1)], -1)
    reach = np.minimum(h, np.minimum(np.arange(n), n - 1 - np.arange(n)))
    return (total[..., np.arange(n) + reach + 1] - total[..., np.arange(n) - reach]) / (2 * reach + 1)


def information(hist: np.ndarray, normalised: bool, blur: int = BLUR) -> float:
    """Minus the mutual information of a joint histogram, or minus its share of the marginal entropies."""
    if not hist.sum():
        return OUT_OF_BOUNDS
    p = _box_mean(_box_mean(hist / hist.sum(), blur).T, blur).T if blur > 1 else hist / hist.sum()
    px, py = p.sum(1), p.sum(0)
    i, j = np.nonzero(p)
    mi = float((p[i, j] * np.log(p[i, j] / (px[i] * py[j]))).sum())
    h = -sum(float((q[q > 0] * np.log(q[q > 0])).sum()) for q in (px, py))
    return -mi if not normalised else -mi / h if h else 0.0


def _bytes(v, low: float, high: float):
    """Byte bins over a volume's range, of an array or a column."""
    if isinstance(v, Column):
        return F.floor((v - low) / (high - low) * 255 + 0.5).cast("int") if high > low else F.lit(0)
    return np.floor((v - low) / (high - low) * 255 + 0.5).astype(int) if high > low else np.zeros(len(v), int)


def _numpy_objective(name: str, a: np.ndarray, b: np.ndarray) -> float:
    if not len(a):
        return OUT_OF_BOUNDS
    if name == "xcorr":
        norm = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())
        return float(1 - (a * b).sum() / norm) if norm else OUT_OF_BOUNDS
    if name == "zscore":
        return float(np.sqrt(((a - b) ** 2).sum()) / len(a))
    if name == "vr":
        ok = b != 0
        lo, hi = a.min(), a.max()
        a, b = a[ok], b[ok]
        group = np.floor(1 + (a - lo) * (GROUPS - 1e-5) / (hi - lo)).astype(int) if hi > lo else np.ones(len(a), int)
        n = np.bincount(group)
        ratio = a / b
        mean = np.bincount(group, ratio) / np.maximum(n, 1)
        spread = np.bincount(group, (ratio - mean[group]) ** 2)
        many = n > 1
        return float((spread[many] / (n[many] - 1) * n[many]).sum() / n.sum()) if n.sum() > 1 else 1e15
    if name == "ssc":
        d = np.sign(a - b)
        known = np.concatenate([[0.0], d])
        last = known[np.maximum.accumulate(np.where(known != 0, np.arange(len(known)), 0))][:-1]
        return -float((d == 0).sum() + ((d != 0) & (last != 0) & (d != last)).sum())
    raise ValueError(name)


def _by_candidate(both: DataFrame, name: str) -> DataFrame:
    """(_c, o): the objective of each candidate, from its points' v1 and v2."""
    a, b = F.col("v1"), F.col("v2")
    if name in ("xcorr", "zscore"):
        return both.groupBy("_c").agg({"xcorr": measures.xcorr, "zscore": measures.zscore_difference}[name](a, b).alias("o"))
    if name == "vr":
        limits = F.broadcast(both.groupBy("_c").agg(F.min(a).alias("_lo"), F.max(a).alias("_hi")))  # a row for each candidate
        group = F.when(F.col("_hi") > F.col("_lo"), segment(a, F.col("_lo"), F.col("_hi"), GROUPS)).otherwise(1)
        return measures.variance_ratio(both.join(limits, "_c"), group, a, b, ("_c",)).select("_c", F.col("variance_ratio").alias("o"))
    if name == "ssc":
        return measures.sign_changes(both, a - b, ["pid"], ("_c",)).select("_c", F.col("ssc").alias("o"))
    raise ValueError(name)


class Evaluator:
    """Objective of candidate source-to-target matrices on a lattice over the source. close() lets its tables go."""

    def __init__(self, source: DataFrame, source_g: Geometry, target: DataFrame, target_g: Geometry, objective: str = "xcorr", step=(4.0, 4.0, 4.0), thresholds=(0.0, 0.0), mask: DataFrame | None = None, target_mask: DataFrame | None = None, local: bool | None = None) -> None:
        spark = source.sparkSession
        spec = lattice_of(source_g, step)
        nodes = lattice(spark, spec["start"], spec["step"], spec["count"])
        at = nearest(transformed(nodes, source_g.to_voxel()), source, source_g.size, "v1").where(F.col("v1") > thresholds[0])
        if mask is not None:
            at = _within(at, mask)
        # The value is the nearest voxel's, so it is that voxel that is mapped, not the node.
        at = at.withColumns({c: F.floor(F.col(c) + 0.5) for c in XYZ})
        world = affine(source_g.to_world(), *XYZ)
        self.points = at.select("pid", *(w.alias(c) for w, c in zip(world, XYZ, strict=True)), "v1").persist()
        self.target, self.target_g, self.objective, self.threshold = target.select("vol", *AXES, "value").persist(), target_g, objective, thresholds[1]
        self.target_mask = None if target_mask is None else target_mask.where("value > 0").select(*AXES).distinct()
        if objective in ("mi", "nmi"):
            self.ranges = [tuple(v.agg(F.min("value"), F.max("value")).first()) for v in (source, self.target)]
        voxels = int(np.prod(target_g.size))
        self.local = (voxels <= LOCAL_POINTS and self.points.count() <= LOCAL_POINTS) if local is None else local
        if self.local:  # both counted to be small
            rows = self.points.orderBy("pid").toPandas()
            self._p, self._v1 = rows[list(XYZ)].to_numpy(), rows["v1"].to_numpy()
            self._volume = self._array(self.target, "value")
            self._live = None if self.target_mask is None else self._array(self.target_mask.withColumn("value", F.lit(1.0)), "value") > 0

    def _array(self, df: DataFrame, value: str) -> np.ndarray:
        t, out = df.select(*AXES, value).toPandas(), np.zeros(self.target_g.size)
        out[tuple(t[a].to_numpy() for a in AXES)] = t[value]
        return out

    def close(self) -> None:
        self.points.unpersist()
        self.target.unpersist()

    def __call__(self, matrices: list[np.ndarray]) -> list[float]:
        voxel = [self.target_g.to_voxel() @ m for m in matrices]
        information_asked = self.objective in ("mi", "nmi")
        if self.local:
            return [self._information_here(m) if information_asked else self._here(m) for m in voxel]
        n = len(voxel)
        table = F.array(*(F.array(*(F.lit(float(x)) for x in m[:3].ravel())) for m in voxel))
        each = self.points.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        m = F.element_at(table, F.col("_c") + 1)
        row = lambda r: sum((F.element_at(m, 4 * r + q + 1) * F.col(c) for q, c in enumerate(XYZ)), F.element_at(m, 4 * r + 4))
        moved = each.select((F.col("pid") * n + F.col("_c")).alias("pid"), "_c", "v1", *(row(r).alias(c) for r, c in enumerate(XYZ)))
        if self.target_mask is not None:
            moved = _within(moved, self.target_mask.withColumn("value", F.lit(1)))
        if information_asked:
            return self._information(moved, n)
        both = trilinear(moved, self.target, self.target_g.size, "v2").where(F.col("v2") > self.threshold)
        got = {r["_c"]: r["o"] for r in _by_candidate(both, self.objective).collect()}  # a row for each candidate
        return [OUT_OF_BOUNDS if got.get(k) is None else float(got[k]) for k in range(n)]

    def _moved_here(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in the target, whether the target's mask has them)."""
        at = self._p @ m[:3, :3].T + m[:3, 3]
        if self._live is None:
            return at, np.ones(len(at), bool)
        near = np.floor(at + 0.5).astype(int)
        inside = np.all((near >= 0) & (near < self.target_g.size), 1)
        inside[inside] = self._live[tuple(near[inside].T)]
        return at, inside

    def _here(self, m: np.ndarray) -> float:
        at, live = self._moved_here(m)
        v2, inside = _numpy_trilinear(self._volume, at)
        keep = live & inside & (v2 > self.threshold)
        return _numpy_objective(self.objective, self._v1[keep], v2[keep])

    def _information_here(self, m: np.ndarray) -> float:
        at, live = self._moved_here(m)
        keep = live & np.all((at >= 0) & (at < np.array(self._volume.shape) - 1), 1)
        at, b1 = at[keep], _bytes(self._v1[keep], *self.ranges[0])
        q = np.floor(at).astype(int)
        t, hist = at - q, np.zeros(BINS * BINS)
        for d in np.ndindex(2, 2, 2):
            value = self._volume[tuple((q + d).T)]
            w = np.prod(np.where(np.array(d) == 1, t, 1 - t), 1) * (value > self.threshold)
            hist += np.bincount(b1 * BINS + _bytes(value, *self.ranges[1]), w, BINS * BINS)
        return information(hist.reshape(BINS, BINS), self.objective == "nmi")

    def _information(self, moved: DataFrame, n: int) -> list[float]:
        rows = partial_volume(moved, self.target, self.target_g.size, ("_c", "v1"), join_by=()).where(F.col("value") > self.threshold)
        bins = rows.groupBy("_c", _bytes(F.col("v1"), *self.ranges[0]).alias("b1"), _bytes(F.col("value"), *self.ranges[1]).alias("b2")).agg(F.sum("share").alias("w"))
        hist = np.zeros((n, BINS, BINS))
        t = bins.toPandas()  # at most BINS squared rows for each candidate
        hist[t["_c"], t["b1"], t["b2"]] = t["w"]
        return [information(h, self.objective == "nmi") for h in hist]


def _within(points: DataFrame, mask: DataFrame) -> DataFrame:
    """Points (voxel coordinates) whose nearest voxel is in a mask."""
    live = mask.where("value > 0").select(*(F.col(a).alias(f"_{a}") for a in AXES))
    keyed = points.withColumns({f"_{a}": F.floor(F.col(c) + 0.5).cast("int") for a, c in zip(AXES, XYZ, strict=True)})
    return keyed.join(live, ["_i", "_j", "_k"], "left_semi").drop("_i", "_j", "_k")


def moments(voxels: DataFrame, g: Geometry) -> tuple[np.ndarray, np.ndarray]:
    """World centre of gravity and covariance, in one aggregation."""
    at = affine(g.to_world(), *AXES)
    row = voxels.agg(*measures.centre_of_gravity(*at, F.col("value")), *measures.covariance(*at, F.col("value"))).first()
    return np.array([row["cx"], row["cy"], row["cz"]]), measures.covariance_matrix(row)


def principal_axis_start(source: DataFrame, source_g: Geometry, target: DataFrame, target_g: Geometry) -> Parameters:
    """Centre and translation from the centres of gravity, rotation from the axes of covariance; scales stay 1."""
    c1, cov1 = moments(source, source_g)
    c2, cov2 = moments(target, target_g)
    turn = angles(align_axes(principal_axes(cov1), principal_axes(cov2)))
    return Parameters(center=c1, translations=c2 - c1, rotations=np.array(turn if turn else (0, 0, 0)))


def linear_fit(source: DataFrame, source_g: Geometry, target: DataFrame, target_g: Geometry, kind: str = "lsq6", objective: str = "xcorr", start: Parameters | None = None, step=(4.0, 4.0, 4.0), simplex: float = 20.0, tolerance: float = 0.005, thresholds=(0.0, 0.0), optimiser: str = "simplex", quaternions: bool = False, mask: DataFrame | None = None, target_mask: DataFrame | None = None, local: bool | None = None, most: int = 400) -> Parameters:
    """The parameters of the transform from source to target that make the objective least; most: evaluations that the simplex may use."""
    p = start or Parameters(center=moments(source, source_g)[0])
    if quaternions and p.quaternion is None:
        from ..functions.transforms import matrix_quaternion, rotation

        p = replace(p, quaternion=matrix_quaternion(rotation(*p.rotations)))
    evaluate = Evaluator(source, source_g, target, target_g, objective, step, thresholds, mask, target_mask, local)

    def values(points: list[np.ndarray]) -> list[float]:
        made = [unpack(p, x, kind) for x in points]
        good = [m.in_bounds() for m in made]
        got = iter(evaluate([m.matrix() for m, g in zip(made, good, strict=True) if g]) if any(good) else [])
        return [next(got) if g else OUT_OF_BOUNDS for g in good]

    first = pack(p, FREE[kind])
    try:
        return unpack(p, lbfgs(first, values) if optimiser == "bfgs" else Simplex(first, simplex, values, tolerance, most).run(), kind)
    finally:
        evaluate.close()


def measure_fit(source, source_g, target, target_g, matrix: np.ndarray, objective: str = "xcorr", **options) -> float:
    evaluate = Evaluator(source, source_g, target, target_g, objective, **options)
    try:
        return evaluate([matrix])[0]
    finally:
        evaluate.close()


def objective_curves(evaluate: Callable[[list[np.ndarray]], list[float]], p: Parameters, steps: int = 15, simplex: float = 20.0) -> list[tuple[int, float, float, float]]:
    """(parameter, offset, value, objective) for 2 steps + 1 offsets of each of the twelve parameters, in one batch."""
    v, rows = p.vector(), []
    for k in range(12):
        for n in range(-steps, steps + 1):
            offset = n / steps * simplex * WEIGHTS[k]
            rows.append((k, offset, v[k] + offset, p.with_vector(v + offset * np.eye(12)[k]).matrix()))
    return [(k, o, x, f) for (k, o, x, _), f in zip(rows, evaluate([m for *_, m in rows]), strict=True)]
