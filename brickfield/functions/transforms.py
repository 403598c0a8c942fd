"""3x3 and 4x4 algebra on the driver: composing, decomposing, inverting, quaternions, eigenvectors.

Matrices act on column vectors. Angles are radians unless a name says degrees.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np


def translation(t) -> np.ndarray:
    m = np.eye(4)
    m[:3, 3] = t
    return m


def homogeneous(a) -> np.ndarray:
    m = np.eye(4)
    a = np.asarray(a, float)
    m[: a.shape[0], : a.shape[1]] = a
    return m


def rotation(rx: float, ry: float, rz: float) -> np.ndarray:
    """Rz Ry Rx as 3x3."""
    cx, sx, cy, sy, cz, sz = (f(a) for a in (rx, ry, rz) for f in (np.cos, np.sin))
    x = np.array([[1, 0, 0], [0, cx, -sx], [0, sx, cx]])
    y = np.array([[cy, 0, sy], [0, 1, 0], [-sy, 0, cy]])
    z = np.array([[cz, -sz, 0], [sz, cz, 0], [0, 0, 1]])
    return z @ y @ x


def shears(a: float, b: float, c: float) -> np.ndarray:
    """Lower triangular: a at (2,1), b at (3,1), c at (3,2)."""
    return np.array([[1, 0, 0], [a, 1, 0], [b, c, 1]], float)


def angles(r: np.ndarray) -> tuple[float, float, float] | None:
    """The angles of Rz Ry Rx, or None where one is outside +-pi/2."""
    r = np.asarray(r, float)[:3, :3]
    ry = np.arcsin(np.clip(-r[2, 0], -1, 1))
    if abs(np.cos(ry)) < 1e-9:
        rx, rz = np.arctan2(-r[1, 2], r[1, 1]), 0.0
    else:
        rx, rz = np.arctan2(r[2, 1], r[2, 2]), np.arctan2(r[1, 0], r[0, 0])
    limit = np.pi / 2 + 1e-9
    return (float(rx), float(ry), float(rz)) if abs(rx) <= limit and abs(rz) <= limit else None


@dataclass
class Parameters:
    """A linear transform by its parts, and the optimiser's weights of its twelve numbers (0: frozen)."""

    center: np.ndarray = field(default_factory=lambda: np.zeros(3))
    translations: np.ndarray = field(default_factory=lambda: np.zeros(3))
    rotations: np.ndarray = field(default_factory=lambda: np.zeros(3))
    scales: np.ndarray = field(default_factory=lambda: np.ones(3))
    shears: np.ndarray = field(default_factory=lambda: np.zeros(3))
    quaternion: np.ndarray | None = None

    def matrix(self) -> np.ndarray:
        """T C S SH R -C."""
        turn = self.quaternion
        r = rotation(*self.rotations) if turn is None else quaternion_matrix(turn)
        return translation(self.translations) @ translation(self.center) @ homogeneous(np.diag(self.scales)) @ homogeneous(shears(*self.shears)) @ homogeneous(r) @ translation(-np.asarray(self.center, float))

    def inverse(self) -> np.ndarray:
        return np.linalg.inv(self.matrix())

    def vector(self) -> np.ndarray:
        return np.concatenate([self.translations, self.rotations if self.quaternion is None else self.quaternion[:3], self.scales, self.shears]).astype(float)

    def with_vector(self, v) -> Parameters:
        v = np.asarray(v, float)
        if self.quaternion is None:
            return replace(self, translations=v[:3], rotations=v[3:6], scales=v[6:9], shears=v[9:12])
        w = np.sqrt(max(0.0, 1.0 - float(v[3:6] @ v[3:6])))
        return replace(self, translations=v[:3], quaternion=np.array([*v[3:6], w]), scales=v[6:9], shears=v[9:12])

    def in_bounds(self) -> bool:
        """Rotations within +-pi/2 (quaternion parts within 2), scales 0 to 3, shears within 2."""
        turn = np.abs(self.rotations) <= np.pi / 2 if self.quaternion is None else np.abs(self.quaternion) <= 2
        return bool(np.all(turn) and np.all((self.scales >= 0) & (self.scales <= 3)) and np.all(np.abs(self.shears) <= 2))


def from_degrees(translations=(0, 0, 0), rotations=(0, 0, 0), scales=(1, 1, 1), shear=(0, 0, 0), center=(0, 0, 0)) -> np.ndarray:
    """Parameters in millimetres and degrees to a matrix."""
    p = Parameters(*(np.asarray(a, float) for a in (center, translations, np.radians(rotations), scales, shear)))
    return p.matrix()


def decompose(m: np.ndarray, center=(0, 0, 0)) -> Parameters:
    """The parts of T C S SH R -C for a given centre: the linear part is a lower triangle times a rotation."""
    m, center = np.asarray(m, float), np.asarray(center, float)
    a = m[:3, :3]
    q, r = np.linalg.qr(a.T)
    sign = np.diag(np.where(np.diag(r) < 0, -1.0, 1.0))
    lower, turn = (sign @ r).T, (q @ sign).T
    if np.linalg.det(turn) < 0:
        lower, turn = lower @ np.diag([1, 1, -1]), np.diag([1, 1, -1]) @ turn
    scales = np.diag(lower)
    sh = lower / scales[:, None]
    found = angles(turn)
    if found is None:
        raise ValueError("a rotation is beyond 90 degrees")
    t = m[:3, 3] - center + a @ center
    return Parameters(center, t, np.array(found), scales, np.array([sh[1, 0], sh[2, 0], sh[2, 1]]))


def decompose_quaternion(m: np.ndarray, center=(0, 0, 0)) -> Parameters:
    p = decompose(m, center)
    return replace(p, quaternion=matrix_quaternion(rotation(*p.rotations)))


def check_scale(p: Parameters) -> Parameters:
    """A z scale over 1.15 times the mean of the other two becomes that mean."""
    mean = (p.scales[0] + p.scales[1]) / 2
    return replace(p, scales=np.array([*p.scales[:2], mean])) if p.scales[2] > 1.15 * mean else p


def axis_quaternion(axis, angle: float) -> np.ndarray:
    """(x, y, z, w)"""
    a = np.asarray(axis, float)
    return np.array([*(a / np.linalg.norm(a) * np.sin(angle / 2)), np.cos(angle / 2)])


def quaternion_axis(q) -> tuple[np.ndarray, float]:
    n = np.linalg.norm(q[:3])
    return (np.asarray(q[:3]) / n if n else np.array([1.0, 0, 0])), float(2 * np.arctan2(n, q[3]))


def normalise_quaternion(q) -> np.ndarray:
    """To unit length (the length itself, not its square)."""
    q = np.asarray(q, float)
    return q / np.linalg.norm(q)


def add_quaternions(a, b) -> np.ndarray:
    """The rotation a followed by b."""
    av, bv = np.asarray(a[:3], float), np.asarray(b[:3], float)
    return np.array([*(a[3] * bv + b[3] * av + np.cross(bv, av)), a[3] * b[3] - av @ bv])


def quaternion_matrix(q) -> np.ndarray:
    x, y, z, w = normalise_quaternion(q)
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])


def matrix_quaternion(r) -> np.ndarray:
    """Of the four ways to divide, the one with the largest divisor."""
    r = np.asarray(r, float)
    k = np.array([[r[0, 0] - r[1, 1] - r[2, 2], 0, 0, 0], [r[1, 0] + r[0, 1], r[1, 1] - r[0, 0] - r[2, 2], 0, 0], [r[2, 0] + r[0, 2], r[2, 1] + r[1, 2], r[2, 2] - r[0, 0] - r[1, 1], 0], [r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1], np.trace(r)]]) / 3
    q = np.linalg.eigh(k)[1][:, -1]
    return q if q[3] >= 0 else -q


def eigen(cov) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and their vectors as rows."""
    values, vectors = np.linalg.eigh(np.asarray(cov, float))
    order = np.argsort(-values)
    return values[order], vectors[:, order].T


def principal_axes(cov) -> np.ndarray:
    """Rows: each axis, of length root of the eigenvalue."""
    values, vectors = eigen(cov)
    return np.sqrt(np.abs(values))[:, None] * vectors


def align_axes(axes_a, axes_b) -> np.ndarray:
    """The rotation that turns the axes of a into those of b, both made right-handed and taken with least turning."""

    def frame(axes):
        u = np.array([a / np.linalg.norm(a) for a in axes])
        for k in range(3):  # each axis towards the coordinate it lies along
            if u[k][np.argmax(np.abs(u[k]))] < 0:
                u[k] = -u[k]
        if np.linalg.det(u) < 0:
            u[2] = -u[2]
        return u.T

    a, b = frame(np.asarray(axes_a, float)), frame(np.asarray(axes_b, float))
    return b @ a.T


def procrustes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(translation, centroid of a, rotation, scale) that bring points a onto b with least squares."""
    ca, cb = a.mean(0), b.mean(0)
    return procrustes_moments(len(a), ca, cb, (a - ca).T @ (b - cb), float(((a - ca) ** 2).sum()))


def procrustes_moments(n: int, ca, cb, cross, spread: float):
    """The same from moments: centroids, cross moments about them, and the spread of a."""
    u, s, vt = np.linalg.svd(cross)
    d = np.sign(np.linalg.det(vt.T @ u.T))
    r = vt.T @ np.diag([1, 1, d]) @ u.T
    scale = float((s * [1, 1, d]).sum() / spread) if spread else 1.0
    return np.asarray(cb) - np.asarray(ca), np.asarray(ca), r, scale


def perpendicular(v) -> tuple[np.ndarray, np.ndarray]:
    """Two unit vectors perpendicular to v and to each other."""
    v = np.asarray(v, float)
    other = np.eye(3)[int(np.argmin(np.abs(v)))]
    a = np.cross(v, other)
    a /= np.linalg.norm(a)
    b = np.cross(v, a)
    return a, b / np.linalg.norm(b)


def vector_ops(a, b) -> dict[str, object]:
    """Sum, cross and dot product, lengths and distance."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    return {"add": a + b, "cross": np.cross(a, b), "dot": float(a @ b), "length": float(np.linalg.norm(a)), "distance": float(np.linalg.norm(a - b)), "normal": a / np.linalg.norm(a)}


def align_z(s, r) -> np.ndarray:
    """The rotation about z that turns s towards r in the x-y plane."""
    a = np.arctan2(r[1], r[0]) - np.arctan2(s[1], s[0])
    return rotation(0, 0, float(a))


def fold_matrices(first: np.ndarray, transform: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Voxel of volume 1 to voxel of volume 2: to world, through the transform, to voxel, as one matrix."""
    return np.linalg.inv(second) @ np.asarray(transform) @ np.asarray(first)


#: Twelve numbers: translations, rotations, scales, shears; which are free in each kind of fit.
FREE = {
    "lsq3": [1] * 3 + [0] * 9,
    "lsq6": [1] * 6 + [0] * 6,
    "lsq7": [1] * 7 + [0] * 5,
    "lsq9": [1] * 9 + [0] * 3,
    "lsq10": [1] * 10 + [0] * 2,
    "lsq12": [1] * 12,
}
FREE["pat"], FREE["procrustes"], FREE["lsq"] = FREE["lsq7"], FREE["lsq7"], FREE["lsq12"]
# Optimiser weights of translations, rotations, scales, shears.
WEIGHTS = np.repeat([1.0, np.pi / 180, 0.02, 0.02], 3)


def pack(p: Parameters, free, weights=WEIGHTS) -> np.ndarray:
    """The free parameters in units of their weights."""
    free = np.asarray(free, bool)
    return (p.vector() / weights)[free]


def unpack(p: Parameters, packed, kind: str, weights=WEIGHTS) -> Parameters:
    """p with free parameters put back; with seven, all scales follow the first."""
    v, free = p.vector(), np.asarray(FREE[kind], bool)
    v[free] = np.asarray(packed) * weights[free]
    if free.sum() == 7:
        v[7:9] = v[6]
    return p.with_vector(v)
