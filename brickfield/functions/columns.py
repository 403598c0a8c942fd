"""3x3 and 3x4 algebra as column expressions: one transform in each row of a table, however many rows there are.

A matrix is a list of rows of columns. Matrices act on column vectors, angles are radians. Results of one stage become named
columns before the next one uses them, so expressions stay short enough to compile.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Matrix = list[list[Column]]
AXES3 = ("x", "y", "z")


def entries(prefix: str = "m", rows: int = 3, cols: int = 4) -> Matrix:
    return [[F.col(f"{prefix}{r}{c}") for c in range(cols)] for r in range(rows)]


def named(m: Matrix, prefix: str = "m") -> dict[str, Column]:
    return {f"{prefix}{r}{c}": x for r, row in enumerate(m) for c, x in enumerate(row)}


def dot(a, b) -> Column:
    return reduce(add, (x * y for x, y in zip(a, b, strict=True)))


def length(a) -> Column:
    return F.sqrt(dot(a, a))


def cross(a, b) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def distance(a, b) -> Column:
    return length([x - y for x, y in zip(a, b, strict=True)])


def transpose(m: Matrix) -> Matrix:
    return [list(c) for c in zip(*m, strict=True)]


def multiply(a: Matrix, b: Matrix) -> Matrix:
    return [[dot(row, col) for col in transpose(b)] for row in a]


def trace(m: Matrix) -> Column:
    return m[0][0] + m[1][1] + m[2][2]


def determinant(m: Matrix) -> Column:
    return dot(m[0][:3], cross(m[1][:3], m[2][:3]))


def inverse(m: Matrix) -> Matrix:
    """Of a 3x3 matrix: the cross products of its rows, as columns, over the determinant."""
    a, b, c = (r[:3] for r in m)
    d = determinant(m)
    return transpose([[x / d for x in cross(*pair)] for pair in ((b, c), (c, a), (a, b))])


def affine_inverse(m: Matrix) -> Matrix:
    back = inverse(m)
    return [[*r, -dot(r, [q[3] for q in m])] for r in back]


def moved(m: Matrix, p) -> list[Column]:
    return [dot(r[:3], p) + r[3] for r in m]


def homogeneous_point(m: Matrix, p, w: Column) -> list[Column]:
    """A point with its fourth coordinate through a 4x4 matrix, divided by the last one where it is neither 0 nor 1."""
    out = [dot(r, [*p, w]) for r in m]
    return [F.when((out[3] != 0) & (out[3] != 1), c / out[3]).otherwise(c) for c in out[:3]]


def rotation(rx: Column, ry: Column, rz: Column) -> Matrix:
    """Rz Ry Rx."""
    (cx, cy, cz), (sx, sy, sz) = ([f(a) for a in (rx, ry, rz)] for f in (F.cos, F.sin))
    return [[cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx], [sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx], [-sy, cy * sx, cy * cx]]


def angles(r: Matrix) -> list[Column]:
    """The angles of Rz Ry Rx; null where one is beyond a right angle."""
    steep = F.abs(r[2][0]) > 1 - 1e-12
    rx = F.when(steep, F.atan2(-r[1][2], r[1][1])).otherwise(F.atan2(r[2][1], r[2][2]))
    ry = F.asin(F.least(F.greatest(-r[2][0], F.lit(-1.0)), F.lit(1.0)))
    rz = F.when(steep, 0.0).otherwise(F.atan2(r[1][0], r[0][0]))
    most = math.pi / 2 + 1e-9
    return [F.when((F.abs(rx) <= most) & (F.abs(rz) <= most), a) for a in (rx, ry, rz)]


def scaled_shears(s, sh) -> Matrix:
    """S SH: scales times a lower triangle of shears at (2,1), (3,1), (3,2)."""
    zero = F.lit(0.0)
    return [[s[0], zero, zero], [s[1] * sh[0], s[1], zero], [s[2] * sh[1], s[2] * sh[2], s[2]]]


def compose(df: DataFrame, turn: Matrix | None = None, prefix: str = "m") -> DataFrame:
    """Adds the matrix T C S SH R -C of the columns tx.., cx.., sx.., h1.., rx.. (or of a given rotation)."""
    col = lambda names: [F.col(n) for n in names]
    r = turn or rotation(*col(("rx", "ry", "rz")))
    s, sh = col(("sx", "sy", "sz")), col(("h1", "h2", "h3"))
    q = entries("_r", 3, 3)
    a = [[s[0] * x for x in q[0]], [s[1] * (sh[0] * x + y) for x, y in zip(q[0], q[1], strict=True)], [s[2] * (sh[1] * x + sh[2] * y + z) for x, y, z in zip(*q, strict=True)]]
    df = df.withColumns(named(r, "_r")).withColumns(named(a, prefix))
    c, t = col(("cx", "cy", "cz")), col(("tx", "ty", "tz"))
    linear = entries(prefix, 3, 3)
    return df.withColumns({f"{prefix}{k}3": t[k] + c[k] - dot(linear[k], c) for k in range(3)}).drop(*named(q, "_r"))


def decompose(df: DataFrame, prefix: str = "m") -> DataFrame:
    """Adds otx.., orx.., osx.., oh1.. of T C S SH R -C for the centre cx, cy, cz: rows of the linear part are made orthogonal in turn.

    A mirrored matrix gets a negative z scale. The rotation is null beyond a right angle.
    """
    m = entries(prefix)
    unit = lambda n: [F.col(f"_u{n}{c}") for c in range(3)]
    rest = lambda n: [F.col(f"_v{n}{c}") for c in range(3)]
    df = df.withColumn("osx", length(m[0][:3])).withColumns({f"_u0{c}": m[0][c] / F.col("osx") for c in range(3)})
    df = df.withColumn("_d0", dot(m[1][:3], unit(0))).withColumns({f"_v1{c}": m[1][c] - F.col("_d0") * F.col(f"_u0{c}") for c in range(3)})
    df = df.withColumn("osy", length(rest(1))).withColumns({f"_u1{c}": F.col(f"_v1{c}") / F.col("osy") for c in range(3)})
    df = df.withColumns({"_d1": dot(m[2][:3], unit(0)), "_d2": dot(m[2][:3], unit(1))})
    df = df.withColumns({f"_u2{c}": x for c, x in enumerate(cross(unit(0), unit(1)))}).withColumn("osz", dot(m[2][:3], unit(2)))
    turn = dict(zip(("orx", "ory", "orz"), angles([unit(0), unit(1), unit(2)]), strict=True))
    centre = [F.col(c) for c in ("cx", "cy", "cz")]
    shift = {f"ot{a}": m[k][3] - centre[k] + dot(m[k][:3], centre) for k, a in enumerate(AXES3)}
    df = df.withColumns({**turn, **shift, "oh1": F.col("_d0") / F.col("osy"), "oh2": F.col("_d1") / F.col("osz"), "oh3": F.col("_d2") / F.col("osz")})
    return df.drop("_d0", "_d1", "_d2", *(f"_{n}{c}" for n in ("u0", "u1", "u2", "v1") for c in range(3)))


def normalised(q) -> list[Column]:
    """To length one (by the length itself, not its square)."""
    n = length(q)
    return [x / n for x in q]


def axis_quaternion(axis, angle: Column) -> list[Column]:
    """(x, y, z, w) of a turn about an axis of any length."""
    n = length(axis)
    return [*(x / n * F.sin(angle / 2) for x in axis), F.cos(angle / 2)]


def quaternion_angle(q) -> Column:
    return 2 * F.atan2(length(q[:3]), q[3])


def quaternion_sum(a, b) -> list[Column]:
    """The turn a followed by b."""
    c = cross(b[:3], a[:3])
    return [*(a[3] * b[k] + b[3] * a[k] + c[k] for k in range(3)), a[3] * b[3] - dot(a[:3], b[:3])]


def quaternion_matrix(q) -> Matrix:
    """The rotation of a quaternion of length one."""
    x, y, z, w = q
    return [[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]]


def matrix_quaternion(r: Matrix) -> list[Column]:
    """The quaternion of a rotation, w not negative: sizes from the diagonal, signs from the differences beside it."""
    size = lambda v: F.sqrt(F.greatest(v, F.lit(0.0))) / 2
    sign = lambda a, b: F.when(a < b, -1.0).otherwise(1.0)
    d = [r[k][k] for k in range(3)]
    x, y, z = size(1 + d[0] - d[1] - d[2]), size(1 - d[0] + d[1] - d[2]), size(1 - d[0] - d[1] + d[2])
    return [x * sign(r[2][1], r[1][2]), y * sign(r[0][2], r[2][0]), z * sign(r[1][0], r[0][1]), size(1 + d[0] + d[1] + d[2])]


def perpendicular(v) -> tuple[list[Column], list[Column]]:
    """Two unit vectors perpendicular to v and to each other; the first lies across v and the axis v is least along."""
    least = F.least(*(F.abs(x) for x in v))
    first = F.abs(v[0]) == least
    second = ~first & (F.abs(v[1]) == least)
    other = [F.when(first, 1.0).otherwise(0.0), F.when(second, 1.0).otherwise(0.0), F.when(first | second, 0.0).otherwise(1.0)]
    a = normalised(cross(v, other))
    return a, normalised(cross(v, a))


def parameters_in_bounds(r, s, sh) -> Column:
    """Rotations within a right angle, scales 0 to 3, shears within 2; closed limits."""
    tests = [x.between(-math.pi / 2, math.pi / 2) for x in r] + [x.between(0.0, 3.0) for x in s] + [x.between(-2.0, 2.0) for x in sh]
    return reduce(lambda a, b: a & b, tests)


def quaternions_in_bounds(q, s, sh) -> Column:
    """Quaternion parts within 2, scales and shears as above."""
    tests = [x.between(-2.0, 2.0) for x in q] + [x.between(0.0, 3.0) for x in s] + [x.between(-2.0, 2.0) for x in sh]
    return reduce(lambda a, b: a & b, tests)


def checked_scale(sx: Column, sy: Column, sz: Column) -> Column:
    """The z scale; one over 1.15 times the mean of the others becomes that mean."""
    mean = (sx + sy) / 2
    return F.when(sz > 1.15 * mean, mean).otherwise(sz)


def packed(values, weights, free) -> Column:
    """The free parameters in units of their weights, as an array."""
    kept = [v / float(w) for v, w, f in zip(values, weights, free, strict=True) if f and w]
    return F.array(*kept) if kept else F.array().cast("array<double>")


def unpacked(values, weights, free, vector: Column) -> list[Column]:
    """All parameters with the free ones taken from a packed array; with seven free, all scales follow the first."""
    out, at = list(values), 0
    for k, (w, f) in enumerate(zip(weights, free, strict=True)):
        if f and w:
            out[k] = F.element_at(vector, at + 1) * float(w)
            at += 1
    if sum(map(bool, free)) == 7:
        out[7] = out[8] = out[6]
    return out


def symmetric_eigenvalues(xx: Column, xy: Column, xz: Column, yy: Column, yz: Column, zz: Column) -> list[Column]:
    """Eigenvalues of a symmetric 3x3 matrix, largest first, by the cosines of a third of an angle."""
    mean = (xx + yy + zz) / 3
    spread = F.sqrt(((xx - mean) ** 2 + (yy - mean) ** 2 + (zz - mean) ** 2 + 2 * (xy * xy + xz * xz + yz * yz)) / 6)
    a, b, c = xx - mean, yy - mean, zz - mean
    det = a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz)
    half = F.when(spread > 0, det / (2 * spread * spread * spread)).otherwise(0.0)
    angle = F.acos(F.least(F.greatest(half, F.lit(-1.0)), F.lit(1.0))) / 3
    first, last = mean + 2 * spread * F.cos(angle), mean + 2 * spread * F.cos(angle + 2 * math.pi / 3)
    return [first, 3 * mean - first - last, last]


def folded(m: Matrix, step1, start1, step2, start2) -> Matrix:
    """Voxel of volume 1 to world, through a transform, to voxel of volume 2, as one matrix; grids along the axes."""
    out = []
    for r in range(3):
        row = [m[r][c] * float(step1[c]) / float(step2[r]) for c in range(3)]
        shift = (dot(m[r][:3], [F.lit(float(x)) for x in start1]) + m[r][3] - float(start2[r])) / float(step2[r])
        out.append([*row, shift])
    return out


def moved_bounds(m: Matrix, low, high) -> tuple[list[Column], list[Column]]:
    """Smallest and largest coordinates of a box's eight corners after a transform."""
    corners = [moved(m, [(low, high)[b][k] for k, b in enumerate(bits)]) for bits in ((x, y, z) for x in (0, 1) for y in (0, 1) for z in (0, 1))]
    return [F.least(*(c[k] for c in corners)) for k in range(3)], [F.greatest(*(c[k] for c in corners)) for k in range(3)]
