"""Known answers: matrices, the phantoms' correlation, parameter recovery."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brickfield.functions import transforms as tr
from brickfield.model import Geometry
from brickfield.operators import measures, optimise, sample
from brickfield.sources import phantoms

G = Geometry((64, 64, 64), (2.0, 2.0, 2.0), (-64.0, -64.0, -64.0))
IDEAL = tr.from_degrees((5, 2, -6), (-4, 7, 10))


@pytest.mark.parametrize(
    ("parts", "rows"),
    [
        ({"translations": (2, 3, 4)}, [[1, 0, 0, 2], [0, 1, 0, 3], [0, 0, 1, 4]]),
        ({"rotations": (0, 0, 90)}, [[0, -1, 0, 0], [1, 0, 0, 0], [0, 0, 1, 0]]),
        ({"scales": (2, 3, 4)}, [[2, 0, 0, 0], [0, 3, 0, 0], [0, 0, 4, 0]]),
        ({"shear": (2, 3, 4)}, [[1, 0, 0, 0], [2, 1, 0, 0], [3, 4, 1, 0]]),
    ],
)
def test_parameters_to_matrix(parts, rows):
    assert np.allclose(tr.from_degrees(**parts)[:3], rows, atol=1e-4)


def test_inverse_of_scale():
    assert np.allclose(np.linalg.inv(tr.from_degrees(scales=(2, 4, 8)))[:3, :3], np.diag([0.5, 0.25, 0.125]))


def test_decompose_comes_back():
    r = np.random.default_rng(0)
    for _ in range(50):
        p = tr.Parameters(r.uniform(-20, 20, 3), r.uniform(-20, 20, 3), r.uniform(-1.2, 1.2, 3), r.uniform(0.5, 2, 3), r.uniform(-0.5, 0.5, 3))
        q = tr.decompose(p.matrix(), p.center)
        assert np.allclose(q.matrix(), p.matrix()) and np.allclose(q.vector(), p.vector())
        assert np.allclose(tr.decompose_quaternion(p.matrix(), p.center).matrix(), p.matrix())
        assert np.allclose(tr.quaternion_matrix(tr.matrix_quaternion(tr.rotation(*p.rotations))), tr.rotation(*p.rotations))


def test_quaternions_compose():
    a, b = tr.axis_quaternion((1, 2, 3), 0.4), tr.axis_quaternion((0, 1, -1), 0.9)
    assert np.allclose(tr.quaternion_matrix(tr.add_quaternions(a, b)), tr.quaternion_matrix(b) @ tr.quaternion_matrix(a))
    axis, angle = tr.quaternion_axis(a)
    assert np.allclose(tr.axis_quaternion(axis, angle), a)


def test_procrustes():
    r = np.random.default_rng(1)
    a = r.normal(size=(8, 3))
    turn = tr.rotation(0.1, -0.3, 0.5)
    shift, centre, got, scale = tr.procrustes(a, 1.5 * a @ turn.T + [1, 2, 3])
    assert np.allclose(got, turn) and np.isclose(scale, 1.5)


@pytest.fixture(scope="module")
def objects(spark):
    one = phantoms.ellipsoid(spark, G).persist()
    two = sample.resample(one, G, G, IDEAL).persist()
    return one, two


def test_phantom_and_correlation(spark, objects):
    one, two = objects
    assert abs(one.agg(F.sum("value")).first()[0] - 9413.64) < 0.05
    r = measures.paired(one, two).agg(measures.raw_correlation(F.col("v1"), F.col("v2")).alias("r")).first()[0]
    assert int(r * 10000) == 7231


def test_lsq6_recovers_the_transform(spark, objects):
    one, two = objects
    p = optimise.linear_fit(one, G, two, G, "lsq6", start=tr.Parameters(center=np.zeros(3)), step=(8.0, 8.0, 8.0), simplex=10.0, tolerance=0.0001)
    assert np.allclose(p.matrix(), IDEAL, atol=0.05 * 5) and np.allclose(p.matrix()[:3, :3], IDEAL[:3, :3], atol=0.05)
    fitted = sample.resample(one, G, G, p.matrix())
    assert measures.paired(fitted, two).agg(measures.raw_correlation(F.col("v1"), F.col("v2"))).first()[0] > 0.99


def test_spark_and_numpy_evaluations_agree(spark, objects):
    one, two = objects
    ms = [np.eye(4), IDEAL]
    got = [optimise.Evaluator(one, G, two, G, step=(8.0,) * 3, local=x)(ms) for x in (True, False)]
    assert np.allclose(*got) and got[0][1] < got[0][0]


def test_lbfgs_and_brackets():
    f = lambda p: float((p[0] - 1) ** 2 + 3 * (p[1] + 2) ** 2)
    assert np.allclose(optimise.lbfgs([5.0, 5.0], lambda ps: [f(p) for p in ps]), [1, -2], atol=1e-2)
    a, b, c = optimise.bracket(lambda x: (x - 3) ** 2, 0.0, 0.5)
    assert abs(optimise.golden(lambda x: (x - 3) ** 2, min(a, c), max(a, c)) - 3) < 1e-4
