"""Files, transforms as tables, stencils and nonlinear fits on small inputs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brickfield.functions import columns as cx
from brickfield.functions import transforms as tr
from brickfield.model import AXES, Geometry
from brickfield.operators import lattice, masks, measures, sample, scattered, stencil, xfmops
from brickfield.sources import files, phantoms

G = Geometry((8, 8, 8), (2.0, 2.0, 2.0), (-8.0, -8.0, -8.0))


def test_xfm_text_comes_back(spark, tmp_path):
    rows = [
        ("t", 0, "Linear", True, tr.from_degrees((1, 2, 3), (4, 5, 6))[:3].ravel().tolist(), None, None, None),
        ("t", 1, "Thin_Plate_Spline_Transform", False, None, [[0.0, 1.0, 2.0]], [[1.0, 0.0, 0.0]] * 5, None),
        ("t", 2, "Grid_Transform", False, None, None, None, "grid_0"),
    ]
    text = files.format_xfm(rows, "made for a test")
    assert [r[2:4] for r in files.parse_xfm(text)] == [r[2:4] for r in rows]
    files.write_text(spark, text, str(tmp_path / "x"))
    back = files.read_xfm(spark, str(tmp_path / "x")).orderBy("seq").collect()
    assert np.allclose(back[0]["matrix"], rows[0][4]) and back[1]["displacements"] == rows[1][6] and back[2]["grid_vol"] == "grid_0"
    assert np.allclose(files.linear_matrix(files.read_xfm(spark, str(tmp_path / "x")).where("seq = 0")), np.linalg.inv(tr.from_degrees((1, 2, 3), (4, 5, 6))))
    with pytest.raises(ValueError):
        files.parse_xfm("something else")


def test_tags_come_back(spark, tmp_path):
    rows = [(1.0, 2.0, 3.0, 4.0, 5.0, 6.0, "a"), (-1.5, 0.0, 2e-3, 0.0, 1.0, 2.0, "b")]
    files.write_text(spark, files.format_tags(rows), str(tmp_path / "t"))
    assert sorted(tuple(r) for r in files.read_tags(spark, str(tmp_path / "t")).collect()) == sorted(rows)


def test_volumes_and_deformations_come_back(spark, tmp_path):
    field = phantoms.random_deformation(spark, (3, 3, 3), 1.0, 1)
    files.write_deformation(field, str(tmp_path / "d"))
    assert files.read_deformation(spark, str(tmp_path / "d")).select(field.columns).exceptAll(field).isEmpty()
    with pytest.raises(Exception, match="exists"):
        files.write_deformation(field, str(tmp_path / "d"))


def test_option_files():
    assert files.read_options(["-step 4 # mm\nname = a b", "step 8"]) == {"step": ["8"], "name": ["a", "b"]}
    assert files.feature_pairs([{"objective": "corr"}, {"objective": "diff", "weight": 2}])[1]["weight"] == 2.0


def test_grid_inverse_undoes_forward(spark):
    g = Geometry((6, 6, 6), (4.0,) * 3, (-10.0,) * 3)
    field = sample.node_points(g.size, spark).select(F.lit("f").alias("vol"), *AXES, F.sin(F.col("j") / 3.0).alias("dx"), (F.col("k") * 0.1).alias("dy"), F.lit(0.3).alias("dz"))
    points = spark.createDataFrame([(n, float(n) - 4, 1.0 - n / 4, n / 3 - 2.0) for n in range(10)], "pid long, x double, y double, z double")
    there = xfmops.apply(points, [{"type": "Grid_Transform", "field": field, "geometry": g}])
    back = xfmops.apply(there, [{"type": "Grid_Transform", "field": field, "geometry": g}], inverse=True)
    a, b = (np.array(d.select("x", "y", "z").orderBy("pid").collect()) for d in (points, back))
    assert np.abs(a - b).max() < 0.06


def test_spline_and_its_inverse(spark):
    r = np.random.default_rng(0)
    a = r.uniform(-10, 10, (8, 3))
    b = a + r.normal(0, 0.5, (8, 3))
    c, w = xfmops.spline_of(a, b)
    points = spark.createDataFrame([(n, *map(float, p)) for n, p in enumerate(a)], "pid long, x double, y double, z double")
    step = {"type": "Thin_Plate_Spline_Transform", "points": c, "displacements": w}
    there = xfmops.apply(points, [step])
    assert np.allclose(np.array(there.select("x", "y", "z").orderBy("pid").collect()), b)
    back = xfmops.apply(there, [{**step, "invert_flag": True}])
    assert np.allclose(np.array(back.select("x", "y", "z").orderBy("pid").collect()), a, atol=1e-6)


def test_number_lists_and_bounds():
    assert xfmops.parse_numbers("1-3,5") == [1, 2, 3, 5]
    assert lattice.fix_bounds([(0, 5), (5, 0), (0, 4)], (2, 2, -2)) == [(0, 6), (0, 6), (4, 0)]
    assert lattice.modify_bounds([(0, 10)] * 3, "isoexpand", ["10%"], (1, 1, 1)) == [(-1, 11)] * 3
    assert lattice.guess_subsample((1, -1, 2)) == [2, -2, 2] and lattice.guess_crop(200) == -10 and lattice.guess_crop(100) == 0
    assert np.allclose(lattice.transform_bounds([(0, 1)] * 3, tr.from_degrees((1, 0, 0))), [(1, 2), (0, 1), (0, 1)])


def test_fourier_blur_agrees_with_numpy(spark):
    r = np.random.default_rng(2)
    v = r.normal(size=(5, 4, 3))
    df = spark.createDataFrame(pd.DataFrame([("a", i, j, k, float(v[i, j, k])) for i, j, k in np.ndindex(v.shape)], columns=["vol", *AXES, "value"])).select("vol", *(F.col(a).cast("int").alias(a) for a in AXES), "value")
    got = stencil.fft_blur(df, (1.0, 1.0, 1.0), (3.0, 0, 0)).toPandas()
    out = np.zeros_like(v)
    out[tuple(got[a] for a in AXES)] = got["value"]
    s = 3.0 / 2.35482
    k = np.exp(-np.arange(-7, 8) ** 2 / (2 * s * s)) / (s * np.sqrt(2 * np.pi))
    want = np.apply_along_axis(lambda x: np.convolve(x, k)[7 : 7 + len(x)], 0, v)
    assert np.allclose(out, want, atol=1e-3)


def test_chamfer_of_one_voxel(spark):
    df = sample.node_points((7, 7, 7), spark).select(F.lit("a").alias("vol"), *AXES, F.when((F.col("i") == 3) & (F.col("j") == 3) & (F.col("k") == 3), 1.0).otherwise(0.0).alias("value"))
    got = {tuple(r[a] for a in AXES): r["value"] for r in stencil.chamfer(df, (7, 7, 7), (1.0, 1.0, 1.0)).collect()}
    assert got[3, 3, 3] == 0 and got[3, 3, 5] == 2 and np.isclose(got[2, 2, 2], 3**0.5) and got[0, 0, 0] == 50


def test_class_volumes_and_tubes(spark):
    one = phantoms.ellipsoid(spark, G, width=(8, 8, 8))
    both = files.class_volumes([(one, 7), (one.withColumn("value", 1 - F.col("value")), 9)])
    labels = {r["label"] for r in measures.argmax_label(both).collect()}
    assert labels == {7, 9}
    assert masks.is_tube(F.lit(10.0), F.lit(9.0), F.lit(1.0), F.lit(1.0), 5, 20) is not None


def test_nearest_nodes_and_lines_of_odd_points(spark):
    """Points without numbers find nothing, and the search ends; ties go to the smaller node; few nodes give few rows."""
    points = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, None, 0.0, 0.0), (3, float("nan"), 1.0, 1.0), (4, 1e6, 0.0, 0.0)], "pid long, x double, y double, z double")
    nodes = spark.createDataFrame([(7, 1.0, 0.0, 0.0), (5, -1.0, 0.0, 0.0), (9, None, 0.0, 0.0)], "node long, x double, y double, z double")
    got = {(r.pid, r.rank): (r.node, r.distance) for r in scattered.nearest_nodes(points, nodes, 3).collect()}
    assert got == {(1, 1): (5, 1.0), (1, 2): (7, 1.0), (4, 1): (7, 1e6 - 1), (4, 2): (5, 1e6 + 1)}
    assert {r.pid: r.distance for r in sample.nearest_object(points, nodes).collect()} == {1: 1.0, 2: None, 3: None, 4: 1e6 - 1}
    assert scattered.nearest_nodes(points, nodes.limit(0), 2).count() == 0
    lines = spark.createDataFrame([(0.0, 3.0, 0.0, 10.0, 3.0, 0.0), (5.0, 5.0, 5.0, 5.0, 5.0, 5.0)], "x1 double, y1 double, z1 double, x2 double, y2 double, z2 double")
    far = {r.pid: r.distance for r in sample.nearest_line(points, lines, 2.0).collect()}
    assert far[1] == 3.0 and far[2] is None and far[3] is None and np.isclose(far[4], np.hypot(1e6 - 10, 3))
    assert {r.distance for r in sample.nearest_line(points, lines.limit(0), 2.0).collect()} == {None}


def test_chamfer_takes_every_voxel_that_is_not_zero(spark):
    v = sample.node_points((5, 5, 5), spark).select(F.lit("v").alias("vol"), *AXES, F.when(F.expr("i = 2 and j = 2 and k = 2"), -1.0).otherwise(0.0).alias("value"))
    got = {(r.i, r.j, r.k): r.value for r in stencil.chamfer(v, (5, 5, 5), (1.0, 1.0, 1.0)).collect()}
    assert got[2, 2, 2] == 0 and got[1, 2, 2] == 1 and np.isclose(got[1, 1, 1], 3**0.5) and got[0, 0, 0] == 50


def test_boxes_smooth_histograms_as_the_table_does(spark):
    from brickfield.operators import optimise

    h = np.arange(36.0).reshape(6, 6) ** 1.5
    rows = spark.createDataFrame([(i, j, float(h[i, j])) for i in range(6) for j in range(6)], "b1 int, b2 int, w double")
    for size in (3, 5):
        got = {(r.b1, r.b2): r.blurred for r in measures.blur_joint(rows, "b1", "b2", "w", 6, size).collect()}
        want = optimise._box_mean(optimise._box_mean(h, size).T, size).T
        assert np.allclose([[got[i, j] for j in range(6)] for i in range(6)], want)


def test_target_masks_count_in_both_engines(spark):
    from brickfield.operators import optimise

    one = phantoms.ellipsoid(spark, G, width=(10.0, 12.0, 8.0))
    two = one.withColumn("value", F.col("value") + F.col("i") * 0.01)
    mask = one.withColumn("value", (F.col("i") >= 4).cast("double"))
    for name in ("xcorr", "nmi"):
        masked, whole = [], []
        for local in (True, False):
            for m, out in ((mask, masked), (None, whole)):
                e = optimise.Evaluator(one, G, two, G, name, (2.0,) * 3, target_mask=m, local=local)
                out.append(e([tr.from_degrees((0.3, 0.2, -0.4))])[0])
                e.close()
        assert np.isclose(*masked) and np.isclose(*whole) and not np.isclose(masked[0], whole[0])


def test_columns_agree_with_numpy(spark):
    r = np.random.default_rng(2)
    rows = [(n, *(float(x) for x in r.uniform(-1, 1, 6))) for n in range(40)]
    names = ("xx", "xy", "xz", "yy", "yz", "zz")
    df = spark.createDataFrame(rows, "n int, " + ", ".join(f"{c} double" for c in names))
    e = cx.symmetric_eigenvalues(*(F.col(c) for c in names))
    for row in df.select("n", *(c.alias(f"e{k}") for k, c in enumerate(e))).collect():
        xx, xy, xz, yy, yz, zz = rows[row.n][1:]
        assert np.allclose(sorted(np.linalg.eigvalsh([[xx, xy, xz], [xy, yy, yz], [xz, yz, zz]]), reverse=True), row[1:], atol=1e-7)
    low, high = cx.moved_bounds([[F.lit(float(x)) for x in m] for m in tr.from_degrees((1, 2, 3), (10, 20, 30))[:3]], [F.lit(-1.0)] * 3, [F.lit(2.0)] * 3)
    (row,) = spark.range(1).select(*(c.alias(f"l{k}") for k, c in enumerate(low)), *(c.alias(f"h{k}") for k, c in enumerate(high))).collect()
    want = lattice.transform_bounds([(-1, 2)] * 3, tr.from_degrees((1, 2, 3), (10, 20, 30)))
    assert np.allclose(row, [a for a, _ in want] + [b for _, b in want])


def test_a_small_volume_goes_to_points_whole(spark):
    """Values as by joining voxels, also with missing and null ones; points are neither shuffled nor broadcast to meet their own samples."""
    rng = np.random.default_rng(3)
    rows = [(i, j, k, None if (i, j, k) == (1, 1, 1) else float(rng.normal())) for i in range(6) for j in range(5) for k in range(4) if (i, j, k) != (2, 2, 2) and i != 5]
    v = spark.createDataFrame(rows, "i int, j int, k int, value double")
    at = [(n, *(float(x) for x in p)) for n, p in enumerate(rng.uniform(-1, 6, (400, 3)))]
    odd = [(400, None, 1.0, 1.0), (401, float("nan"), 1.0, 1.0), (402, 1.0, 1.0, 1.0), (403, 5.0, 4.0, 3.0)]
    points = spark.createDataFrame(at + odd, "pid long, x double, y double, z double")
    for degree in (-1, 0, 1):
        small = sample.evaluate(points, v, (6, 5, 4), degree)
        one = sample.evaluate(points.withColumn("g", F.lit(1)), v.withColumn("g", F.lit(1)), (6, 5, 4), degree, "sample", ("g",))
        a, b = ({r.pid: r.sample for r in d.collect()} for d in (small, one))
        assert a.keys() == b.keys() and len(a) == 404
        assert all((a[k] is None) == (b[k] is None) and (a[k] is None or np.isclose(a[k], b[k], atol=1e-12)) for k in a)
        assert sum(x is not None for x in a.values()) > 60
        plan = small._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftOuter" not in plan and "Inner" not in plan


@pytest.mark.parametrize("name", ["evaluate_degrees", "shifted_similarity"])
def test_points_are_not_joined_with_their_own_samples(spark, name):
    from brickfield.plans import registry

    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in plan and "Join Inner" not in plan


def test_nearest_object_of_dense_targets(spark, monkeypatch):
    """Cells narrow where targets are dense, and copies of a target count once: few pairs are compared, and distances are exact."""
    rng = np.random.default_rng(11)
    places = rng.uniform(0, 500, (300, 2))
    far = np.array([[9e3, -4e3]])
    at = np.concatenate([rng.uniform(-50, 550, (400, 2)), far])
    targets = spark.createDataFrame([(float(x), float(y), 0.0) for x, y in places] * 20, "x double, y double, z double")
    points = spark.createDataFrame([(n, float(x), float(y), 0.0) for n, (x, y) in enumerate(at)], "pid long, x double, y double, z double")
    seen, cells = [], scattered._cells
    monkeypatch.setattr(scattered, "_cells", lambda df, width, names, prefix: seen.append((df.count(), width)) or cells(df, width, names, prefix))
    got = {r.pid: r.distance for r in sample.nearest_object(points, targets, 500.0).collect()}
    want = np.sqrt(((at[:, None] - places[None]) ** 2).sum(2)).min(1)
    assert len(got) == 401 and all(np.isclose(got[n], d, rtol=1e-12) for n, d in enumerate(want))
    (n, width), (m, _) = seen[:2]
    assert n == 401 and m == 300 and n * m * min(1, (3 * width / 500) ** 2) < 0.1 * 401 * 300


def test_a_node_s_points_stay_arrays(spark, monkeypatch):
    """Similarities as by a row for each point, also with missing and null voxels, odd places and many slices of nodes."""
    rng = np.random.default_rng(5)
    gone = {(2, 2, 2), *((i, j, k) for i in (3, 4) for j in (0, 1) for k in (0, 1))}
    rows = [(i, j, k, None if (i, j, k) == (1, 1, 1) else float(rng.normal())) for i in range(6) for j in range(5) for k in range(4) if (i, j, k) not in gone]
    v = spark.createDataFrame([*rows, (7, 1, 1, 9.0), (-1, 0, 0, 9.0)], "i int, j int, k int, value double")
    at = [(n, *(float(x) for x in p), n % 3) for n, p in enumerate(rng.uniform(-1, 6, (150, 3)))]
    odd = [(200, None, 1.0, 1.0, 1), (201, float("nan"), 1.0, 1.0, 1), (202, 1.0, float("inf"), 1.0, 1), (203, 2.0, 2.0, 1.0, None), (204, 0.0, 0.0, 0.0, 1), (205, 3.5, 0.5, 0.5, 1), (206, -0.75, 1.0, 1.0, 1)]
    nodes = spark.createDataFrame(at + odd, "pid long, x double, y double, z double, g int")
    monkeypatch.setattr(sample, "NODES", 16)
    got = []
    for most in (sample.PACKED, 0):
        monkeypatch.setattr(sample, "PACKED", most)
        df = sample.shifted_similarity(nodes, v, (6, 5, 4), (1.5, 1.0, 2.0), 5, (-1, 0.5, 1))
        got.append({(r.pid, r.g, r.shift): (r.n, r.similarity) for r in df.select("pid", "g", "shift", "n", "similarity").collect()})
    small, large = got
    assert small.keys() == large.keys() and len(small) > 150 and (203, None, 1.0) in small and not any(200 <= k[0] <= 202 for k in small)
    assert all(small[k][0] == large[k][0] and np.isclose(small[k][1], large[k][1], atol=1e-12) for k in small)
    assert sample.shifted_similarity(nodes, v.where("false"), (6, 5, 4), (1.5, 1.0, 2.0), 5, (0,)).count() == 0


def test_shifted_similarity_makes_no_rows_for_points(spark, tmp_path):
    """One file's nodes are dealt out before points are made of them, and a key's copies count as often as in SQL."""
    from brickfield.plans import registry

    from .oracle import differences

    k = [*range(60), 7, 7, None]
    pd.DataFrame({"p_partkey": pd.array(k, "Int64")}).to_parquet(tmp_path / "part.parquet")
    pd.read_parquet("/root/testdata/sf0.001/embeddings.parquet").to_parquet(tmp_path / "embeddings.parquet")
    query = registry.queries()["shifted_similarity"]
    plan = query(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.index("MapInArrow") < plan.index("Exchange hashpartitioning(pid")
    n, ours, theirs, columns, want = differences(spark, str(tmp_path), query, registry.oracle_sql()["shifted_similarity"])
    assert n == want > 100 and not ours and not theirs and not columns
