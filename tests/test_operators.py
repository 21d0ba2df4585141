"""Rules and edge cases of operators that SQL does not reach, on small fixtures."""

import bz2
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.functions import angles, ctf, strings
from fathom.operators import aggregates as A
from fathom.operators import expand as X
from fathom.operators import images as I
from fathom.operators import joins as J
from fathom.operators import sequences as W
from fathom.operators import table as T
from fathom.plans import em, graph
from fathom.plans.scheme import Scheme
from fathom.sources import mrc, star, text
from fathom.streaming import runner


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_ctf_value(spark):
    v = ctf.ctf(*(F.lit(float(x)) for x in (10, 10, 10000, 12000, 90, 300, 2.7, 0.1)))
    assert one(spark, v)[0] == pytest.approx(0.59154, abs=1e-5)


def test_euler_matrix_is_a_rotation(spark):
    m = angles.euler_matrix(*(F.lit(x) for x in (33.0, 71.0, -12.0)))
    got = np.array(one(spark, *[x for r in m for x in r])).reshape(3, 3)
    assert np.allclose(got @ got.T, np.eye(3)) and np.linalg.det(got) == pytest.approx(1)


def test_other_angles_are_the_same_orientation(spark):
    a = tuple(F.lit(x) for x in (10.0, 50.0, 20.0))
    assert one(spark, angles.angular_distance(a, angles.flipped(*a)))[0] == pytest.approx(0, abs=1e-4)


def test_strings(spark):
    s = F.lit("a/b.c/d.e.f")
    got = one(spark, strings.base_name(F.lit("test/test2/test3.mrc")), strings.base_name(F.lit("test.mrc.mdoc")), strings.before_last(s, "."), strings.after_first(s, "."), strings.before_last(F.lit("abc"), "."), strings.nth_word(F.lit("x,y,z"), -1), strings.nth_word(F.lit("x,y"), 5), strings.number_prefix(F.lit("12abc")), strings.image_number(F.lit("000012@s.mrcs")))
    assert tuple(got) == ("test3", "test", "a/b.c/d.e", "c/d.e.f", "abc", "z", "undefined", 12.0, 12)


def test_near_duplicates_last_survives(spark):
    df = spark.createDataFrame([("m", 0.0, 0), ("m", 1.0, 1), ("m", 2.0, 2), ("n", 0.0, 3)], "g string, x double, rid long")
    assert sorted(r.rid for r in W.remove_near(df, ["g"], ["x"], 1.0, "rid").collect()) == [2, 3]
    assert sorted(r.rid for r in W.too_close(df, ["g"], ["x"], 1.0, "rid").collect()) == [3]


def test_distance_pairs_against_all_pairs(spark):
    rng = np.random.default_rng(0)
    p = rng.uniform(-3, 3, (60, 3)).round(1)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)], "rid long, x double, y double, z double")
    got = {(r.a_rid, r.b_rid) for r in J.band_pairs(df, df, [(c, c) for c in "xyz"], 1.0).collect()}
    assert got == {(i, j) for i in range(60) for j in range(60) if ((p[i] - p[j]) ** 2).sum() <= 1.0}


def test_regroup_resets_and_halves_balance(spark):
    g = spark.createDataFrame([("o", i, 4.0) for i in range(6)], "o string, k int, n double")
    assert [r.gid for r in W.regroup(g, "o", ["k"], "n", 10.0, "gid").orderBy("k").collect()] == [0, 0, 1, 1, 1, 2]
    h = W.balanced_halves(spark.createDataFrame([(i, i + 1) for i in range(20)], "k int, n long"), "k", "n", 3).groupBy("half").agg(F.sum("n").alias("n")).collect()
    assert abs(h[0].n - h[1].n) <= 20


def test_significant_samples_cap_and_ties(spark):
    df = spark.createDataFrame([(1, i, w) for i, w in enumerate([0.0, 0.1, 0.1, 0.4, 0.4])], "u int, i int, w double")
    got = {r.i for r in W.significant_samples(df, "u", "w", 0.75, order="i").where("significant").collect()}
    assert got == {3, 4}
    capped = {r.i for r in W.significant_samples(df, "u", "w", 1.0, most=1, order="i").where("significant").collect()}
    assert capped == {3, 4}  # ties at the cut are kept


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(x),) for x in (-10, 0, 0.5, 1, 5, 9.9, 10, 20)], "x double")
    got = {r.bin: r["count"] for r in A.histogram(df, "x", bins=10, low=0, high=10).collect()}
    assert got == {0: 1, 1: 2, 2: 1, 6: 1, 10: 1, 11: 2}
    assert A.histogram(df.limit(0), "x").count() == 0
    assert A.histogram(spark.createDataFrame([(3.0,)] * 4, "x double"), "x").count() == 1


def test_empty_column_stats(spark):
    assert tuple(A.column_stats(spark.createDataFrame([], "x double"), "x").first()) == (-99e99, 99e99, 0.0)


def test_fits(spark):
    df = spark.createDataFrame([(float(x), float(y), 2.0 * x - 3.0 * y + 1, float(1 + x % 2)) for x in range(5) for y in range(4)], "x double, y double, z double, w double")
    assert A.plane_fit(df, "x", "y", "z", F.col("w")) == pytest.approx((2, -3, 1))
    values, vectors = A.principal(spark.createDataFrame([([float(i), 2.0 * i, 0.0],) for i in range(10)], "v array<double>"), "v", 1)
    assert values[0] == pytest.approx(5 * 8.25) and abs(vectors[1, 0] / vectors[0, 0]) == pytest.approx(2)


def test_operate_types(spark):
    df = spark.createDataFrame([(3, "a", True)], "i int, s string, b boolean")
    assert T.operate(df, ["i"], 1.5, 0.4).first().i == 4
    with pytest.raises(TypeError):
        T.operate(df, ["s"], 2.0)
    assert T.add_column(df, "t", "string", copy_from="s").first().t == "a"


def test_splits(spark):
    df = spark.range(10).withColumnRenamed("id", "rid")
    assert [r.split for r in T.split_rows(df, "rid", parts=3).orderBy("rid").collect()] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 2]


def test_peaks_and_spheres(spark):
    df = spark.createDataFrame([("m", 0.0, 0.0, 3.0), ("m", 1.0, 0.0, 2.0), ("m", 2.5, 0.0, 1.0)], "g string, x double, y double, s double")
    assert sorted(r.x for r in W.prune_peaks(df, ["g"], "x", "y", "s", 1.5).collect()) == [0.0, 2.5]
    p = X.sphere_points(spark.createDataFrame([(1, 0.0, 0.0, 0.0, 2.0)], "k int, x double, y double, z double, r double"), "k", "x", "y", "z", "r", 50).toPandas()
    assert np.allclose(np.sqrt(p.px**2 + p.py**2 + p.pz**2), 2)


def test_star_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a b", 1.5, 3, [1.0, 2.0], True), ("", -0.00012, -7, [], False)], "name string, x double, n long, v array<double>, ok boolean")
    path = str(tmp_path / "t.star")
    star.write_star({"particles": df, "optics": df.select("n")}, path)
    types = {"x": "double", "n": "long", "v": "array<double>", "ok": "boolean"}
    back = star.read_star(spark, path, "particles", types).orderBy("rid").drop("file_path", "rid").collect()
    assert [tuple(r) for r in back] == [("a b", 1.5, 3, [1.0, 2.0], True), ("", -0.00012, -7, [], False)]
    assert set(star.read_all(spark, path)) == {"particles", "optics"}


def test_star_rules():
    b = star.blocks("data_general\n_a 1 # note\n_b 'x y'\n\ndata_t\nloop_\n_p #1\n_q #2\n1 2\n3 4\n\n5 6\n")
    assert b[0][3] == [["1", "x y"]] and b[1][3] == [["1", "2"], ["3", "4"]]
    with pytest.raises(ValueError):
        star.blocks("data_t\nloop_\n_p\n1 2\n")
    with pytest.raises(ValueError):
        star.blocks("data_t\r\n")


def test_mrc_round_trip(spark, tmp_path):
    a = np.arange(24, dtype="f4").reshape(2, 3, 4)
    (tmp_path / "s.mrcs").write_bytes(mrc.encode(a))
    (tmp_path / "s.mrc.bz2").write_bytes(bz2.compress(mrc.encode(a[:1])))
    got = mrc.read_images(spark, [str(tmp_path / "s.mrcs"), str(tmp_path / "s.mrc.bz2")]).toPandas()
    assert len(got) == 3 and np.allclose(np.array(got[got.path.str.endswith("mrcs")].sort_values("section").pixels.tolist()).reshape(a.shape), a)


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.pdb").write_text("ATOM      1  CA  ALA A   7      11.104   6.134  -6.504  1.00  0.50\nTER\n")
    (tmp_path / "a.box").write_text("10 20 4 6\nx\n")
    (tmp_path / "a.mdoc").write_text("T = x\n[ZValue = 0]\nTiltAngle = 3\nDateTime = 02-Jan-20  10:00:00\n\n[ZValue = 1]\nTiltAngle = -3\nDateTime = 01-Jan-20  10:00:00\n")
    r = text.read_atoms(spark, str(tmp_path / "a.pdb")).first()
    assert (r["name"], r.number, r.x, r.b_factor) == ("CA", 7, 11.104, 0.5)
    assert tuple(text.read_boxes(spark, str(tmp_path / "a.box")).first())[1:] == (12.0, 23.0)
    m = {r.z: (r.order, r["keys"]["TiltAngle"]) for r in text.read_tilt_notes(spark, str(tmp_path / "a.mdoc")).collect()}
    assert m == {0: (1, "3"), 1: (0, "-3")}


def test_image_kernels(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(2, 16, 16))
    assert np.allclose(I.shift(a, 3, -2), np.roll(a, (3, -2), (1, 2)))
    assert np.allclose(I.low_pass(a, 0.2) + I.high_pass(a, 0.2), a)
    assert np.allclose(I.fourier_shells(a[0], a[0]), 1)
    assert np.allclose(I.resized(I.resized(I.low_pass(a, 0.2, 0.05), 32, 32), 16, 16), I.low_pass(a, 0.2, 0.05))
    y, x = np.mgrid[:16, :16]
    assert np.abs(I.without_ramp(np.array([2.0 * x - y + 3]), 4)).max() < 1e-9
    v = np.zeros((16, 16, 16))
    v[6:10, 7:9, 5:11] = 1
    assert np.corrcoef(I.project(v, np.eye(3)).ravel(), v.sum(0).ravel())[0, 1] > 0.99
    df = spark.createDataFrame([(i, 16, 16, z.ravel().tolist()) for i, z in enumerate(a)], "i int, ny int, nx int, pixels array<float>")
    got = I.per_image(df, lambda z: I.resized(z, 8, 8)).collect()
    assert all(r.ny == 8 and len(r.pixels) == 64 for r in got)


def test_em_separates_and_likelihood_does_not_fall(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate((rng.normal(-3, 0.5, (60, 4)), rng.normal(3, 0.5, (60, 4))))
    refs, history = em.classify(spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>"), "v", 2, 12, seed=1)
    assert all(b >= a - 1e-6 for a, b in zip(history, history[1:]))
    p, _ = em.weights(x, refs, np.array([0.5, 0.5]), 1.0)
    assert np.allclose(p.sum(1), 1)


def test_scheme_fork_and_last_edge():
    s = Scheme({"n": 0.0, "limit": 3.0, "more": True, "step": 1.0}, {"add": ("float=plus", "n", "n", "step"), "test": ("bool=lt", "more", "n", "limit")}, edges=[("add", "nowhere", None, None), ("add", "test", None, None), ("test", "EXIT", "more", "add")])
    assert s.run("add").count("add") == 3 and s.variables["n"] == 3.0
    s.reset()
    assert s.variables["n"] == 0.0


def test_downstream(spark):
    out = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "process string, file string")
    inp = spark.createDataFrame([("b", "1"), ("c", "2"), ("d", "9")], "process string, file string")
    p, f = graph.downstream(inp, out, spark.createDataFrame([("a",)], "process string"))
    assert {r.process for r in p.collect()} == {"a", "b", "c"} and {r.file for r in f.collect()} == {"1", "2", "3"}
    assert {r.process for r in graph.has_dependants(inp, out).collect()} == {"a", "b"}


def test_streamed_result_is_the_batch_result(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "value")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    q = runner.on_the_fly(spark, str(tmp_path / "in"), e.schema, lambda d: T.range_select(d, "value", 0, 50), str(tmp_path / "out"), str(tmp_path / "check"), most_files=1)
    q.awaitTermination()
    assert spark.read.schema(e.schema).parquet(str(tmp_path / "out")).count() == T.range_select(e, "value", 0, 50).count()
    seen = []
    runner.while_growing(spark, str(tmp_path / "in"), e.schema, lambda d, n: seen.append(n), str(tmp_path / "check2")).awaitTermination()
    assert seen[-1] == e.count() and seen == sorted(seen)


def test_particles_at_nowhere(spark):
    d = spark.createDataFrame([(1, "g")], "k int, g string")
    assert J.lookup(d, spark.createDataFrame([], "g string, a int"), "g").count() == 0
    assert math.isclose(one(spark, angles.wrapped(F.lit(190.0)))[0], -170.0)


def test_nearest_within_is_brute_force(spark):
    r = np.random.default_rng(5)
    a = [*np.round(r.uniform(-40, 40, 300), 1), *r.uniform(0, 1e-3, 50), 1e6, np.nan, np.inf, 0.01, float(np.nextafter(0.01, 1)), float(np.nextafter(0.01, 0)), -0.0, None]
    b = [*np.round(r.uniform(-60, 60, 200), 1), 0.0, -1000.01, 1000.02, 1e6 + 3, np.nan, np.inf, None]
    rows = [(int(k), None if v is None else float(v)) for k, v in zip(r.permutation(len(a)), a, strict=True)]
    x, y = (spark.createDataFrame(q, "rid long, v double") for q in (rows, [(k, None if v is None else float(v)) for k, v in enumerate(b)]))
    for reach in (0.0, 0.1, 3.0, 1001.0):
        want = {(k, i, d) for k, v in enumerate(b) if v is not None for d, i in [min(((abs(u - v), i) for i, u in rows if u is not None and abs(u - v) <= reach), default=(None, None))] if d is not None}
        got = J.nearest_within(x, y, ("v", "v"), reach)
        assert {tuple(g) for g in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan  # no grid of pairs
