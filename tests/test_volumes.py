"""Volumes, picks, statistics and tomography on small fixtures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.functions import stats
from fathom.operators import picks, volumes
from fathom.plans import tomography as tomo


def test_symmetry_groups():
    sizes = {"C1": 1, "C7": 7, "D3": 6, "T": 12, "O": 24, "I": 60}
    for name, n in sizes.items():
        g = volumes.symmetry_group(name)
        assert len(g) == n and all(np.linalg.det(m) == pytest.approx(1) for m in g)


def test_grids(spark):
    o = volumes.orientations(spark, 50, 90).toPandas()
    assert len(o) == 200 and o.tilt.between(0, 180).all()
    d = np.stack((np.sin(np.radians(o.tilt)) * np.cos(np.radians(o.rot)), np.sin(np.radians(o.tilt)) * np.sin(np.radians(o.rot)), np.cos(np.radians(o.tilt))))
    assert np.abs(d.mean(1)).max() < 0.05
    assert volumes.translations(spark, 2.0, 1.0).count() == 13


def test_back_projection_inserts_the_central_slice(spark):
    n = 8
    rng = np.random.default_rng(0)
    a = rng.normal(size=(2, n * n))
    rows = [(np.eye(3).ravel().tolist(), a[0].tolist(), a[1].tolist(), [2.0] * (n * n))] * 3
    df = spark.createDataFrame(rows, "m array<double>, re array<double>, im array<double>, w array<double>")
    got = volumes.reconstructed(volumes.back_project(df, "m", "re", "im", "w", n)).toPandas().sort_values(["y", "x"])
    assert len(got) == n * n and (got.z == n // 2).all() and np.allclose(got.re, a[0]) and np.allclose(got.im, a[1])


def test_guinier_and_ssnr(spark):
    df = spark.createDataFrame([(r, 3 - 50 / 4 / r**2) for r in (4.0, 5.0, 6.0, 8.0, 10.0, 40.0)], "r double, a double")
    assert volumes.guinier_fit(df, "r", "a", 4, 10).first().b_factor == pytest.approx(-50)
    assert spark.range(1).select(volumes.ssnr(F.lit(0.5)), volumes.ssnr(F.lit(2.0))).first()[0] == pytest.approx(1)


def test_local_maxima(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(12, 12))
    df = spark.createDataFrame([("i", x, y, float(a[y, x])) for y in range(12) for x in range(12)], "i string, x int, y int, v double")
    want = {(x, y) for y in range(1, 11) for x in range(1, 11) if a[y, x] >= 0.5 and a[y, x] > max(a[y - 1, x], a[y + 1, x], a[y, x - 1], a[y, x + 1])}
    assert {(r.x, r.y) for r in picks.local_maxima(df, "i", "x", "y", "v", 0.5).collect()} == want


def test_picks(spark):
    a = spark.createDataFrame([("m", 0.0, 0.0), ("m", 5.0, 5.0)], "m string, x double, y double")
    b = spark.createDataFrame([("m", 0.05, 0.05), ("m", 0.05, 3.0), ("n", 0.0, 0.0)], "m string, x double, y double")
    assert picks.combine_picks(a, b, "m", "x", "y").count() == 4
    c = picks.curve_points(spark.createDataFrame([("t", k, float(k), 0.0) for k in range(5)], "t string, k int, x double, y double"), ["t"], "k", "x", "y", 1.0).toPandas()
    assert len(c) == 5 and np.allclose(c.x, range(5), atol=1e-2)
    s = picks.smooth_track_angles(spark.createDataFrame([("t", float(k), 179.0 if k % 2 else -179.0) for k in range(20)], "t string, s double, psi double"), ["t"], "s", "psi", 3.0).toPandas()
    assert (s.psi_smooth.abs() > 178.5).all()
    assert picks.tube_polarity(spark.createDataFrame([("t", True), ("t", True), ("t", False), ("u", False)], "t string, f boolean"), ["t"], "f").where("turn").count() == 1
    u = spark.createDataFrame([(k, float(k * 10), 3.0) for k in range(5)], "rid long, x double, y double")
    t = u.select("rid", (F.col("x") * 0.5 + 1).alias("x"), (F.col("y") + 2).alias("y"))
    got = picks.tilt_pairs(u, t, [[0.5, 0], [0, 1]], (1.2, 2.0), 1.0).collect()
    assert len(got) == 5 and all(r.a_rid == r.b_rid for r in got)
    assert picks.name_contains(spark.createDataFrame([("j/mic10",), ("j/mic1",)], "f string"), spark.createDataFrame([("mic1",)], "n string"), "f", "n").count() == 1


def test_statistics(spark):
    df = spark.createDataFrame([(0.5,), (2.0,), (None,)], "x double")
    r = df.select(stats.gaussian(F.col("x"), 1.0), stats.normal_cdf(F.col("x")), stats.bessel_j(0)(F.col("x")), stats.bessel_i(1)(F.col("x")), stats.student(F.col("x"), 1.0), stats.log_gamma(F.col("x")), stats.within(F.col("x"), 1.0)).collect()
    assert r[0][0] == pytest.approx(0.35206533) and r[1][1] == pytest.approx(0.97724987) and r[0][2] == pytest.approx(0.93846981) and r[1][3] == pytest.approx(1.59063685)
    assert r[1][4] == pytest.approx(1 / (5 * math.pi)) and r[0][5] == pytest.approx(math.lgamma(0.5)) and r[1][6] == pytest.approx(0.95449974)
    z = spark.range(1).select(stats.zernike(2, 0, F.lit(0.5), F.lit(0.3)), stats.zernike(3, -1, F.lit(0.5), F.lit(0.3)), stats.zernike(2, 1, F.lit(0.5), F.lit(0.3))).first()
    assert z[0] == pytest.approx(-0.5) and z[1] == pytest.approx((3 * 0.125 - 2 * 0.5) * math.sin(0.3)) and z[2] == 0


def test_rotations_are_right_handed():
    p = np.ones(4)
    assert np.allclose(tomo.rotation("x", 90) @ p, (1, -1, 1, 1)) and np.allclose(tomo.rotation("y", 90) @ p, (1, 1, -1, 1)) and np.allclose(tomo.rotation("z", 90) @ p, (-1, 1, 1, 1))


def test_tomography_tables(spark):
    m = tomo.projection(0, 0, 0, (1, 2), (50, 50, 10), (50, 50)).ravel().tolist()
    tilts = spark.createDataFrame([("t", k, m) for k in range(3)], "tomo string, tilt int, matrix array<double>")
    p = spark.createDataFrame([("t", 10.0, 20.0, 5.0), ("s", 0.0, 0.0, 0.0)], "tomo string, x double, y double, z double")
    got = tomo.per_tilt(p, tilts, "tomo").collect()
    assert len(got) == 3 and (got[0].image_x, got[0].image_y) == (11.0, 22.0)
    dims = spark.createDataFrame([("t", 2.0, 100, 100, 20), ("s", 1.0, 10, 10, 10)], "tomo string, pixel double, size_x int, size_y int, size_z int")
    assert {r.tomo: r.x for r in tomo.centred_positions(p, dims, "tomo").collect()} == {"t": 20.0 - 98.0, "s": -4.0}
    rows, optics = tomo.split_optics(p.withColumn("g", F.lit(7)), spark.createDataFrame([(7, "o", 300.0)], "g int, name string, kv double"), "tomo", "g", "name")
    assert {r.name for r in optics.collect()} == {"s", "t"} and {r.g for r in rows.collect()} == {1, 2}
    w = tomo.even_split(spark.createDataFrame([(k, 10 - k) for k in range(8)], "k int, n int"), "k", "n", 2).groupBy("worker").agg(F.sum("n").alias("n")).collect()
    assert w[0].n == w[1].n
