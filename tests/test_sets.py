"""Sources, sinks, the workflow's book and refinement where SQL does not reach, on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.operators import aggregates as A
from fathom.operators import fields
from fathom.operators import images as I
from fathom.operators import particles as P
from fathom.operators import sequences as W
from fathom.plans import pipeline as B
from fathom.plans import refine as R
from fathom.sources import formats, sets, star


def test_tilt_series_set_keeps_order_and_names(spark, tmp_path):
    whole = spark.createDataFrame([(f"TS_0{k}", 0.675 + k) for k in range(1, 6)], "name string, pixel double")
    shots = spark.createDataFrame([(f"TS_0{k}", i, float(3 * i - 60)) for k in range(1, 6) for i in range(41)], "name string, shot int, tilt double")
    path = f"{tmp_path}/tilt_series.star"
    sets.write_tilt_series(whole, shots, path, "name", "file", "shot")
    g, i = sets.read_tilt_series(spark, path, "name", "file", {"pixel": "double", "shot": "int", "tilt": "double"})
    assert [r.name for r in g.orderBy("rid").collect()] == [f"TS_0{k}" for k in range(1, 6)] and "file" not in g.columns
    assert {(r.name, r["count"]) for r in i.groupBy("name").count().collect()} == {(f"TS_0{k}", 41) for k in range(1, 6)}
    g, i = sets.read_tilt_series(spark, path, "name", "file", {"shot": "int"}, series="TS_03")
    assert g.count() == 1 and i.count() == 41 and i.select("name").distinct().first()[0] == "TS_03"
    with pytest.raises(ValueError, match="no tilt series"):
        sets.read_tilt_series(spark, path, "name", "file", series="TS_09")


def test_optics_are_checked(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1), (2, 7)], "id int, optics_group int")
    optics = spark.createDataFrame([(1, 0.9)], "optics_group int, pixel double")
    path = f"{tmp_path}/a.star"
    sets.save_with_optics(rows, optics, path, "micrographs", order="id")
    with pytest.raises(ValueError, match="undefined groups"):
        sets.load_with_optics(spark, path, types={"optics_group": "int"})
    star.write_star({"particles": rows}, path)
    with pytest.raises(ValueError, match="optics"):
        sets.load_with_optics(spark, path)


def test_blocks_with_a_list_and_a_loop():
    found = star.blocks("data_x\n_a 1\n_b 'two words'\nloop_\n_c #1\n3\n4\n\ndata_y\n_d 5\n")
    assert found == [("x", True, ["a", "b"], [["1", "two words"]]), ("x", False, ["c"], [["3"], ["4"]]), ("y", True, ["d"], [["5"]])]


def test_blocks_are_the_same_in_pieces_of_any_length():
    text = "# made\ndata_x\n_a 1\n_b 'two words'\nloop_\n_c #1\n_d #2\n3 m_1\n4 5\n  \n6 7\ndata_y\n_e 5\n\ndata_z\nloop_\n_f\n 1\n_2\n\"a b\" # c\ndata_w"
    whole = list(star.pieces(text))
    assert [p[0] for p in whole] == sorted(p[0] for p in whole)
    for chars in range(len(text)):
        got: dict = {}
        for number, name, listed, labels, rows in star.pieces(text, chars):
            got[number] = (name, listed, labels, (got[number][3] if number in got else []) + rows)
        assert list(got.values()) == star.blocks(text)
    rows = "".join(f"{k} v\n" for k in range(100_000))
    assert max(len(p[4]) for p in star.pieces(f"data_x\nloop_\n_a\n_b\n{rows}")) < 50_000


def test_parts_are_files_of_bounded_rows_with_a_header_each(spark, tmp_path):
    df = spark.range(2500, numPartitions=2).select("id", F.concat(F.lit("m "), F.col("id") % 7).alias("name"), (F.col("id") / 3 - 100).alias("x"))
    sets.write_parts(df, f"{tmp_path}/parts", "lines", 400)
    assert sorted(r.n for r in sets.count_rows(spark, f"{tmp_path}/parts/part-*", "lines").collect()) == sorted([400, 400, 400, 50] * 2)
    back = star.read_star(spark, f"{tmp_path}/parts/part-*", "lines", {"id": "long", "x": "double"})
    assert [(r.id, r.name) for r in back.orderBy("id").collect()] == [(k, f"m {k % 7}") for k in range(2500)]
    assert back.groupBy("file_path").agg(F.min("rid").alias("a"), (F.max("rid") + 1 - F.count("*")).alias("b")).select("a", "b").distinct().collect() == [(0, 0)]
    assert star.formatted_column([0.0, None, -2.5, 1e6, 1e-4, 3.25], df.schema["x"].dataType) == [star.formatted(v, df.schema["x"].dataType) for v in (0.0, None, -2.5, 1e6, 1e-4, 3.25)]


def test_image_formats_round_trip():
    a = np.arange(60, dtype="f4").reshape(3, 4, 5)
    assert (formats.decode_tiff(formats.encode_tiff(a)) == a).all()
    assert (formats.decode_spider(formats.encode_spider(a)) == a).all() and (formats.decode_spider(formats.encode_spider(a[1])) == a[1:2]).all()
    assert (formats.decode_imagic(*formats.encode_imagic(a)) == a).all()
    with pytest.raises(ValueError, match="SPIDER"):
        formats.decode_spider(bytes(4096))


def test_plots_and_curves(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 10.0, 20.0, 3.0), (1.0, 0.0, 0.0, 50.0, 90.0, 6.0)], "x double, y double, z double, rot double, tilt double, n double")
    lines = [r.value for r in formats.bild_lines(df, "x", "y", "z", "rot", "tilt", "n", 10.0, 1.0).collect()]
    assert len(lines) == 2 and all(v.startswith(".color") and ".cylinder" in v for v in lines)
    assert formats.curve_xml([(0.1, 1.0)], "t").count("<coordinate>") == 1 and formats.curve_text([(0.1, 0.5)]) == "0.100000 0.500000\n"


def test_failing_joins(spark):
    a = spark.createDataFrame([(0, 1.0, 1.0, 5.0), (1, 2.0, 2.0, 6.0)], "rid int, x double, y double, p double")
    far = a.withColumn("x", F.col("x") + 2)
    with pytest.raises(Exception, match="coordinates differ"):
        P.with_priors(a, far.select("rid", "x", "y"), "rid", ["p"], "x", "y").collect()
    with pytest.raises(Exception, match="no filament"):
        P.with_filaments(a, a.where("rid = 0").select("rid"), "rid").collect()


def test_order_statistics_of_ties_and_nothing(spark):
    v = [5.0] * 50 + [1e300, -1e300, 0.1, 0.1, None]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    want = sorted(x for x in v if x is not None)
    assert A.order_statistics(df, "v", [0, 1, 2, 3, 30, 53]) == [want[k] for k in (0, 1, 2, 3, 30, 53)]
    assert A.order_statistics(df.where("v is null"), "v", [0]) == [None]


def test_dense_cells_lose_no_row(spark):
    rng = np.random.default_rng(2)
    p = rng.normal(0, 2, (400, 2)).round(2)
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "rid long, x double, y double").withColumn("g", F.lit(1))
    d = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1))
    for reach in (0.0, 0.05, 0.7):
        last = {i for i in range(400) if not (d[i, i + 1 :] <= reach).any()}
        lone = {i for i in range(400) if (d[i] <= reach).sum() == 1}
        assert {r.rid for r in W.remove_near(df, ["g"], ["x", "y"], reach, "rid").collect()} == last
        assert {r.rid for r in W.too_close(df, ["g"], ["x", "y"], reach, "rid").collect()} == lone


def test_book(spark):
    s = "process string, file string"
    book = {"processes": spark.createDataFrame([], "process string, kind string, status string, alias string"), "files": spark.createDataFrame([], "file string, kind string"), "inputs": spark.createDataFrame([], s), "outputs": spark.createDataFrame([], s)}
    book = B.add_process(book, "Import/job001/", "Import", [], [("Import/job001/a.star", "movies")], B.SUCCEEDED)
    book = B.add_process(book, "Motion/job002/", "Motion", [("Import/job001/a.star", "movies")], [("Motion/job002/b.star", "micrographs")])
    assert book["files"].count() == 2 and B.runnable(book["processes"], book["inputs"], book["outputs"]).first().process == "Motion/job002/"
    named = B.set_alias(book["processes"], "Motion/job002/", "Motion/good")
    assert B.find(named, "Motion/good/").first().process == "Motion/job002/" and B.set_alias(named, "Motion/job002/", None).where("alias is not null").count() == 0
    for bad in ("Motion/job7", "two words"):
        with pytest.raises(ValueError, match="no alias"):
            B.set_alias(named, "Import/job001/", bad)
    with pytest.raises(ValueError, match="taken"):
        B.set_alias(named, "Import/job001/", "Motion/good")
    assert B.dangling_outputs(book["processes"], book["outputs"], book["files"].limit(0)).first().file == "Import/job001/a.star"
    ring = spark.createDataFrame([("a", "x"), ("b", "y")], s), spark.createDataFrame([("a", "y"), ("b", "x")], s)
    with pytest.raises(ValueError, match="wait"):
        B.run_order(spark.createDataFrame([("a",), ("b",)], "process string"), *ring)


def test_refinement_finds_class_rotation_and_shift(spark):
    rng = np.random.default_rng(0)
    n = 16
    y, x = np.mgrid[:n, :n] - n // 2
    refs = np.stack([np.exp(-((y - 2) ** 2 + x**2) / 6) + 0.5 * np.exp(-((x + 4) ** 2 + y**2) / 3), np.exp(-(y**2) / 3 - x**2 / 30)])
    rows, truth = [], {}
    for k in range(24):
        c, psi, dy, dx = k % 2, float(rng.choice([0, 90, 180, 270])), int(rng.integers(-1, 2)), int(rng.integers(-1, 2))
        image = I.shift(R.rotated(refs[c], psi), -dy, -dx) + rng.normal(0, 0.02, (n, n))
        truth[k] = (c, psi, dy, dx)
        rows.append((k, image.ravel().tolist(), k % 3 == 0))
    df = spark.createDataFrame(rows, "id int, pixels array<double>, half boolean")
    d = R.differences(df, "id", "pixels", refs, [0.0, 90.0, 180.0, 270.0], [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)], 0.05)
    best = {r.id: (r["class"], r.psi % (180 if r["class"] else 360), r.dy, r.dx) for r in R.weights(d, "id", best_only=True).collect()}
    assert best == {k: (c, psi % (180 if c else 360), dy, dx) for k, (c, psi, dy, dx) in truth.items()}
    w = W.significant_samples(R.weights(d, "id"), "id", "weight", 0.9)
    finer = R.children(w, "id", 90.0, 1.0)
    two = R.differences(df.join(finer, "id"), "id", "pixels", refs, [], [], 0.05, samples="samples")
    assert two.count() == finer.select(F.explode("samples")).count()
    out, history = R.refine(df, "id", "pixels", refs + rng.normal(0, 0.1, refs.shape), [0.0, 90.0, 180.0, 270.0], [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)], 3, sigma2=0.05)
    assert len(history) == 2 and np.corrcoef(out[0][3:-3, 3:-3].ravel(), refs[0][3:-3, 3:-3].ravel())[0, 1] > 0.95
    assert R.converged([{"shell": 3, "assigned": 0.5}] * 3) and not R.converged([{"shell": k, "assigned": 0.5} for k in range(3)])


def test_image_kernels_of_one_shape():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(3, 12, 12))
    assert np.allclose(I.power(I.whitened(a))[:, 0, 1], I.power(I.whitened(a))[:, 0, 1])
    b = I.phase_randomised(a, 0.2, 5)
    assert np.allclose(np.abs(np.fft.rfft2(a)), np.abs(np.fft.rfft2(b)), atol=1e-6) and not np.allclose(a, b) and (b == I.phase_randomised(a, 0.2, 5)).all()
    spot = np.zeros((1, 12, 12))
    spot[0, 2, 9] = 1
    assert np.argmax(I.centred(spot)) == 6 * 12 + 6
    assert np.allclose(I.centred(np.zeros((1, 4, 4))), 0)


def test_fields_of_nulls_and_edges(spark):
    df = spark.createDataFrame([(1, [1.0, None, 3.0, float("nan")]), (2, None)], "k int, a array<double>")
    got = {r.k: r.a for r in df.select("k", fields.without_nan(F.col("a"), 0.5).alias("a")).collect()}
    assert got == {1: [1.0, 0.5, 3.0, 0.5], 2: None}
    assert fields.long_form(df, "k", "a", 2).count() == 4


def test_stream_for_a_limited_time(spark, tmp_path):
    from fathom.streaming import runner

    spark.range(5).write.parquet(f"{tmp_path}/in")
    q = runner.on_the_fly(spark, f"{tmp_path}/in", "id long", lambda df: df, f"{tmp_path}/out", f"{tmp_path}/check", every="1 hour")
    assert runner.run_for(q, 20) is False and not q.isActive
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5
    q = runner.on_the_fly(spark, f"{tmp_path}/in", "id long", lambda df: df, f"{tmp_path}/out", f"{tmp_path}/check")
    assert runner.run_for(q, 60) is True


def test_volumes_turn_and_average():
    from fathom.operators import volumes

    v = np.zeros((5, 5, 5))
    v[2, 2, 4] = 1  # on x
    turned = volumes.rotated_volume(v, volumes.axis_rotation((0, 0, 1), 90))
    assert turned[2, 4, 2] == pytest.approx(1) and turned.sum() == pytest.approx(1)
    four = volumes.symmetrised(v, volumes.symmetry_group("C4"))
    assert [four[2, 2, 4], four[2, 4, 2], four[2, 2, 0], four[2, 0, 2]] == pytest.approx([0.25] * 4)


def test_first_free_within_is_first_free_of_all_pairs(spark):
    r = np.random.default_rng(7)
    cases = [(g, int(n), [float(v) for v in np.round(r.uniform(-5, 5, n), 1)]) for g, n in enumerate((1, 2, 3, 7, 40, 90))]
    for reach in (0.0, 0.3, 2.0, 20.0):
        a = [(g, int(k), v) for g, n, values in cases for k, v in zip(r.permutation(n), values, strict=True)] + [(None, 1, 0.0), (3, 900, None), (3, 901, float("nan")), (9, 1, 0.0)]
        b = [(g, int(k) + 100, float(v)) for g, n, _ in cases for k, v in zip(r.permutation(n // 2 + 1), np.round(r.uniform(-5, 5, n // 2 + 1), 1), strict=True)] + [(None, 1, 0.0), (8, 1, 0.0)]
        want, used = set(), set()
        for g, i, v in sorted((x for x in a if x[0] is not None), key=lambda x: x[:2]):
            free = [j for h, j, w in sorted((x for x in b if x[0] == g), key=lambda x: x[1]) if v is not None and abs(v - w) < reach and (g, j) not in used]
            if free:
                used.add((g, free[0]))
                want.add((g, i, free[0]))
        x, y = (spark.createDataFrame(q, "g int, rid long, v double") for q in (a, b))
        assert {tuple(m) for m in P.first_free_within(x, y, "g", ("v", "v"), reach).collect()} == want
    plan = P.first_free_within(x, y, "g", ("v", "v"), 1.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan  # candidates are not made


def test_imported_folders_of_parts_are_one_file(spark, tmp_path):
    sizes = {"a.dat": 3, "b.txt": 5, "below/c.dat": 7, "below/d.dat/part-0000.dat": 11, "below/d.dat/part-0001.dat": 13, "below/d.dat/x=1/part.txt": 17, "e.dat/part-0000": 19, "adat": 23, "f.DAT": 29, "g {h}.dat": 31}
    for base in ("one", "two.dat"):  # a name of the folder itself does not count
        for name, n in sizes.items():
            path = tmp_path / base / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(bytes(n))
        got = formats.import_files(spark, f"{tmp_path}/{base}", "*.dat", 2).collect()
        want = {"a.dat": 3, "below/c.dat": 7, "below/d.dat": 41, "e.dat": 19, "g {h}.dat": 31}
        assert {(r.file.split(f"/{base}/")[1], r.bytes, r.optics_group) for r in got} == {(k, v, 2) for k, v in want.items()} and len(got) == len(want)
    assert [r.file[-4:] for r in formats.import_files(spark, f"{tmp_path}/*e/", "{b,[x-z]}.t?t").collect()] == [".txt"]
