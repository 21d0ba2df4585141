"""Queries of sources and sinks (written, read back and compared with the table), of the workflow's book and of refinement."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import functions as F

from .catalog import query, table
from .catalog_fields import V, images, r
from .operators import sequences as W
from .plans import pipeline as B
from .plans import refine as R
from .sources import formats, mrc, sets, star, text


def folder(s) -> str:
    """A new folder that driver and executors share."""
    base = s.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir()
    path = os.path.join(base.removeprefix("file://"), f"fathom-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path


# --- tables in text --------------------------------------------------------------------------------------------------

_PART = {"p_partkey": "long", "p_size": "int", "p_retailprice": "double"}


@query("SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part")
def star_round_trip(s, d):
    path = f"{folder(s)}/part.star"
    star.write_star({"parts": table(s, d, "part").drop("p_type")}, path, "p_partkey")
    return star.read_star(s, path, "parts", _PART).drop("file_path", "rid")


@query("SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity FROM lineitem")
def star_parts_round_trip(s, d):
    path = folder(s)
    sets.write_parts(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity"), path, "lines")
    return star.read_star(s, f"{path}/part-*", "lines", {"l_orderkey": "long", "l_linenumber": "int", "l_quantity": "double"}).drop("file_path", "rid")


@query("SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity FROM lineitem")
def star_line_scan(s, d):
    path, labels = folder(s), ["l_orderkey", "l_linenumber", "l_returnflag", "l_quantity"]
    sets.write_parts(table(s, d, "lineitem").select(*labels), path, "lines")
    return sets.scan_lines(s, f"{path}/part-*", labels, {"l_orderkey": "long", "l_linenumber": "int", "l_quantity": "double"})


@query("SELECT count(*) AS n FROM lineitem")
def star_count(s, d):
    path = folder(s)
    sets.write_parts(table(s, d, "lineitem").select("l_orderkey"), path, "lines")
    return sets.count_rows(s, f"{path}/part-*", "lines").agg(F.sum("n").alias("n"))


@query("SELECT 'nation' AS block, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def star_all_blocks(s, d):
    path = f"{folder(s)}/two.star"
    star.write_star({"nation": table(s, d, "nation"), "region": table(s, d, "region")}, path)
    parts = [df.agg(F.lit(n).alias("block"), F.count("*").alias("n")) for n, df in star.read_all(s, path).items()]
    return parts[0].unionByName(parts[1])


@query("SELECT r_regionkey, r_name FROM region WHERE r_regionkey = 2")
def star_list_block(s, d):
    path = f"{folder(s)}/list.star"
    row = table(s, d, "region").where("r_regionkey = 2").first()
    with open(path, "w") as f:
        f.write(f"data_one\n\n_r_regionkey {row.r_regionkey}\n_r_name {star.quoted(row.r_name)}\n\ndata_two\nloop_\n_a\n1\n")
    return star.read_star(s, path, "one", {"r_regionkey": "int"}).drop("file_path", "rid")


@query("SELECT n_nationkey, s_suppkey, s_acctbal, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def particles_with_optics(s, d):
    path = f"{folder(s)}/particles.star"
    rows, optics = table(s, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("optics_group"), "s_acctbal"), table(s, d, "nation").select(F.col("n_nationkey").alias("optics_group"), "n_name")
    sets.save_with_optics(rows, optics, path, order="s_suppkey")
    got, groups, _ = sets.load_with_optics(s, path, types={"s_suppkey": "long", "optics_group": "int", "s_acctbal": "double"})
    return got.join(groups, "optics_group").select(F.col("optics_group").alias("n_nationkey"), "s_suppkey", "s_acctbal", "n_name")


@query("SELECT 't' || s_nationkey AS tomo, s_suppkey, s_acctbal, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def tilt_series_set(s, d):
    path = f"{folder(s)}/tilt_series.star"
    whole = table(s, d, "nation").select(F.concat(F.lit("t"), "n_nationkey").alias("tomo"), "n_regionkey")
    shots = table(s, d, "supplier").select(F.concat(F.lit("t"), "s_nationkey").alias("tomo"), "s_suppkey", "s_acctbal")
    whole = whole.join(shots.select("tomo"), "tomo", "left_semi")
    sets.write_tilt_series(whole, shots, path, "tomo", "file", "s_suppkey")
    g, i = sets.read_tilt_series(s, path, "tomo", "file", {"n_regionkey": "int", "s_suppkey": "long", "s_acctbal": "double"})
    return i.join(g, "tomo").select("tomo", "s_suppkey", "s_acctbal", "n_regionkey")


@query("SELECT s_suppkey::INTEGER AS serial, 'CA' AS name, 'GLY' AS residue, 'A' AS chain, s_nationkey AS number, round(s_acctbal / 10, 3) + 0.0 AS x, 1.5 AS y, -2.25 AS z, 1.0 AS occupancy, 30.0 AS b_factor FROM supplier")
def atoms_round_trip(s, d):
    path = folder(s)
    a = table(s, d, "supplier").select(F.col("s_suppkey").cast("int").alias("serial"), F.lit("CA").alias("name"), F.lit("GLY").alias("residue"), F.lit("A").alias("chain"), F.col("s_nationkey").alias("number"), F.round(F.col("s_acctbal") / 10, 3).alias("x"), F.lit(1.5).alias("y"), F.lit(-2.25).alias("z"), F.lit(1.0).alias("occupancy"), F.lit(30.0).alias("b_factor"))
    formats.atom_lines(a).write.mode("overwrite").text(path)
    return text.read_atoms(s, path).withColumn("x", r("x", 3))


@query("SELECT s_suppkey + 32.0 AS x, s_nationkey + 16.0 AS y FROM supplier")
def boxes_round_trip(s, d):
    path = folder(s)
    table(s, d, "supplier").select(F.concat_ws("\t", "s_suppkey", "s_nationkey", F.lit(64), F.lit(32))).write.mode("overwrite").text(path)
    return text.read_boxes(s, path).select("x", "y")


@query("SELECT s_suppkey::DOUBLE AS x, s_acctbal AS y, s_nationkey::DOUBLE AS z FROM supplier")
def coordinates_round_trip(s, d):
    path = folder(s)
    lines = table(s, d, "supplier").select(F.concat_ws(" ", F.lit("7"), "s_suppkey", "s_acctbal", "s_nationkey").alias("value"))
    lines.unionByName(table(s, d, "region").select(F.col("r_name").alias("value"))).write.mode("overwrite").text(path)
    return formats.read_coordinates(s, path, ["x", "y", "z"], skip=1).select("x", "y", "z")


@query("SELECT n_nationkey AS id, n_nationkey * 2.0 AS x, n_regionkey * 1.0 AS y, 0.5 AS z, 3.0 AS r FROM nation")
def markers_round_trip(s, d):
    path = f"{folder(s)}/m.cmm"
    with open(path, "w") as f:
        f.write(formats.marker_text([(n.n_nationkey, n.n_nationkey * 2.0, n.n_regionkey * 1.0, 0.5, 3.0) for n in table(s, d, "nation").collect()]))  # 25 rows
    return formats.read_markers(s, path).drop("file_path")


@query("SELECT s_suppkey AS k, s_suppkey % 9 * 2.0 AS tilt, row_number() OVER (ORDER BY s_suppkey) - 1 AS \"order\" FROM supplier")
def tilt_notes(s, d):
    path = f"{folder(s)}/n.mdoc"
    rows = table(s, d, "supplier").orderBy("s_suppkey").select("s_suppkey").toLocalIterator()
    with open(path, "w") as f:
        for q in rows:
            k = q.s_suppkey
            f.write(f"[ZValue = {k}]\nTiltAngle = {k % 9 * 2.0}\nDateTime = 01-Jan-24  {k // 3600:02d}:{k // 60 % 60:02d}:{k % 60:02d}\n\n")
    n = text.read_tilt_notes(s, path)
    return n.select(F.col("z").cast("long").alias("k"), F.col("keys")["TiltAngle"].cast("double").alias("tilt"), F.col("order").cast("long").alias("order"))


# --- images ------------------------------------------------------------------------------------------------------------

_STACK = "SELECT (vec_id + 1)::BIGINT AS section, i::INTEGER AS i, round(v::DOUBLE, 6) + 0.0 AS v FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(64)) AS i FROM embeddings)"


def _sections(df):
    return df.select("section", F.posexplode("pixels").alias("i", "v")).select("section", "i", r(F.col("v").cast("double"), 6).alias("v"))


@query(_STACK)
def stack_round_trip(s, d):
    path = f"{folder(s)}/stack.mrcs"
    formats.write_stack(images(s, d), path, "vec_id")
    return _sections(mrc.read_images(s, path))


def _encoded(s, d, kind):
    """Every image written in a format, a file's contents each, and decoded again."""
    a = images(s, d).select(F.concat((F.col("vec_id") + 1).cast("string"), F.lit(f".{kind}")).alias("path"), "ny", "nx", "pixels")
    got = formats.decoded(formats.encoded(a, kind))
    return _sections(got.withColumn("section", F.substring_index("path", ".", 1).cast("long")))


@query(_STACK)
def tiff_round_trip(s, d):
    return _encoded(s, d, "tif")


@query(_STACK)
def spider_round_trip(s, d):
    return _encoded(s, d, "spi")


# --- the workflow's book -------------------------------------------------------------------------------------------------


def _book(s, d):
    n = table(s, d, "nation")
    p = n.select(F.format_string("Step%d/job%03d/", F.col("n_regionkey"), F.col("n_nationkey")).alias("process"), F.concat(F.lit("Step"), "n_regionkey").alias("kind"), F.element_at(F.array(*[F.lit(x) for x in (B.RUNNING, B.SCHEDULED, B.SUCCEEDED)]), F.col("n_nationkey") % 3 + 1).alias("status"), F.col("n_name").alias("alias"))
    o = n.select(F.format_string("Step%d/job%03d/", F.col("n_regionkey"), F.col("n_nationkey")).alias("process"), F.format_string("Step%d/job%03d/out.star", F.col("n_regionkey"), F.col("n_nationkey")).alias("file"))
    m = n.select(F.col("n_nationkey").alias("k"), F.format_string("Step%d/job%03d/out.star", F.col("n_regionkey"), F.col("n_nationkey")).alias("file"))
    i = n.where("n_nationkey > 0").select(F.format_string("Step%d/job%03d/", F.col("n_regionkey"), F.col("n_nationkey")).alias("process"), F.floor(F.col("n_nationkey") / 2).alias("k")).join(m, "k").select("process", "file")
    return {"processes": p, "files": o.select("file", F.lit("table").alias("kind")), "inputs": i, "outputs": o}


_B = """WITH p AS (SELECT n_nationkey AS k, printf('Step%d/job%03d/', n_regionkey, n_nationkey) AS process, 'Step' || n_regionkey AS kind, ['Running', 'Scheduled', 'Succeeded'][n_nationkey % 3 + 1] AS status, n_name AS alias FROM nation) """


@query(_B + "SELECT process, kind, status, alias FROM p WHERE k = 4")
def find_process(s, d):
    p = _book(s, d)["processes"]
    return B.find(p, p.where("process like '%job004/'").first().alias + "/")


@query(_B + "SELECT process, CASE WHEN status = 'Running' AND k % 2 = 0 THEN 'Succeeded' WHEN status = 'Running' AND k % 5 = 0 THEN 'Failed' ELSE status END AS status FROM p")
def completion_check(s, d):
    p = _book(s, d)["processes"]
    k = F.regexp_extract("process", "job([0-9]+)", 1).cast("int")
    marks = p.where(k % 2 == 0).select("process", F.lit(B.SUCCEEDED).alias("mark")).unionByName(p.where(k % 5 == 0).select("process", F.lit(B.FAILED).alias("mark")))
    return B.completed(p, marks).select("process", "status")


@query(_B + "SELECT a.process FROM p a LEFT JOIN p b ON b.k = a.k // 2 AND a.k > 0 WHERE a.status = 'Scheduled' AND coalesce(b.status, 'Succeeded') = 'Succeeded'")
def runnable_processes(s, d):
    b = _book(s, d)
    return B.runnable(b["processes"], b["inputs"], b["outputs"]).select("process")


@query(_B + "SELECT process, CASE WHEN k = 0 THEN 0 ELSE floor(log2(k)) + 1 END::INTEGER AS level FROM p")
def run_order(s, d):
    b = _book(s, d)
    return B.run_order(b["processes"], b["inputs"], b["outputs"])


@query(_B + "SELECT DISTINCT b.process FROM p a JOIN p b ON b.k = a.k // 2 WHERE a.k > 0")
def processes_with_dependants(s, d):
    from .plans.graph import has_dependants

    b = _book(s, d)
    return has_dependants(b["inputs"], b["outputs"])


@query(_B + "SELECT process, process || 'Movies/' || k || '.mrc' AS file FROM p WHERE status = 'Succeeded' AND kind = 'Step1' AND k % 4 <> 0")
def clean_up(s, d):
    p = _book(s, d)["processes"]
    k = F.regexp_extract("process", "job0*([0-9]+)/", 1)
    files = p.select(F.concat("process", F.lit("Movies/"), k, F.lit(".mrc")).alias("file"), k.cast("int").alias("k")).unionByName(p.select(F.concat("process", F.lit("run.out")).alias("file"), k.cast("int").alias("k")))
    return B.to_clean(p, files.select("file"), files.where("k % 4 = 0").select("file"), {"Step1": [r"\.mrc$"], "Step2": []})


@query(_B + "SELECT printf('%s/job%03d/', kind, 100 + row_number() OVER (ORDER BY process) - 1) AS process, 'Scheduled' AS status FROM p WHERE kind = 'Step3' UNION ALL SELECT process, status FROM p")
def export_and_import(s, d):
    b = _book(s, d)
    out = B.exported(b, b["processes"].where("kind = 'Step3'"))
    return B.imported(b, out, 100)["processes"].select("process", "status")


@query("SELECT n_nationkey, 'run --in ' || n_name || ' --n ' || n_regionkey AS command FROM nation")
def batch_commands(s, d):
    c = s.createDataFrame([("run --in xxxn_namexxx --n xxxn_regionkeyxxx",)], "line string")
    return B.substituted(c, table(s, d, "nation"), "line").select("n_nationkey", "command")


# --- refinement ------------------------------------------------------------------------------------------------------------

_SAMPLES = V + """, i AS (SELECT * FROM v WHERE vec_id >= 3), k AS (SELECT vec_id AS class, y, x, v FROM v WHERE vec_id < 3),
q AS (SELECT class, 0 AS psi, y, x, v FROM k UNION ALL SELECT class, 180, (8 - y) % 8, (8 - x) % 8, CASE WHEN y = 0 OR x = 0 THEN NULL ELSE v END FROM k),
r AS (SELECT class, psi, y, x, CASE WHEN psi = 180 AND (y = 0 OR x = 0) THEN 0 ELSE v END AS v FROM q),
d AS (SELECT i.vec_id, class, psi, dy, dx, sum(pow(i.v - r.v, 2)) / 0.5 AS diff2 FROM i, range(-1, 2) a(dy), range(-1, 2) b(dx), r WHERE r.y = (i.y + dy + 8) % 8 AND r.x = (i.x + dx + 8) % 8 GROUP BY ALL) """


def _samples(s, d):
    refs = np.array([x.pixels for x in images(s, d).where("vec_id < 3").orderBy("vec_id").collect()]).reshape(3, 8, 8)  # the model
    shots = images(s, d).where("vec_id >= 3")
    return R.differences(shots, "vec_id", "pixels", refs, [0.0, 180.0], [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)], 0.25)


@query(_SAMPLES + "SELECT vec_id, class::INTEGER AS class, psi::DOUBLE AS psi, dy::DOUBLE AS dy, dx::DOUBLE AS dx, round(diff2, 5) AS diff2 FROM d")
def coarse_differences(s, d):
    return _samples(s, d).withColumn("diff2", F.round("diff2", 5)).withColumns({c: r(c, 1) for c in ("psi", "dy", "dx")})


_W = _SAMPLES + ", e AS (SELECT *, ln([0.5, 0.3, 0.2][class + 1]) - (dy * dy + dx * dx) / 4.0 + min(diff2) OVER (PARTITION BY vec_id) - diff2 AS e FROM d), w AS (SELECT *, exp(e) AS weight FROM e) "


def _weighted(s, d):
    return R.weights(_samples(s, d), "vec_id", [0.5, 0.3, 0.2], 2.0)


@query(_W + "SELECT vec_id, class::INTEGER AS class, psi::DOUBLE AS psi, dy::DOUBLE AS dy, dx::DOUBLE AS dx, round(weight, 6) AS weight FROM w")
def sample_weights(s, d):
    return _weighted(s, d).select("vec_id", "class", *[r(c, 1).alias(c) for c in ("psi", "dy", "dx")], F.round("weight", 6).alias("weight"))


@query(_SAMPLES + "SELECT vec_id, class::INTEGER AS class, psi::DOUBLE AS psi, dy::DOUBLE AS dy, dx::DOUBLE AS dx FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY diff2, class, psi, dy, dx) = 1")
def first_iteration_best(s, d):
    return R.weights(_samples(s, d), "vec_id", best_only=True).select("vec_id", "class", *[r(c, 1).alias(c) for c in ("psi", "dy", "dx")])


_SIG = _W + """, c AS (SELECT *, sum(weight) OVER (PARTITION BY vec_id ORDER BY weight ROWS UNBOUNDED PRECEDING) AS run, sum(weight) OVER (PARTITION BY vec_id) AS t FROM w),
g AS (SELECT * FROM c JOIN (SELECT vec_id, min(weight) AS cut FROM c WHERE run > 0.5 * t GROUP BY 1) USING (vec_id) WHERE weight >= cut) """


@query(_SIG + "SELECT vec_id, class::INTEGER AS class, psi + p AS psi, dy + a AS dy, dx + b AS dx FROM g, (VALUES (-45.0), (45.0)) x(p), (VALUES (-0.25), (0.25)) y(a), (VALUES (-0.25), (0.25)) z(b) GROUP BY ALL")
def fine_samples(s, d):
    w = W.significant_samples(_weighted(s, d), "vec_id", "weight", 0.5)
    c = R.children(w, "vec_id", 180.0, 1.0).select("vec_id", F.explode("samples").alias("q"))
    return c.select("vec_id", "q.class", *[F.col(f"q.{x}").alias(x) for x in ("psi", "dy", "dx")])


@query(_W + """, n AS (SELECT vec_id, class, psi, dy, dx, weight / sum(weight) OVER (PARTITION BY vec_id) AS w FROM w WHERE psi = 0),
m AS (SELECT vec_id % 2 AS half, class, ((i.y + dy + 8) % 8 * 8 + (i.x + dx + 8) % 8)::INTEGER AS i, sum(w * v) AS s, sum(w) AS w FROM n JOIN i USING (vec_id) GROUP BY ALL)
SELECT half, class::INTEGER AS class, i, round(s / w, 5) + 0.0 AS v, round(w, 5) AS weight FROM m""")
def class_averages_by_half(s, d):
    w = _weighted(s, d).where("psi = 0")
    t = w.groupBy("vec_id").agg(F.sum("weight").alias("t"))
    w = w.join(t, "vec_id").withColumn("weight", F.col("weight") / F.col("t")).drop("t")
    shots = images(s, d).withColumn("half", F.col("vec_id") % 2)
    m = R.maximised(R.class_sums(shots, "vec_id", "pixels", w, 8, 8, "half"), "half")
    return m.select("half", "class", "i", r("v").alias("v"), F.round("weight", 5).alias("weight"))
