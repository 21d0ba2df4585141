"""Queries of the particle, tilt, filament and class operators and of the scalar functions on the driver tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .catalog import query, table
from .functions import angles, stats, strings
from .functions import ctf as ctf_
from .operators import aggregates as A
from .operators import expand as X
from .operators import joins as J
from .operators import particles as P
from .operators import picks as K
from .operators import sequences as W
from .operators import table as T
from .operators import volumes as V
from .plans import tomography as G


def r(c, k=4):
    return F.round(c, k) + F.lit(0.0)


# --- columns -------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders")
def drop_column(s, d):
    return T.remove_columns(table(s, d, "orders"), "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")


_ANGLES = "radians(p_size * 7.0) AS a, radians(p_size * 3.0) AS b, radians(p_size * 11.0) AS g"
_M = {
    "m00": "cos(g) * cos(b) * cos(a) - sin(g) * sin(a)", "m01": "cos(g) * cos(b) * sin(a) + sin(g) * cos(a)", "m02": "-cos(g) * sin(b)",
    "m10": "-sin(g) * cos(b) * cos(a) - cos(g) * sin(a)", "m11": "-sin(g) * cos(b) * sin(a) + cos(g) * cos(a)", "m12": "sin(g) * sin(b)",
    "m20": "sin(b) * cos(a)", "m21": "sin(b) * sin(a)", "m22": "cos(b)",
}
_MATRIX = f"WITH e AS (SELECT *, {_ANGLES} FROM part), m AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _M.items())} FROM e) "


def _oriented(s, d, *more):
    return table(s, d, "part").select(F.col("p_partkey").alias("k"), *[(F.col("p_size") * x).alias(c) for c, x in (("rot", 7.0), ("tilt", 3.0), ("psi", 11.0))], *more)


_PIXEL = "(1.0 + p_partkey % 3)"


@query(_MATRIX + f"SELECT p_partkey AS k, round(0.5 - (m00 * 3 + m01 * 4 + m02 * 5) * {_PIXEL}, 4) + 0.0 AS x, round(0.25 - (m10 * 3 + m11 * 4 + m12 * 5) * {_PIXEL}, 4) + 0.0 AS y, round(-(m20 * 3 + m21 * 4 + m22 * 5) * {_PIXEL}, 4) + 0.0 AS z FROM m")
def recentre(s, d):
    p = _oriented(s, d, F.lit(0.5).alias("x"), F.lit(0.25).alias("y"), F.lit(0.0).alias("z"))
    out = P.recentre(p, (3, 4, 5), F.lit(1.0) + F.col("k") % 3, ("rot", "tilt", "psi"), ["x", "y", "z"])
    return out.select("k", *[r(c).alias(c) for c in "xyz"])


@query("SELECT s_suppkey AS k, round(s_suppkey - round(s_acctbal / 7), 4) + 0.0 AS x, round(s_acctbal / 7 - round(s_acctbal / 7), 4) + 0.0 AS ox FROM supplier")
def recentre_coordinates(s, d):
    p = table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_suppkey").cast("double").alias("x"), F.col("s_acctbal").alias("ox"))
    return P.moved_to_origin(p, F.lit(1.0) / 7, ["x"], ["ox"]).select("k", r("x").alias("x"), r("ox").alias("ox"))


@query("SELECT p_partkey, 0.0::DOUBLE AS p_retailprice FROM part")
def reset_offsets(s, d):
    return P.reset_offsets(table(s, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", "absent")


@query("SELECT p_partkey, 0.5::DOUBLE AS p_retailprice, 90.0::DOUBLE AS tilt_prior FROM part")
def null_tilt_priors(s, d):
    return P.null_priors(table(s, d, "part").select("p_partkey", "p_retailprice"), "tilt_prior", "p_retailprice")


@query("SELECT n_nationkey, 1::INTEGER AS n_regionkey, 'opticsGroup1' AS n_name FROM nation")
def one_optics_group(s, d):
    return P.one_group(table(s, d, "nation"), "n_regionkey", "n_name", "opticsGroup1")


@query("SELECT n_nationkey, n_name, n_regionkey, ''::VARCHAR AS c_name, 0::BIGINT AS c_custkey, 0::INTEGER AS c_nationkey, 0.0::DOUBLE AS c_acctbal, ''::VARCHAR AS c_mktsegment FROM nation")
def add_missing_labels(s, d):
    return P.add_missing(table(s, d, "nation"), table(s, d, "customer"))


@query("SELECT c_custkey, c_acctbal, 0.0::DOUBLE AS rot, 1::INTEGER AS class, coalesce(CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_nationkey END, 0)::INTEGER AS n FROM customer")
def default_columns(s, d):
    c = table(s, d, "customer").select("c_custkey", "c_acctbal", F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey")).alias("n"), F.lit(1).alias("class"))
    return T.fill_defaults(c, {"rot": "double", "n": "int", "class": "int"})


@query("""SELECT * FROM (VALUES ('n_name', 'string', 'nation'), ('n_nationkey', 'int', 'nation'), ('n_regionkey', 'int', 'nation'), ('r_name', 'string', 'region'), ('r_regionkey', 'int', 'region')) t(label, kind, tables)""")
def label_dictionary(s, d):
    return P.labels_of(s, {t: table(s, d, t) for t in ("nation", "region")})


# --- filters -------------------------------------------------------------------------------------------------------


@query("SELECT vec_id, label FROM embeddings WHERE embedding[4] > -0.1 AND embedding[4] < 0.1")
def eigenvalue_range(s, d):
    return P.component_range(table(s, d, "embeddings"), "embedding", 3, -0.1, 0.1).select("vec_id", "label")


@query("SELECT event_id, value FROM events WHERE value >= 7")
def minimum_pick_score(s, d):
    return P.minimum_score(table(s, d, "events").select("event_id", "value"), "value", 7.0)


@query("SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_linenumber = 2 AND l_suppkey = 7")
def subset_and_class(s, d):
    return P.subset(table(s, d, "lineitem"), "l_linenumber", 2, "l_suppkey", 7).select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def members_of_selected_classes(s, d):
    classes = table(s, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), (F.col("n_regionkey") == 2).cast("int").alias("selected"))
    return P.of_selected(table(s, d, "customer").select("c_custkey", "c_nationkey"), classes, "c_nationkey", "selected")


@query("SELECT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o_orderkey = l_orderkey AND o_orderkey % 7 = l_linenumber)")
def exclude_tilt_images(s, d):
    gone = table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 7).cast("int").alias("l_linenumber"))
    return P.without(table(s, d, "lineitem").select("l_orderkey", "l_linenumber"), gone, "l_orderkey", "l_linenumber")


@query("SELECT vec_id, i::INTEGER AS frame FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(64)) AS i FROM embeddings) WHERE v > 0.1")
def visible_frames(s, d):
    e = table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: (v > F.lit(0.1).cast("float")).cast("int")).alias("flags"))
    return P.visible(e, "flags")


# --- joins ---------------------------------------------------------------------------------------------------------

_STEM = "regexp_replace(url, '\\.[^./]*$', '')"


@query(f"SELECT page_id FROM pages WHERE split_part(url, '/', 3) || right({_STEM}, 3) IN (SELECT split_part(url, '/', 3) || right({_STEM}, 3) FROM pages WHERE url LIKE '%/en/%')")
def chosen_by_projection(s, d):
    p = table(s, d, "pages").select("page_id", F.element_at(F.split("url", "/"), 3).alias("mic"), F.col("url").alias("name"))
    return P.chosen_by_projection(p, p.where("name like '%/en/%'"), "mic", "name", 3).select("page_id")


@query("SELECT o_orderkey AS rid, o_totalprice AS x, o_custkey::DOUBLE AS y, o_totalprice * 2 AS prior FROM orders")
def priors_with_local_results(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("rid"), F.col("o_totalprice").alias("x"), F.col("o_custkey").cast("double").alias("y"))
    near = o.select("rid", (F.col("x") + 0.5).alias("x"), (F.col("y") - 1.0).alias("y"), (F.col("x") * 2).alias("prior"))
    return P.with_priors(near, o, "rid", ["prior"], "x", "y")


@query("SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def segments_with_filaments(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return P.with_filaments(table(s, d, "lineitem").select("l_orderkey", "l_linenumber").join(o.select("l_orderkey"), "l_orderkey", "left_semi"), o, "l_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice, l_shipdate) - 1 AS place FROM lineitem")
def rows_by_micrograph(s, d):
    return P.grouped_order(table(s, d, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate").select("l_orderkey", "l_linenumber", "l_partkey", "place")


@query("""WITH RECURSIVE p AS (SELECT c_nationkey AS g, c_custkey AS a, s_suppkey AS b FROM customer JOIN supplier ON c_nationkey = s_nationkey AND abs(c_acctbal - s_acctbal) < 3000),
o AS (SELECT g, a, list_sort(list(b)) AS bs, row_number() OVER (PARTITION BY g ORDER BY a) AS i FROM p GROUP BY 1, 2),
f AS (SELECT g, a, i, bs[1] AS b, [bs[1]] AS used FROM o WHERE i = 1
UNION ALL SELECT o.g, o.a, o.i, list_filter(o.bs, lambda x: NOT list_contains(f.used, x))[1] AS b, list_append(f.used, list_filter(o.bs, lambda x: NOT list_contains(f.used, x))[1]) FROM f JOIN o ON o.g = f.g AND o.i = f.i + 1)
SELECT g, a AS a_rid, b AS b_rid FROM f WHERE b IS NOT NULL""")
def tilt_pair_matching(s, d):
    a = table(s, d, "customer").select(F.col("c_custkey").alias("rid"), F.col("c_acctbal").alias("v"), F.col("c_nationkey").alias("g"))
    b = table(s, d, "supplier").select(F.col("s_suppkey").alias("rid"), F.col("s_acctbal").alias("v"), F.col("s_nationkey").alias("g"))
    return P.first_free_within(a, b, "g", ("v", "v"), 3000.0)


_AXES = " + ".join(f"degrees(acos(greatest(-1, least(1, {' + '.join(f'm{i}{j} * n{i}{j}' for j in range(3))}))))" for i in range(3))
_N = {k.replace("m", "n"): v.replace("(a)", "(a2)").replace("(b)", "(b2)").replace("(g)", "(g2)") for k, v in _M.items()}


def _mate_matrix(q):
    c = f"cos(radians({q} * 90.0))"
    w = f"sin(radians({q} * 90.0))"
    # rotation about z: columns of the matrix mix
    return {f"n{i}0": f"n{i}0 * {c} + n{i}1 * {w}" for i in range(3)} | {f"n{i}1": f"-n{i}0 * {w} + n{i}1 * {c}" for i in range(3)} | {f"n{i}2": f"n{i}2" for i in range(3)}


@query(f"""WITH e AS (SELECT p_partkey AS k, {_ANGLES}, radians(p_partkey % 360) AS a2, radians(p_partkey % 90) AS b2, radians(p_partkey % 200) AS g2 FROM part),
m AS (SELECT k, {', '.join(f'{v} AS {c}' for c, v in (_M | _N).items())} FROM e),
q AS (SELECT k, {', '.join(_M)}, {', '.join(f'{v} AS {c}' for c, v in _mate_matrix('q').items())} FROM m, range(4) r(q))
SELECT k, round(min(({_AXES}) / 3), 3) AS distance FROM q GROUP BY 1""")
def nearest_symmetry_mate(s, d):
    p = _oriented(s, d, (F.col("p_partkey") % 360).cast("double").alias("rot2"), (F.col("p_partkey") % 90).cast("double").alias("tilt2"), (F.col("p_partkey") % 200).cast("double").alias("psi2"))
    mates = [[math.cos(math.radians(90 * q)), -math.sin(math.radians(90 * q)), 0, math.sin(math.radians(90 * q)), math.cos(math.radians(90 * q)), 0, 0, 0, 1] for q in range(4)]
    return P.nearest_mate(p, ("rot", "tilt", "psi"), ("rot2", "tilt2", "psi2"), mates).select("k", F.round("distance", 3).alias("distance"))


@query("SELECT p_partkey AS k, round(((p_size * 37.0 - 500 + 180) % 360 + 360) % 360 - 180, 4) + 0.0 AS a FROM part")
def wrapped_angle(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("k"), r(angles.wrapped(F.col("p_size") * 37.0 - 500)).alias("a"))


@query("""WITH b AS (SELECT split_part(split_part(url, '/', -1), '.', 1) AS b, arg_max(url, page_id) AS file FROM pages WHERE url LIKE '%/en/%' GROUP BY 1)
SELECT page_id, file FROM (SELECT page_id, split_part(split_part(url, '/', -1), '.', 1) AS b FROM pages WHERE NOT url LIKE '%/en/%') LEFT JOIN b USING (b)""")
def file_name_match(s, d):
    p = table(s, d, "pages").select("page_id", F.col("url").alias("file"))
    return J.name_match(p.where("file like '%/en/%'"), p.where("not file like '%/en/%'").select(F.col("page_id").alias("id"), F.col("file").alias("name")), "file", "name", "page_id").select(F.col("id").alias("page_id"), "file")


@query("SELECT c_custkey AS id, round(c_acctbal * (1.5 + n_regionkey) * 2 - ((100 + n_nationkey) / 2.0 - 1) * (1.5 + n_regionkey), 3) + 0.0 AS x FROM customer JOIN nation ON c_nationkey = n_nationkey")
def annotations_with_tilt_series(s, d):
    p = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("tomo"), F.col("c_acctbal").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    t = table(s, d, "nation").select(F.col("n_nationkey").alias("tomo"), (F.col("n_regionkey") + 1.5).alias("pixel"), *[(F.col("n_nationkey") + 100).alias(f"size_{c}") for c in "xyz"])
    return G.centred_positions(p, t, "tomo", 2.0).select("id", r("x", 3).alias("x"))


@query("SELECT page_id FROM pages WHERE split_part(url, '/', -1) IN (SELECT split_part(url, '/', -1) FROM pages WHERE url LIKE '%/en/%')")
def reextraction_join(s, d):
    p = table(s, d, "pages").select("page_id", "url")
    return K.name_contains(p, p.where("url like '%/en/%'").select(F.concat(F.lit("x/"), F.substring_index("url", "/", -1)).alias("name")), "url", "name").select("page_id")


# --- aggregates ----------------------------------------------------------------------------------------------------


@query("SELECT (SELECT count(*) FROM lineitem) AS images, sum(len(string_split(p_name || ',' || p_type, ',')))::BIGINT AS words FROM part")
def count_images_and_words(s, d):
    words = table(s, d, "part").agg(F.sum(strings.word_count(F.concat_ws(",", "p_name", "p_type"))).alias("words"))
    return words.crossJoin(F.broadcast(table(s, d, "lineitem").agg(F.count("*").alias("images"))))  # one row each


@query("SELECT round(avg((l_extendedprice + l_quantity) / 2), 4) AS mean, round(stddev_samp((l_extendedprice + l_quantity) / 2), 4) AS sigma FROM lineitem")
def defocus_stats(s, d):
    return P.defocus_stats(table(s, d, "lineitem"), "l_extendedprice", "l_quantity").select(F.round("mean", 4).alias("mean"), F.round("sigma", 4).alias("sigma"))


@query("""WITH v AS (SELECT l_extendedprice AS x, row_number() OVER (ORDER BY l_extendedprice) - 1 AS i, count(*) OVER () AS n FROM lineitem)
SELECT max(x) FILTER (i = n // 4) AS q1, max(x) FILTER (i = n // 2) AS q2, max(x) FILTER (i = 3 * n // 4) AS q3 FROM v""")
def order_statistics(s, d):
    li = table(s, d, "lineitem")
    n = li.count()
    return s.createDataFrame([tuple(A.order_statistics(li, "l_extendedprice", [n // 4, n // 2, 3 * n // 4]))], "q1 double, q2 double, q3 double")


@query("""WITH x AS (SELECT l_quantity AS x, l_discount * 100 AS y, l_extendedprice / 1000 AS z, 1 + l_tax AS w FROM lineitem),
s AS (SELECT sum(w*w*x*x) xx, sum(w*w*x*y) xy, sum(w*w*x) x1, sum(w*w*y*y) yy, sum(w*w*y) y1, sum(w*w) n, sum(w*w*x*z) xz, sum(w*w*y*z) yz, sum(w*w*z) z1 FROM x),
c AS (SELECT xx - x1*x1/n AS a, xy - x1*y1/n AS b, yy - y1*y1/n AS c, xz - x1*z1/n AS p, yz - y1*z1/n AS q, x1/n AS mx, y1/n AS my, z1/n AS mz FROM s)
SELECT round((p*c - q*b)/(a*c - b*b), 5) + 0.0 AS a, round((q*a - p*b)/(a*c - b*b), 5) + 0.0 AS b, round(mz - (p*c - q*b)/(a*c - b*b)*mx - (q*a - p*b)/(a*c - b*b)*my, 4) + 0.0 AS c FROM c""")
def plane_fit(s, d):
    li = table(s, d, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_extendedprice") / 1000).alias("z"), (F.col("l_tax") + 1).alias("w"))
    a, b, c = A.plane_fit(li, "x", "y", "z", F.col("w"))
    return s.createDataFrame([(round(a, 5) + 0.0, round(b, 5) + 0.0, round(c, 4) + 0.0)], "a double, b double, c double")


@query("""WITH g AS (SELECT l_suppkey % 5 AS class, l_linenumber AS direction, sum(l_discount + 0.01) AS total, sum((l_discount + 0.01) * (l_quantity * l_quantity + l_tax * l_tax)) AS o FROM lineitem GROUP BY 1, 2)
SELECT class, direction, round(total, 4) AS total, round(total / (SELECT sum(total) FROM g), 7) AS share, round(o / (2 * total), 4) AS sigma2 FROM g""")
def weighted_sums(s, d):
    li = table(s, d, "lineitem").select((F.col("l_suppkey") % 5).alias("class"), F.col("l_linenumber").alias("direction"), (F.col("l_discount") + 0.01).alias("w"), "l_quantity", "l_tax")
    g = P.weighted_sums(li, "w", "class", "direction", offsets=("l_quantity", "l_tax"))
    return g.select("class", "direction", F.round("total", 4).alias("total"), F.round("share", 7).alias("share"), F.round("sigma2", 4).alias("sigma2"))


@query("""WITH c AS (SELECT l_linenumber - 1 AS shell, avg(l_quantity) / 25.6 AS snr, round(avg(l_extendedprice), 2) AS res FROM lineitem GROUP BY 1), w AS (SELECT *, lag(res) OVER (ORDER BY shell) AS before FROM c)
SELECT coalesce(arg_min(before, shell) FILTER (shell > 0 AND snr < 1), 2.5)::DOUBLE AS resolution FROM w""")
def resolution_by_snr(s, d):
    c = table(s, d, "lineitem").groupBy((F.col("l_linenumber") - 1).alias("shell")).agg((F.avg("l_quantity") / 25.6).alias("snr"), F.round(F.avg("l_extendedprice"), 2).alias("res"))
    return P.resolution_by_snr(c, "shell", "snr", "res", 2.5)


# --- order, sets ---------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, least(o_orderkey // ((SELECT count(*) FROM orders) // 7), 6)::BIGINT AS split FROM orders")
def divide_into_parts(s, d):
    return T.split_rows(table(s, d, "orders").select("o_orderkey"), "o_orderkey", parts=7)


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey DESC) - 1 AS place FROM orders")
def numeric_sort(s, d):
    o = T.sort_rows(table(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", reverse=True)
    return T.number_rows(o, "place")


@query("SELECT name, row_number() OVER (ORDER BY split_part(name, '@', 2), s_suppkey) - 1 AS place FROM (SELECT printf('%06d@%s', s_suppkey, split_part(s_name, '#', 1) || s_nationkey) AS name, s_suppkey FROM supplier)")
def typed_sort(s, d):
    n = table(s, d, "supplier").select(strings.compose(F.col("s_suppkey"), F.concat(F.substring_index("s_name", "#", 1), F.col("s_nationkey"))).alias("name"), "s_suppkey")
    return T.number_rows(T.sort_rows(n, "name", "s_suppkey", part="after"), "place").select("name", "place")


_KEY = "('0x' || substr(md5({0}::VARCHAR || '{1}'), 1, 8))::BIGINT"


@query(f"SELECT o_orderkey, row_number() OVER (ORDER BY {_KEY.format('o_orderkey', 9)}, o_orderkey) - 1 AS place FROM orders")
def shuffled_rows(s, d):
    return T.number_rows(T.shuffle_rows(table(s, d, "orders").select("o_orderkey"), "o_orderkey", 9), "place")


@query("SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 40")
def maximum_images(s, d):
    return P.at_most(table(s, d, "customer"), 40, F.desc("c_acctbal"), "c_custkey").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ORDER BY o_orderkey LIMIT 25")
def do_at_most(s, d):
    done = table(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return P.at_most(T.unfinished(table(s, d, "orders").select("o_orderkey"), done, "o_orderkey"), 25, "o_orderkey")


@query(f"SELECT o_orderkey, half FROM (SELECT o_orderkey, o_custkey % 2 + 1 AS half, row_number() OVER (PARTITION BY o_custkey % 2 ORDER BY {_KEY.format('o_orderkey', 45)}, o_orderkey) AS n FROM orders) WHERE n <= 60")
def gradient_subset(s, d):
    o = table(s, d, "orders").select("o_orderkey", (F.col("o_custkey") % 2 + 1).alias("half"))
    return P.random_subset(o, "half", "o_orderkey", 60, 42, 3)


@query("""WITH c AS (SELECT p_brand AS class, count(*) AS n, min(p_size) AS res FROM part GROUP BY 1)
SELECT (SELECT class FROM c ORDER BY n DESC, class LIMIT 1) AS largest, (SELECT class FROM c ORDER BY res, n DESC, class LIMIT 1) AS finest""")
def best_classes(s, d):
    c = table(s, d, "part").groupBy(F.col("p_brand").alias("class")).agg(F.count("*").alias("n"), F.min("p_size").alias("res"))
    a, b = P.best_class(c, "class", "n", "res"), P.best_class(c, "class", "n", "res", by="resolution")
    return a.select(F.col("class").alias("largest")).crossJoin(F.broadcast(b.select(F.col("class").alias("finest"))))  # one row each


@query("SELECT name, n, row_number() OVER (ORDER BY l_returnflag, lpad(l_suppkey::VARCHAR, 6, '0'), l_linenumber::VARCHAR) - 1 AS place FROM (SELECT printf('%d@%s', l_linenumber, l_returnflag) AS name, l_suppkey, count(*) AS n, l_returnflag, l_linenumber FROM lineitem GROUP BY ALL)")
def sort_tubes(s, d):
    t = table(s, d, "lineitem").groupBy(F.concat_ws("@", "l_linenumber", "l_returnflag").alias("name"), "l_suppkey").agg(F.count("*").alias("n"))
    return T.number_rows(P.sort_tubes(t, "name", "l_suppkey"), "place").select("name", "n", "place")


@query("SELECT l_orderkey AS g, l_linenumber::BIGINT AS id FROM lineitem WHERE l_quantity > 45 UNION ALL SELECT o_orderkey + (SELECT max(l_orderkey) FROM lineitem) AS g, o_custkey AS id FROM orders WHERE o_totalprice > 300000")
def merge_renumbered(s, d):
    li, o = table(s, d, "lineitem"), table(s, d, "orders")
    one = li.where("l_quantity > 45").select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").cast("long").alias("id")), li.select(F.col("l_orderkey").alias("g")).distinct()
    two = o.where("o_totalprice > 300000").select(F.col("o_orderkey").alias("g"), F.col("o_custkey").alias("id")), o.select(F.col("o_orderkey").alias("g"))
    return P.merge_renumbered([one, two], "g")[0]


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 1")
def append_rows(s, d):
    n = table(s, d, "nation")
    return T.append_rows(n, n.where("n_regionkey = 1").select("n_regionkey", "n_name", "n_nationkey"))


@query("SELECT true AS same, false AS other")
def same_labels(s, d):
    n = table(s, d, "nation")
    return s.range(1).select(F.lit(T.same_labels(n, n.select("n_regionkey", "n_name", "n_nationkey"))).alias("same"), F.lit(T.same_labels(n, table(s, d, "region"))).alias("other"))


_PICKS = "(SELECT user_id AS img, round(value * 100) AS x, event_id % 50 AS y, event_type AS t FROM events)"


@query(f"""WITH e AS (SELECT DISTINCT img, x::DOUBLE AS x, y::DOUBLE AS y, t FROM {_PICKS}), a AS (SELECT img, x, y FROM e WHERE t = 'click'), b AS (SELECT DISTINCT img, x, y FROM e WHERE t = 'view')
SELECT img, x, y FROM a UNION ALL SELECT img, x, y FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.img = b.img AND abs(a.x - b.x) < 20 AND abs(a.y - b.y) < 20)""")
def combine_picks(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("img"), F.round(F.col("value") * 100).alias("x"), (F.col("event_id") % 50).cast("double").alias("y"), "event_type").distinct()
    a, b = (e.where(F.col("event_type") == t).select("img", "x", "y").distinct() for t in ("click", "view"))
    return K.combine_picks(a, b, "img", "x", "y", 20.0)


@query("""WITH o AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1), i AS (SELECT k, n, row_number() OVER (ORDER BY n DESC, k) - 1 AS i FROM o)
SELECT k, n, (CASE WHEN i // 4 % 2 = 0 THEN i % 4 ELSE 3 - i % 4 END)::INTEGER AS worker FROM i""")
def even_split(s, d):
    return G.even_split(table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n")), "k", "n", 4)


@query("""SELECT user_id, event_id, round(sum(s) OVER (PARTITION BY user_id ORDER BY event_id), 4) + 0.0 AS length FROM (SELECT user_id, event_id,
coalesce(sqrt(pow(value - lag(value) OVER w, 2) + pow(event_id - lag(event_id) OVER w, 2)), 0) AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))""")
def track_length(s, d):
    e = table(s, d, "events").select("user_id", "event_id", "value")
    return P.curve_length(e, ["user_id"], "event_id", "value", "event_id").select("user_id", "event_id", r("length").alias("length"))


@query("""WITH e AS (SELECT user_id AS tube, event_id::DOUBLE / 40 AS t, radians(value * 7) AS a, event_id FROM events)
SELECT x.event_id, round(degrees(atan2(sum(exp(-0.5 * pow((y.t - x.t) / 3, 2)) * sin(y.a)), sum(exp(-0.5 * pow((y.t - x.t) / 3, 2)) * cos(y.a)))), 3) + 0.0 AS smooth
FROM e x JOIN e y ON x.tube = y.tube AND y.t BETWEEN x.t - 9 AND x.t + 9 GROUP BY 1""")
def smooth_filament_angles(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("tube"), (F.col("event_id") / 40).alias("t"), (F.col("value") * 7).alias("a"), "event_id")
    return K.smooth_track_angles(e, ["tube"], "t", "a", 3.0).select("event_id", r("a_smooth", 3).alias("smooth"))


@query("SELECT l_orderkey, (count(*) FILTER (l_discount > 0.05) + 1) * 1.0 / (count(*) + 2) > 0.5 AS turn FROM lineitem GROUP BY 1")
def filament_polarity(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", (F.col("l_discount") > 0.05).alias("flipped"))
    return K.tube_polarity(li, ["l_orderkey"], "flipped")


@query("""WITH RECURSIVE e AS (SELECT user_id AS g, value AS x, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS i FROM (SELECT DISTINCT user_id, value, min(event_id) AS event_id FROM events GROUP BY 1, 2)),
f AS (SELECT g, i, x, [x] AS kept, true AS keep FROM e WHERE i = 1
UNION ALL SELECT e.g, e.i, e.x, CASE WHEN len(list_filter(f.kept, lambda k: abs(k - e.x) <= 2)) = 0 THEN list_append(f.kept, e.x) ELSE f.kept END, len(list_filter(f.kept, lambda k: abs(k - e.x) <= 2)) = 0 FROM f JOIN e ON e.g = f.g AND e.i = f.i + 1)
SELECT g, x FROM f WHERE keep""")
def prune_peaks(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("g"), F.col("value").alias("x"), F.lit(0.0).alias("y"), F.col("value").alias("score")).distinct()
    return W.prune_peaks(e, ["g"], "x", "y", "score", 2.0).select("g", "x")


_D2 = [[1, 0, 0], [0, 1, 0], [0, 0, 1]], [[-1, 0, 0], [0, -1, 0], [0, 0, 1]], [[1, 0, 0], [0, -1, 0], [0, 0, -1]], [[-1, 0, 0], [0, 1, 0], [0, 0, -1]]


@query(_MATRIX + """, g AS (SELECT * FROM (VALUES (0, 1, 1, 1), (1, -1, -1, 1), (2, 1, -1, -1), (3, -1, 1, -1)) t(mate, gx, gy, gz)),
p AS (SELECT p_partkey AS k, mate::INTEGER AS mate, m02 * gz AS q02, m12 * gz AS q12, m20 * gx AS q20, m21 * gy AS q21, m22 * gz AS q22 FROM m, g)
SELECT k, mate, round(degrees(atan2(sqrt(q02 * q02 + q12 * q12), q22)), 3) + 0.0 AS tilt, round(cos(atan2(q21, q20)), 3) + 0.0 AS rot, round(cos(atan2(q12, -q02)), 3) + 0.0 AS psi FROM p WHERE abs(q22) < 0.9999""")
def point_group_expand(s, d):
    e = P.expand_group(_oriented(s, d), _D2, ("rot", "tilt", "psi"))
    return e.where(F.abs(F.cos(F.radians("tilt"))) < 0.9999).select("k", "mate", r("tilt", 3).alias("tilt"), r(F.cos(F.radians("rot")), 3).alias("rot"), r(F.cos(F.radians("psi")), 3).alias("psi"))


@query("SELECT o_orderkey AS id, printf('%d@p%d', l_linenumber, o_orderkey) AS name, l_quantity AS defocus FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def pseudo_tomo_expand(s, d):
    p = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("tomo"), F.concat(F.lit("p"), "o_orderkey").alias("name"))
    t = table(s, d, "lineitem").select(F.col("l_orderkey").alias("tomo"), F.col("l_linenumber").alias("image"), F.col("l_quantity").alias("defocus"))
    return P.per_image_rows(p, t, "tomo", "name", "image", "defocus").select("id", "name", "defocus")


@query("""WITH p AS (SELECT s_suppkey AS k, i, 1 - (2 * i + 1) / 20.0 AS h, i * pi() * (3 - sqrt(5)) AS t, abs(s_acctbal) / 10 AS r FROM supplier, range(20) r(i))
SELECT k, i::INTEGER AS i, round(r * sqrt(1 - h * h) * cos(t), 3) + 0.0 AS px, round(r * sqrt(1 - h * h) * sin(t), 3) + 0.0 AS py, round(r * h, 3) + 0.0 AS pz, round(degrees(acos(h)), 4) AS tilt FROM p""")
def sphere_sampling(s, d):
    p = table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), (F.abs("s_acctbal") / 10).alias("r"))
    return X.sphere_points(p, "k", "x", "y", "z", "r", 20).select("k", "i", *[r(c, 3).alias(c) for c in ("px", "py", "pz")], F.round("tilt", 4).alias("tilt"))


@query("SELECT s_nationkey AS c, n::BIGINT AS n, round(n * 100.0, 3) + 0.0 AS x, 5.0 AS y FROM (SELECT s_nationkey, unnest(range(0, (2 * max(s_suppkey - s_suppkey) + 1000) // 100 + 1)) AS n FROM supplier GROUP BY 1)")
def curve_points(s, d):
    p = table(s, d, "supplier").select(F.col("s_nationkey").alias("c")).distinct().select("c", F.posexplode(F.array(F.lit(0.0), F.lit(1000.0))).alias("o", "x"), F.lit(5.0).alias("y"))
    return K.curve_points(p, ["c"], "o", "x", "y", 100.0).select("c", "n", r("x", 3).alias("x"), "y")


# --- scalar functions ----------------------------------------------------------------------------------------------


@query(r"""SELECT p_partkey AS k, replace(p_name, 'a', '') AS removed, regexp_replace(replace('a' || chr(9) || p_name || chr(7) || chr(10), chr(9), ' '), '[\x07\x08\x0a\x0b\x0c\x0d]', '', 'g') AS unescaped, replace('  ' || p_name || ' ', ' ', '') AS tight,
trim(regexp_replace('  ' || p_name || '   x ', '\s+', ' ', 'g')) AS simple FROM part""")
def string_clean(s, d):
    n = F.col("p_name")
    return table(s, d, "part").select(F.col("p_partkey").alias("k"), strings.without_char(n, "a").alias("removed"), strings.unescaped(F.concat(F.lit("a\t"), n, F.lit("\x07\n"))).alias("unescaped"), strings.without_spaces(F.concat(F.lit("  "), n, F.lit(" "))).alias("tight"), strings.simplify(F.concat(F.lit("  "), n, F.lit("   x "))).alias("simple"))


@query("SELECT page_id, string_split(url, '/')[3] AS host, string_split(url, '/')[9] AS none, try_cast(regexp_matches(page_id::VARCHAR, '^[0-9]+$') AS BOOLEAN) AS number, false AS text, lpad(page_id::VARCHAR, 8, '0') AS padded FROM pages")
def string_split_and_format(s, d):
    u = F.col("url")
    return table(s, d, "pages").select("page_id", strings.split_word(u, "/", 3).alias("host"), strings.split_word(u, "/", 9).alias("none"), strings.is_number(F.col("page_id").cast("string")).alias("number"), strings.is_number(u).alias("text"), strings.padded(F.col("page_id"), 8).alias("padded"))


@query("""SELECT p_partkey AS k, CASE WHEN p_size % 3 = 0 THEN '""' WHEN p_size % 3 = 1 THEN '"' || p_name || ' x"' ELSE p_brand END AS q FROM part""")
def star_quoting(s, d):
    v = F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, F.concat("p_name", F.lit(" x"))).otherwise(F.col("p_brand"))
    return table(s, d, "part").select(F.col("p_partkey").alias("k"), strings.star_quoted(v).alias("q"))


@query("""SELECT page_id, 'Class2D/' AS folder, printf('job%03d/', page_id) AS job, 'run_' || page_id || '.star' AS rest, '' AS none, 'run_' || page_id || '.star' AS plain FROM pages""")
def pipeline_names(s, d):
    p = table(s, d, "pages")
    name = F.concat(F.lit("Class2D/"), F.format_string("job%03d/", "page_id"), F.lit("run_"), "page_id", F.lit(".star"))
    a, b = strings.job_parts(name), strings.job_parts(F.concat(F.lit("run_"), "page_id", F.lit(".star")))
    return p.select("page_id", a[0].alias("folder"), a[1].alias("job"), a[2].alias("rest"), b[1].alias("none"), b[2].alias("plain"))


@query("""SELECT page_id AS k, 'a/b/im_' || page_id || '_x.mrc' AS inserted, 'a/b/im_' || page_id AS bare, 'a/b/im_' || page_id || '.star' AS changed, 'b/im_' || page_id || '.mrc' AS kept, 'half2_' || page_id AS half FROM pages""")
def file_name_parts(s, d):
    n = F.concat(F.lit("a/b/im_"), "page_id", F.lit(".mrc"))
    return table(s, d, "pages").select(F.col("page_id").alias("k"), strings.insert_before_extension(n, "_x").alias("inserted"), strings.without_extension(n).alias("bare"), strings.with_extension(n, "star").alias("changed"), strings.without_directories(n, 1).alias("kept"), strings.other_half(F.concat(F.lit("half1_"), "page_id")).alias("half"))


@query("""SELECT p_partkey AS k, round(sin(radians(p_size * 3.0)) * cos(radians(p_size * 7.0)), 6) + 0.0 AS x, round(sin(radians(p_size * 3.0)) * sin(radians(p_size * 7.0)), 6) + 0.0 AS y, round(cos(radians(p_size * 3.0)), 6) + 0.0 AS z, round(p_size * 3.0, 4) AS tilt FROM part WHERE p_size * 3 BETWEEN 1 AND 179""")
def direction_vectors(s, d):
    p = _oriented(s, d).where("tilt between 1 and 179")
    x, y, z = angles.direction(F.col("rot"), F.col("tilt"))
    return p.select("k", r(x, 6).alias("x"), r(y, 6).alias("y"), r(z, 6).alias("z"), F.round(angles.direction_angles(x, y, z)[1], 4).alias("tilt"))


@query(_MATRIX + "SELECT p_partkey AS k, round(cos(a), 4) + 0.0 AS rot, round(degrees(acos(cos(b))), 3) + 0.0 AS tilt, round(cos(g), 4) + 0.0 AS psi FROM m WHERE sin(b) > 0.01")
def matrix_to_angles(s, d):
    p = _oriented(s, d).where(F.sin(F.radians("tilt")) > 0.01)
    a = angles.matrix_angles(angles.euler_matrix(*(F.col(c) for c in ("rot", "tilt", "psi"))))
    return p.select("k", r(F.cos(F.radians(a[0])), 4).alias("rot"), r(a[1], 3).alias("tilt"), r(F.cos(F.radians(a[2])), 4).alias("psi"))


@query(_MATRIX + "SELECT p_partkey AS k, round(-m11, 6) + 0.0 AS m00, round(m10, 6) + 0.0 AS m01, round(m12 * -1, 6) + 0.0 AS m02, round(m21 * -1, 6) + 0.0 AS m20 FROM m")
def rotation_products(s, d):
    # left turns x into -y and y into x; right turns columns likewise
    m = angles.applied([[0, 1, 0], [-1, 0, 0], [0, 0, 1]], angles.euler_matrix(*(F.col(c) for c in ("rot", "tilt", "psi"))), [[0, 1, 0], [-1, 0, 0], [0, 0, 1]])
    return _oriented(s, d).select("k", r(m[0][0], 6).alias("m00"), r(m[0][1], 6).alias("m01"), r(-m[0][2], 6).alias("m02"), r(m[2][0], 6).alias("m20"))


_WAVE = "WITH p AS (SELECT p_partkey AS k, 10000.0 + p_size * 10 AS u, 9000.0 + p_size * 20 AS v, radians(p_size * 5.0) AS t, p_size / 300.0 AS x, p_size / 500.0 AS y, 12.2643247 / sqrt(300000.0 * (1 + 300000.0 * 0.978466e-6)) AS l FROM part), q AS (SELECT *, -(u * pow(cos(t), 2) + v * pow(sin(t), 2)) AS axx, -(u - v) * cos(t) * sin(t) AS axy, -(u * pow(sin(t), 2) + v * pow(cos(t), 2)) AS ayy, x * x + y * y AS r2 FROM p), g AS (SELECT *, pi() * l * (axx * x * x + 2 * axy * x * y + ayy * y * y) + pi() / 2 * 2.7e7 * pow(l, 3) * r2 * r2 - radians(30.0) - atan(0.1 / sqrt(0.99)) AS g FROM q) "


def _waves(s, d):
    k = F.col("p_size")
    return table(s, d, "part").select(F.col("p_partkey").alias("k"), (k / 300.0).alias("x"), (k / 500.0).alias("y"), (k * 10 + 10000.0).alias("u"), (k * 20 + 9000.0).alias("v"), (k * 5.0).alias("angle"))


def _wave_args():
    return [F.col(c) for c in ("x", "y", "u", "v", "angle")] + [F.lit(300.0), F.lit(2.7)]


@query(_WAVE + "SELECT k, round(-sin(g) * exp(-20.0 / 4 * r2), 5) + 0.0 AS ctf, round(l, 8) AS wavelength, round(g, 4) + 0.0 AS phase FROM g")
def ctf_with_astigmatism(s, d):
    v = ctf_.ctf(*_wave_args(), F.lit(0.1), b_factor=F.lit(20.0), shift=F.lit(30.0))
    return _waves(s, d).select("k", r(v, 5).alias("ctf"), F.round(ctf_.wavelength(F.lit(300.0)), 8).alias("wavelength"), r(ctf_.phase(*_wave_args(), F.lit(0.1), F.lit(30.0)), 4).alias("phase"))


@query(_WAVE + "SELECT k, round(-sin(g), 5) + 0.0 AS re, round(-cos(g), 5) + 0.0 AS im FROM g")
def ctf_complex(s, d):
    re, im = ctf_.ctf_complex(*_wave_args(), F.lit(0.1), shift=F.lit(30.0), positive=False)
    return _waves(s, d).select("k", r(re, 5).alias("re"), r(im, 5).alias("im"))


@query(_WAVE + "SELECT k, round(2 * pi() * l * (axx * x + axy * y) + 4 * pi() / 2 * 2.7e7 * pow(l, 3) * r2 * x, 3) + 0.0 AS gx, round(2 * pi() * l * (ayy * y + axy * x) + 4 * pi() / 2 * 2.7e7 * pow(l, 3) * r2 * y, 3) + 0.0 AS gy FROM g")
def ctf_phase_gradient(s, d):
    gx, gy = ctf_.phase_gradient(*_wave_args())
    return _waves(s, d).select("k", r(gx, 3).alias("gx"), r(gy, 3).alias("gy"))


@query("""WITH f AS (SELECT user_id AS m, event_id, event_id % 7 * 1.5 AS dose, k FROM events, (VALUES (0.05), (0.2)) t(k)), w AS (SELECT m, event_id, k, exp(-dose / (2 * (0.245 * pow(k, -1.665) + 2.81))) AS w FROM f)
SELECT m, event_id, k::DOUBLE AS k, round(w / sqrt(sum(w * w) OVER (PARTITION BY m, k)), 7) AS weight FROM w""")
def dose_weights(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("m"), "event_id", (F.col("event_id") % 7 * 1.5).alias("dose"), F.explode(F.array(F.lit(0.05), F.lit(0.2))).alias("k"))
    return ctf_.frame_weights(e, ["m"], "k", "dose").select("m", "event_id", "k", F.round("weight", 7).alias("weight"))


@query("SELECT c_custkey AS k, round(64 * (1.1 + n_regionkey * 0.2) / (c_nationkey + 5), 6) AS shell, round(64 * (1.1 + n_regionkey * 0.2) / (64 * (1.1 + n_regionkey * 0.2) / (c_nationkey + 5)), 4) AS back FROM customer JOIN nation ON c_nationkey = n_nationkey")
def unit_conversion(s, d):
    c = J.lookup(table(s, d, "customer").select("c_custkey", F.col("c_nationkey").alias("g")), table(s, d, "nation").select(F.col("n_nationkey").alias("g"), (F.col("n_regionkey") * 0.2 + 1.1).alias("pixel")), "g")
    shell = ctf_.in_pixels(F.col("g") + 5, F.lit(64), F.col("pixel"))
    return c.select(F.col("c_custkey").alias("k"), F.round(shell, 6).alias("shell"), F.round(ctf_.in_pixels(shell, F.lit(64), F.col("pixel")), 4).alias("back"))


@query("""SELECT p_partkey AS k, round(exp(-pow((p_size - 20) / 7.0, 2) / 2) / (7 * sqrt(2 * pi())), 8) AS normal, round(exp(lgamma(3.0) - lgamma(2.5)) / (2 * sqrt(pi() * 5)) * pow(1 + pow((p_size - 20) / 2.0, 2) / 5, -3), 8) AS student FROM part""")
def distributions(s, d):
    x = F.col("p_size").cast("double")
    return table(s, d, "part").select(F.col("p_partkey").alias("k"), F.round(stats.gaussian(x, 7.0, 20.0), 8).alias("normal"), F.round(stats.student(x, 5.0, 2.0, 20.0), 8).alias("student"))


@query("SELECT p_partkey AS k, round(lgamma(p_size + 0.5), 6) + 0.0 AS lg FROM part")
def log_gamma(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("k"), r(stats.log_gamma(F.col("p_size") + 0.5), 6).alias("lg"))


@query("""WITH p AS (SELECT p_partkey AS k, p_size / 51.0 AS rho, radians(p_size * 9.0) AS phi FROM part)
SELECT k, round((3 * pow(rho, 3) - 2 * rho) * cos(phi), 6) + 0.0 AS z31, round((6 * pow(rho, 4) - 6 * rho * rho + 1), 6) + 0.0 AS z40, round(rho * rho * sin(2 * phi), 6) + 0.0 AS z22 FROM p""")
def zernike(s, d):
    rho, phi = F.col("p_size") / 51.0, F.radians(F.col("p_size") * 9.0)
    return table(s, d, "part").select(F.col("p_partkey").alias("k"), *[r(stats.zernike(n, m, rho, phi), 6).alias(c) for c, n, m in (("z31", 3, 1), ("z40", 4, 0), ("z22", 2, -2))])


# --- spectra, tomography, sampling -----------------------------------------------------------------------------------


@query("""WITH c AS (SELECT l_linenumber AS shell, avg(l_discount) * 10 + 0.3 - 0.05 * l_linenumber AS f FROM lineitem GROUP BY 1), k AS (SELECT shell, greatest(0.001, least(0.999, f)) AS f FROM c)
SELECT shell, round(f / (1 - f), 5) AS half, round(sqrt(2 * f / (1 + f)) / (1 - sqrt(2 * f / (1 + f))), 4) AS whole FROM k""")
def ssnr(s, d):
    c = table(s, d, "lineitem").groupBy(F.col("l_linenumber").alias("shell")).agg(F.avg("l_discount").alias("m")).withColumn("f", F.col("m") * 10 + 0.3 - 0.05 * F.col("shell"))
    return c.select("shell", F.round(V.ssnr(F.col("f")), 5).alias("half"), F.round(V.ssnr(F.col("f"), True), 4).alias("whole"))


@query("""SELECT round(regr_slope(y, x), 5) AS slope, round(regr_intercept(y, x), 5) AS intercept, round(4 * regr_slope(y, x), 5) AS b_factor FROM (SELECT 1.0 / (res * res) AS x, y FROM (SELECT 3.0 + p_size / 4.0 AS res, ln(p_retailprice) AS y FROM part) WHERE res BETWEEN 4 AND 12)""")
def guinier_fit(s, d):
    p = table(s, d, "part").select((F.col("p_size") / 4.0 + 3.0).alias("res"), F.log("p_retailprice").alias("y"))
    return V.guinier_fit(p, "res", "y", 4.0, 12.0).select(*[F.round(c, 5).alias(c) for c in ("slope", "intercept", "b_factor")])


@query("""SELECT id::BIGINT AS id, round(degrees(acos(1 - (2 * (id // 6) + 1) / 500.0)), 4) AS tilt, (id % 6 * 60.0)::DOUBLE AS psi, round(cos(radians(id // 6 * 180 * (3 - sqrt(5)))), 4) + 0.0 AS rot FROM range(3000) r(id)""")
def orientation_grid(s, d):
    return V.orientations(s, 500, 60.0).select("id", F.round("tilt", 4).alias("tilt"), F.col("psi").cast("double").alias("psi"), r(F.cos(F.radians("rot")), 4).alias("rot"))


@query("SELECT a * 0.5 AS dx, b * 0.5 AS dy FROM (SELECT i::DOUBLE AS a FROM range(-6, 7) r(i)), (SELECT i::DOUBLE AS b FROM range(-6, 7) r(i)) WHERE a * a * 0.25 + b * b * 0.25 <= 9")
def translation_grid(s, d):
    return V.translations(s, 3.0, 0.5)


@query("""SELECT p.c_custkey AS id, t.l AS tilt, round(cos(radians(t.l * 10.0)) * (c_acctbal - 100) + sin(radians(t.l * 10.0)) * (c_nationkey - 30) + 50, 3) + 0.0 AS ix, round(c_custkey % 97 - 100 + 60, 3) + 0.0 AS iy FROM customer p, range(7) t(l)""")
def tilt_projections(s, d):
    p = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("t").alias("tomo"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 97).cast("double").alias("y"), F.col("c_nationkey").cast("double").alias("z"))
    rows = [("t", k, [float(v) for v in G.projection(10.0 * k, 0.0, 0.0, (0.0, 0.0), (100.0, 100.0, 30.0), (50.0, 60.0)).ravel()]) for k in range(7)]
    t = s.createDataFrame(rows, "tomo string, tilt long, matrix array<double>")
    return G.per_tilt(p, t, "tomo").select("id", "tilt", r("image_x", 3).alias("ix"), r("image_y", 3).alias("iy"))


@query("""WITH t AS (SELECT c_nationkey AS tomo, row_number() OVER (ORDER BY c_nationkey)::INTEGER AS g FROM (SELECT DISTINCT c_nationkey FROM customer)) SELECT c_custkey AS id, g FROM customer JOIN t ON c_nationkey = tomo""")
def optics_per_tomogram(s, d):
    p = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("tomo"), F.lit(1).alias("g"))
    o = s.createDataFrame([(1, "one", 1.5)], "g int, name string, pixel double")
    return G.split_optics(p, o, "tomo", "g", "name")[0].select("id", "g")
