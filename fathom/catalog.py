"""Queries of the engine's own operators on the driver tables, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import angles, strings
from .functions import ctf as ctf_
from .operators import aggregates as A
from .operators import expand as X
from .operators import joins as J
from .operators import sequences as W
from .operators import table as T

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected lines joined with their group and counted, as a histogram's groups are."""
    return optics_group_counts(spark, sf_dir)


# --- projection and filters ----------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20")
def range_select(s, d):
    return T.range_select(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", 10, 20)


@query("SELECT p_partkey, p_type FROM part WHERE contains(p_type, 'E')")
def substr_select(s, d):
    return T.substring_select(table(s, d, "part").select("p_partkey", "p_type"), "p_type", include="E")


@query("SELECT p_partkey, p_type FROM part WHERE NOT contains(p_type, 'E')")
def substr_exclude(s, d):
    return T.substring_select(table(s, d, "part").select("p_partkey", "p_type"), "p_type", exclude="E")


@query("""WITH p AS (SELECT l_partkey, round(avg(l_quantity), 6) AS m, round(stddev_pop(l_quantity), 6) AS sd FROM lineitem GROUP BY 1),
e AS (SELECT avg(m) m1, stddev_pop(m) s1, avg(sd) m2, stddev_pop(sd) s2 FROM p)
SELECT l_partkey, m, sd FROM p, e WHERE abs(m - m1) < 2 * s1 AND abs(sd - m2) < 2 * s2""")
def sigma_clip_by_part(s, d):
    p = table(s, d, "lineitem").groupBy("l_partkey").agg(F.round(F.avg("l_quantity"), 6).alias("m"), F.round(F.stddev_pop("l_quantity"), 6).alias("sd"))
    return T.sigma_clip(p, "m", "sd", 2.0)


@query("SELECT o_orderkey, round(o_totalprice * 2 + 1, 4) AS o_totalprice FROM orders")
def affine_column(s, d):
    out = T.operate(table(s, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], 2.0, 1.0)
    return out.withColumn("o_totalprice", F.round("o_totalprice", 4))


@query("SELECT p_partkey, trunc(p_size * 1.5 + 0.25)::INTEGER AS p_size FROM part")
def affine_whole_column(s, d):
    return T.operate(table(s, d, "part").select("p_partkey", "p_size"), ["p_size"], 1.5, 0.25)


@query("SELECT o_orderkey, 'P' AS o_orderstatus FROM orders")
def set_column(s, d):
    return T.operate(table(s, d, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"], set_to="P")


@query("SELECT o_orderkey, o_custkey, o_orderpriority AS copied, 7::BIGINT AS fixed FROM orders")
def add_and_copy_columns(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    o = T.add_column(T.add_column(o, "copied", "string", copy_from="o_orderpriority"), "fixed", "long", value=7)
    return T.remove_columns(o, "o_orderpriority")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount > 0.02 AND l_discount < 0.07 AND l_tax > 0.01 AND l_tax < 0.05")
def open_range_quality(s, d):
    return T.open_ranges(table(s, d, "lineitem"), {"l_discount": (0.02, 0.07), "l_tax": (0.01, 0.05), "absent": (0, 1)}).select("l_orderkey", "l_linenumber")


@query("""SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, abs(l_quantity * 7 % 360 - l_partkey % 360) AS e FROM lineitem)
WHERE CASE WHEN e > 180 THEN abs(e - 360) ELSE e END < 15""")
def psi_deviation(s, d):
    a = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 7 % 360).alias("psi"), (F.col("l_partkey") % 360).cast("double").alias("prior"))
    return T.psi_deviation(a, "psi", "prior", 15.0).select("l_orderkey", "l_linenumber")


@query("SELECT s_suppkey FROM supplier WHERE abs(s_acctbal / 100 - 90) < 40")
def tilt_deviation(s, d):
    return T.tilt_deviation(table(s, d, "supplier").select("s_suppkey", (F.col("s_acctbal") / 100).alias("tilt")), "tilt", 40.0).select("s_suppkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def unfinished_inputs(s, d):
    done = table(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return T.unfinished(table(s, d, "orders").select("o_orderkey"), done, "o_orderkey")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal BETWEEN 0.9 * (SELECT max(c_acctbal) FROM customer) AND (SELECT max(c_acctbal) FROM customer)")
def relative_score_select(s, d):
    return T.relative_score_select(table(s, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 0.9)


# --- joins -----------------------------------------------------------------------------------------------------


def _compared(s, d):
    a = table(s, d, "orders").where("o_orderpriority like '1%'").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("rid"))
    b = table(s, d, "orders").where("o_orderpriority like '2%'").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("rid"))
    return J.compare(a, b, "k")


_AB = "WITH a AS (SELECT o_custkey AS k, o_orderkey AS rid FROM orders WHERE o_orderpriority LIKE '1%'), b AS (SELECT o_custkey AS k, o_orderkey AS rid FROM orders WHERE o_orderpriority LIKE '2%') "


@query(_AB + "SELECT k, rid FROM a WHERE k IN (SELECT k FROM b)")
def compare_keys_both(s, d):
    return _compared(s, d)[0]


@query(_AB + "SELECT k, rid FROM a WHERE k NOT IN (SELECT k FROM b)")
def compare_keys_only1(s, d):
    return _compared(s, d)[1]


@query(_AB + "SELECT k, rid FROM b WHERE rid NOT IN (SELECT min(rid) FROM b WHERE k IN (SELECT k FROM a) GROUP BY k)")
def compare_keys_only2(s, d):
    return _compared(s, d)[2].select("k", "rid")


@query("""SELECT c_custkey AS a_rid, arg_min(s_suppkey, s_suppkey) AS b_rid FROM customer, supplier WHERE abs(c_acctbal - s_acctbal) <= 5 GROUP BY 1""")
def compare_numeric_eps(s, d):
    a = table(s, d, "customer").select(F.col("c_custkey").alias("rid"), F.col("c_acctbal").alias("v"))
    b = table(s, d, "supplier").select(F.col("s_suppkey").alias("rid"), F.col("s_acctbal").alias("v"))
    return J.first_match(J.band_pairs(a, b, [("v", "v")], 5.0)).select("a_rid", "b_rid")


@query("""SELECT a.c_custkey AS a_rid, min(s_suppkey) AS b_rid FROM customer a, supplier WHERE c_nationkey = s_nationkey
AND pow(c_acctbal - s_acctbal, 2) + pow(c_custkey - s_suppkey, 2) <= 250000 GROUP BY 1""")
def compare_distance_2d(s, d):
    a = table(s, d, "customer").select(F.col("c_custkey").alias("rid"), F.col("c_acctbal").alias("v"), F.col("c_custkey").cast("double").alias("w"), F.col("c_nationkey").alias("n"))
    b = table(s, d, "supplier").select(F.col("s_suppkey").alias("rid"), F.col("s_acctbal").alias("v"), F.col("s_suppkey").cast("double").alias("w"), F.col("s_nationkey").alias("n"))
    return J.first_match(J.band_pairs(a, b, [("v", "v"), ("w", "w")], 500.0, ["n"])).select("a_rid", "b_rid")


@query("""SELECT a_rid, min(b) AS b_rid FROM (SELECT c_custkey AS a_rid, s_suppkey AS b FROM customer, supplier WHERE c_nationkey = s_nationkey AND abs(c_acctbal - s_acctbal) <= 200)
GROUP BY 1 HAVING count(*) = 1""")
def particle_select(s, d):
    a = table(s, d, "customer").select(F.col("c_custkey").alias("rid"), F.col("c_acctbal").alias("v"), F.col("c_nationkey").alias("n"))
    b = table(s, d, "supplier").select(F.col("s_suppkey").alias("rid"), F.col("s_acctbal").alias("v"), F.col("s_nationkey").alias("n"))
    return J.unique_matches(J.band_pairs(a, b, [("v", "v")], 200.0, ["n"])).select("a_rid", "b_rid")


@query("""SELECT s_suppkey AS b_rid, arg_min(c_custkey, struct_pack(x := abs(c_acctbal - s_acctbal), y := c_custkey)) AS a_rid FROM customer, supplier WHERE abs(c_acctbal - s_acctbal) <= 50 GROUP BY 1""")
def nearest_match(s, d):
    a = table(s, d, "customer").select(F.col("c_custkey").alias("rid"), F.col("c_acctbal").alias("v"))
    b = table(s, d, "supplier").select(F.col("s_suppkey").alias("rid"), F.col("s_acctbal").alias("v"))
    return J.nearest_within(a, b, ("v", "v"), 50.0).select("b_rid", "a_rid")


@query("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal BETWEEN 0 AND 5000 GROUP BY 1")
def optics_group_counts(s, d):
    rows = T.range_select(table(s, d, "customer"), "c_acctbal", 0, 5000).select(F.col("c_nationkey").alias("n_nationkey"))
    return A.group_sizes(J.lookup(rows, table(s, d, "nation").select("n_nationkey", "n_name"), "n_nationkey"), "n_name")


@query("SELECT DISTINCT c_nationkey AS g FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def undefined_groups(s, d):
    return J.undefined_groups(table(s, d, "customer").select(F.col("c_nationkey").alias("g")), table(s, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("g")), "g")


@query("SELECT c_custkey AS k, coalesce(x.score, -999.0) AS score FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS score FROM orders GROUP BY 1) x ON o_custkey = c_custkey")
def score_lookup(s, d):
    best = table(s, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("score"))
    return J.score_lookup(table(s, d, "customer").select(F.col("c_custkey").alias("k")), best, "k", "score")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def selected_class_members(s, d):
    chosen = table(s, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(s, d, "orders").join(chosen, "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey AS rid, c_acctbal, s_acctbal FROM customer JOIN supplier ON c_custkey = s_suppkey")
def positional_join(s, d):
    return J.positional(table(s, d, "customer").select(F.col("c_custkey").alias("rid"), "c_acctbal"), table(s, d, "supplier").select(F.col("s_suppkey").alias("rid"), "s_acctbal"))


# --- aggregates ------------------------------------------------------------------------------------------------


@query("SELECT max(l_quantity) AS max, min(l_quantity) AS min, round(avg(l_quantity), 6) AS avg FROM lineitem")
def column_stats(s, d):
    return A.column_stats(table(s, d, "lineitem"), "l_quantity").withColumn("avg", F.round("avg", 6))


@query("SELECT arg_max(o_orderkey, struct_pack(a := o_totalprice, b := -o_orderkey)) AS max_row, arg_min(o_orderkey, struct_pack(a := o_totalprice, b := o_orderkey)) AS min_row FROM orders")
def extreme_rows(s, d):
    return A.extreme_rows(table(s, d, "orders"), "o_totalprice", "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1 OFFSET 4")
def sorted_pick(s, d):
    return A.sorted_pick(table(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 5, "o_orderkey")


@query("""WITH b AS (SELECT min(l_extendedprice) lo, max(l_extendedprice) hi FROM lineitem)
SELECT greatest(0, least(41, trunc((l_extendedprice - lo) / ((hi - lo) / 40))::BIGINT + 1))::BIGINT AS bin, count(*) AS count FROM lineitem, b GROUP BY 1""")
def histogram_bins(s, d):
    return A.histogram(table(s, d, "lineitem"), "l_extendedprice", bins=40)


@query("""WITH v AS (SELECT l_extendedprice AS x, row_number() OVER (ORDER BY l_extendedprice) - 1 AS i, count(*) OVER () AS n FROM lineitem),
q AS (SELECT max(n) AS n, min(x) AS lo, max(x) AS hi, max(x) FILTER (i = n // 2) AS q2, max(x) FILTER (i = 3 * n // 4) AS q3 FROM v),
w AS (SELECT lo, hi, least(ceil((hi - lo) / (2 * (q3 - q2) / pow(n, 1.0 / 3))), 5000) AS b FROM q)
SELECT greatest(0, least(b + 1, trunc((x - lo) / ((hi - lo) / b)) + 1))::BIGINT AS bin, count(*) AS count FROM v, w GROUP BY 1""")
def histogram_fd(s, d):
    return A.histogram(table(s, d, "lineitem"), "l_extendedprice")


@query("""SELECT l_returnflag, round(sum(l_quantity), 4) AS sum, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS sigma,
round(avg(pow(l_quantity - m, 3)) / pow(stddev_pop(l_quantity), 3), 4) AS skew, round(kurtosis_pop(l_quantity) + 3, 4) AS kurtosis
FROM lineitem JOIN (SELECT l_returnflag, avg(l_quantity) AS m FROM lineitem GROUP BY 1) USING (l_returnflag) GROUP BY 1""")
def moments(s, d):
    m = A.moments(table(s, d, "lineitem"), "l_quantity", "l_returnflag")
    return m.select("l_returnflag", F.round("sum", 4).alias("sum"), *[F.round(c, k).alias(c) for c, k in (("mean", 6), ("sigma", 6), ("skew", 4), ("kurtosis", 4))])


@query("""SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem""")
def line_fit(s, d):
    r = A.line_fit(table(s, d, "lineitem"), "l_quantity", "l_extendedprice", F.lit(1.0))
    return r.select(F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"), F.round("r2", 6).alias("r2"))


@query("""WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings)
SELECT a.i::INTEGER AS i, b.i::INTEGER AS j, round(covar_pop(a.x, b.x), 6) AS cov FROM v a JOIN v b USING (vec_id) WHERE b.i >= a.i GROUP BY 1, 2""")
def covariance_whole(s, d):
    return A.covariance(table(s, d, "embeddings"), "embedding").select("i", "j", (F.signum("cov") * F.round(F.abs("cov"), 6)).alias("cov"))  # zeros keep their sign


@query("""WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings)
SELECT round(sqrt(pow(i // 8, 2) + pow(i % 8, 2)))::BIGINT AS shell, round(avg(x), 6) AS mean, count(*) AS n FROM v GROUP BY 1""")
def shell_average(s, d):
    v = table(s, d, "embeddings").select(F.posexplode("embedding").alias("i", "x")).select(F.expr("i div 8").alias("a"), F.expr("i % 8").alias("b"), F.col("x").cast("double").alias("x"))
    r = A.shell_average(v, "x", "a", "b")
    return r.select("shell", F.round("mean", 6).alias("mean"), "n")


@query("""WITH v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings),
m AS (SELECT i, avg(x) FILTER (label % 2 = 0) AS a, avg(x) FILTER (label % 2 = 1) AS b FROM v GROUP BY i)
SELECT (i // 8)::BIGINT AS shell, round(sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 6) AS fsc FROM m GROUP BY 1""")
def shell_correlation(s, d):
    v = table(s, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    m = v.groupBy("i").agg(F.avg(F.when(F.col("label") % 2 == 0, F.col("x").cast("double"))).alias("a"), F.avg(F.when(F.col("label") % 2 == 1, F.col("x").cast("double"))).alias("b"))
    m = m.select(F.expr("i div 8").alias("shell"), "a", "b", F.lit(0.0).alias("z"))
    return A.shell_correlation(m, "shell", ("a", "z"), ("b", "z")).select("shell", F.round("fsc", 6).alias("fsc"))


@query("""SELECT (coalesce(min(x) FILTER (v < 0.5), max(x) + 1) - 1)::BIGINT AS last_shell FROM (SELECT l_linenumber AS x, avg(l_discount) * 10 + 0.02 * (4 - l_linenumber) AS v FROM lineitem GROUP BY 1)""")
def resolution_shell(s, d):
    c = table(s, d, "lineitem").groupBy(F.col("l_linenumber").alias("x")).agg(F.avg("l_discount").alias("m")).select("x", (F.col("m") * 10 + 0.02 * (4 - F.col("x"))).alias("v"))
    return A.first_below(c, "x", "v", 0.5)


@query("""WITH n AS (SELECT l_orderkey, l_returnflag, count(*) AS v FROM lineitem GROUP BY 1, 2),
b AS (SELECT l_orderkey, sum(v) AS total, max(v) AS votes FROM n GROUP BY 1), w AS (SELECT l_orderkey, min(l_returnflag) AS g FROM n JOIN b USING (l_orderkey) WHERE v = votes GROUP BY 1)
SELECT l_orderkey, CASE WHEN votes / total >= 0.6 THEN g ELSE 'rest' END AS vote, votes FROM b JOIN w USING (l_orderkey)""")
def vote_groups(s, d):
    return A.vote(table(s, d, "lineitem"), ["l_orderkey"], "l_returnflag", 0.6)


@query("""SELECT p_partkey, round(CASE p_size % 7 WHEN 1 THEN (0.75 + w) * 0.5 WHEN 2 THEN (0.25 + w) * 0.5 WHEN 3 THEN w * 0.5 WHEN 4 THEN w * 0.5 WHEN 5 THEN (0.5 + w) * 0.5 ELSE 0 END, 8) AS score
FROM (SELECT p_partkey, p_size, pow(1.0 / p_size, 2) / 4 AS w FROM part)""")
def class_score(s, d):
    p = table(s, d, "part")
    return p.select("p_partkey", F.round(A.class_score(F.col("p_size") % 7, F.lit(0.5), F.col("p_size").cast("double"), F.lit(1.0)), 8).alias("score"))


@query("SELECT user_id, (event_id // 10)::BIGINT AS bin, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def frame_average(s, d):
    return A.frame_average(table(s, d, "events"), "event_id", 10, "value", "user_id").withColumn("mean", F.round("mean", 6))


@query("SELECT round(sum(p_size * p_retailprice) / sum(p_retailprice), 6) AS com_p_size FROM part WHERE p_retailprice > 0")
def centre_of_mass(s, d):
    return A.centre_of_mass(table(s, d, "part"), "p_retailprice", "p_size").select(F.round("com_p_size", 6).alias("com_p_size"))


# --- order -----------------------------------------------------------------------------------------------------


@query("""SELECT event_id FROM events a WHERE NOT EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_id > a.event_id AND abs(a.value - b.value) <= 1.5)""")
def dedup_within_group(s, d):
    e = table(s, d, "events").select("event_id", "user_id", "value")
    return W.remove_near(e, ["user_id"], ["value"], 1.5, "event_id").select("event_id")


@query("""SELECT event_id FROM events a WHERE NOT EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_id <> a.event_id AND abs(a.value - b.value) <= 1.5)""")
def too_close(s, d):
    e = table(s, d, "events").select("event_id", "user_id", "value")
    return W.too_close(e, ["user_id"], ["value"], 1.5, "event_id").select("event_id")


@query("SELECT c_name AS key, count(*) AS n FROM (SELECT c_name FROM customer UNION ALL SELECT c_name FROM customer WHERE c_nationkey = 3) GROUP BY 1 HAVING count(*) > 1")
def duplicate_check(s, d):
    c = table(s, d, "customer")
    return W.duplicate_keys(c.select(F.col("c_name").alias("key")).unionByName(c.where("c_nationkey = 3").select(F.col("c_name").alias("key"))), "key")


@query("""WITH RECURSIVE g AS (SELECT s_nationkey AS o, s_suppkey AS k, trunc(s_acctbal / 100)::DOUBLE AS v, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i FROM supplier WHERE s_acctbal > 0),
f AS (SELECT o, k, i, CASE WHEN v > 150 THEN 0.0 ELSE v END AS acc, CASE WHEN v > 150 THEN 1 ELSE 0 END AS gid FROM g WHERE i = 1
UNION ALL SELECT g.o, g.k, g.i, CASE WHEN acc + v > 150 THEN 0.0 ELSE acc + v END, CASE WHEN acc + v > 150 THEN gid + 1 ELSE gid END FROM f JOIN g ON g.o = f.o AND g.i = f.i + 1)
SELECT o, k, gid::BIGINT AS gid FROM f""")
def regroup_by_scale(s, d):
    g = table(s, d, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("o"), F.col("s_suppkey").alias("k"), F.expr("double(int(s_acctbal / 100))").alias("v"))
    return W.regroup(g, "o", ["k"], "v", 150.0, "gid").select("o", "k", "gid")


_KEY = "('0x' || substr(md5({0}::VARCHAR || '{1}'), 1, 8))::BIGINT"


@query(f"SELECT o_orderkey, ({_KEY.format('o_orderkey', 42)} % 2 + 1)::INTEGER AS half FROM orders")
def half_split_hash(s, d):
    return W.random_halves(table(s, d, "orders").select("o_orderkey"), "o_orderkey", 42)


@query(f"""WITH RECURSIVE g AS (SELECT c_nationkey AS k, count(*) AS n, row_number() OVER (ORDER BY {_KEY.format('c_nationkey', 7)}, c_nationkey) AS i FROM customer GROUP BY 1),
f AS (SELECT k, n, i, 0::BIGINT AS n1, n::BIGINT AS n2, 2 AS half FROM g WHERE i = 1
UNION ALL SELECT g.k, g.n, g.i, CASE WHEN n1 < n2 THEN n1 + g.n ELSE n1 END, CASE WHEN n1 < n2 THEN n2 ELSE n2 + g.n END, CASE WHEN n1 < n2 THEN 1 ELSE 2 END FROM f JOIN g ON g.i = f.i + 1)
SELECT k, n, half::INTEGER AS half FROM f""")
def half_split_balanced(s, d):
    g = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))
    return W.balanced_halves(g, "k", "n", 7)


@query("SELECT event_id, round(coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS dose FROM events")
def cumulative_dose(s, d):
    e = table(s, d, "events").select("event_id", "user_id", "ts", "value")
    return W.cumulative_dose(e, "user_id", ["ts", "event_id"], F.col("value"), before=True).select("event_id", F.round("dose", 4).alias("dose"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) - 1 AS \"order\" FROM events")
def dose_order(s, d):
    return W.dose_order(table(s, d, "events"), "user_id", "value", "event_id").select("event_id", "order")


def _weights(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 10000).alias("diff2"), F.log(F.col("l_quantity")).alias("prior"))
    return W.softmax_weights(li, "l_orderkey", "diff2", F.col("prior")).withColumn("weight", F.round("weight", 8))


_WEIGHT = """WITH e AS (SELECT l_orderkey, l_linenumber, ln(l_quantity) + min(l_extendedprice / 10000) OVER (PARTITION BY l_orderkey) - l_extendedprice / 10000 AS e FROM lineitem),
w AS (SELECT l_orderkey, l_linenumber, round(CASE WHEN e < -700 THEN 0 ELSE exp(e) END, 8) AS weight FROM e) """


@query(_WEIGHT + "SELECT l_orderkey, l_linenumber, weight FROM w")
def softmax_weights(s, d):
    return _weights(s, d).select("l_orderkey", "l_linenumber", "weight")


@query(_WEIGHT + """, c AS (SELECT *, sum(weight) OVER (PARTITION BY l_orderkey ORDER BY weight, l_linenumber ROWS UNBOUNDED PRECEDING) AS c, sum(weight) OVER (PARTITION BY l_orderkey) AS t FROM w WHERE weight > 0),
k AS (SELECT l_orderkey, min(weight) AS cut FROM c WHERE c > 0.2 * t GROUP BY 1)
SELECT l_orderkey, l_linenumber, weight >= cut AS significant FROM w JOIN k USING (l_orderkey) WHERE weight > 0""")
def significant_samples(s, d):
    return W.significant_samples(_weights(s, d), "l_orderkey", "weight", 0.8, order="l_linenumber").select("l_orderkey", "l_linenumber", "significant")


@query(_WEIGHT + "SELECT l_orderkey, arg_max(l_linenumber, struct_pack(a := weight, b := -l_linenumber)) AS l_linenumber, round(max(weight) / sum(weight), 5) AS p_max FROM w GROUP BY 1")
def best_sample(s, d):
    return W.best_sample(_weights(s, d), "l_orderkey", "weight", "l_linenumber").withColumn("p_max", F.round("p_max", 5))


@query("SELECT o_orderkey, (o_orderkey // 1000)::BIGINT AS split FROM orders WHERE o_orderkey // 1000 < 5")
def split_by_size(s, d):
    return T.split_rows(table(s, d, "orders").select("o_orderkey"), "o_orderkey", size=1000, parts=5)


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS rid FROM orders")
def sorted_index(s, d):
    return T.with_row_id(table(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey").select("o_orderkey", "rid")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n <= 3")
def topk_per_group(s, d):
    return T.cap_each(table(s, d, "lineitem"), "l_suppkey", 3, F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("""WITH c AS (SELECT n_nationkey AS k, count(*) AS n, round(avg(c_acctbal), 6) AS score FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
o AS (SELECT k, n, score, coalesce(sum(n) OVER (ORDER BY (score > 4700)::INT DESC, score DESC, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM c)
SELECT k, n, score FROM o WHERE score > 4700 OR b < 600""")
def top_up_selection(s, d):
    c = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 6).alias("score"))
    return T.top_up(c, F.col("score") > 4700, "score", "n", 600, "k")


# --- combination, expansion, functions -----------------------------------------------------------------------


@query("SELECT c_acctbal AS bal, c_nationkey AS nation FROM customer UNION ALL SELECT s_acctbal, s_nationkey FROM supplier")
def combine_common_columns(s, d):
    c = table(s, d, "customer").select(F.col("c_acctbal").alias("bal"), F.col("c_nationkey").alias("nation"), "c_name")
    return T.combine(c, table(s, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("bal"), "s_name"))


@query("SELECT c_custkey AS id, c_acctbal AS bal, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_acctbal, '' FROM supplier")
def combine_padded(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("segment"))
    return T.combine_padded(c, table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal")))


@query("""WITH a AS (SELECT n_nationkey AS g, n_name AS name FROM nation WHERE n_nationkey < 15), b AS (SELECT n_nationkey - 9 AS g, n_name AS name FROM nation WHERE n_nationkey >= 10),
f AS (SELECT name, min((t, g)) AS first FROM (SELECT 0 AS t, g, name FROM a UNION ALL SELECT 1, g, name FROM b) GROUP BY 1), m AS (SELECT name, row_number() OVER (ORDER BY first) AS new FROM f)
SELECT id, new::INTEGER AS g FROM (SELECT c_custkey AS id, name FROM customer JOIN a ON c_nationkey = a.g UNION ALL SELECT s_suppkey, name FROM supplier JOIN b ON s_nationkey - 9 = b.g) JOIN m USING (name)""")
def combine_rekeyed_dims(s, d):
    n = table(s, d, "nation")
    one = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("g")), n.where("n_nationkey < 15").select(F.col("n_nationkey").alias("g"), F.col("n_name").alias("name"))
    two = table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") - 9).alias("g")), n.where("n_nationkey >= 10").select((F.col("n_nationkey") - 9).alias("g"), F.col("n_name").alias("name"))
    return T.combine_rekeyed([one, two], "g", "name")[0]


@query("SELECT p_partkey, m AS mate, round(((p_size * 7.0 + m * 72.0 + 180) % 360 + 360) % 360 - 180, 4) AS rot FROM part, range(5) r(m)")
def symmetry_expand(s, d):
    p = table(s, d, "part").select("p_partkey", (F.col("p_size") * 7.0).alias("rot"))
    return X.cyclic_expand(p, 5, "rot").select("p_partkey", F.col("mate").cast("long").alias("mate"), F.round("rot", 4).alias("rot"))


@query("""SELECT p_partkey, z::INTEGER AS z, round(p_size * 2.0 - z * 22.5, 4) AS rot, round(sin(radians(80.0)) * z * 4.75 * cos(radians(30.0 + p_size)), 4) AS x, round(-sin(radians(80.0)) * z * 4.75 * sin(radians(30.0 + p_size)), 4) AS y
FROM part, range(-1, 3) r(z)""")
def helical_expand(s, d):
    p = table(s, d, "part").select("p_partkey", (F.col("p_size") * 2.0).alias("rot"), F.lit(80.0).alias("tilt"), (F.col("p_size") + 30.0).alias("psi"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    out = X.helical_expand(p, 4, 4.75, 22.5, "rot", "tilt", "psi", "x", "y")
    return out.select("p_partkey", "z", *[F.round(c, 4).alias(c) for c in ("rot", "x", "y")])


@query("""WITH t AS (SELECT s_suppkey AS k, abs(s_acctbal) AS l FROM supplier) SELECT k, n, round(n * 500.0, 4) AS x, 0.0 AS y FROM (SELECT k, l, unnest(range(0, floor(l / 500)::BIGINT + 1)) AS n FROM t)""")
def tube_segments(s, d):
    t = table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.abs("s_acctbal").alias("x2"), F.lit(0.0).alias("y2"))
    return X.tube_segments(t, "k", ("x1", "y1"), ("x2", "y2"), 500.0).select("k", "n", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("""WITH a AS (SELECT p_partkey AS k, radians(p_size * 7.0) AS r, radians(p_size * 3.0) AS t, radians(p_size * 11.0) AS p FROM part)
SELECT k, round(cos(p) * cos(t) * cos(r) - sin(p) * sin(r), 6) AS m00, round(cos(p) * cos(t) * sin(r) + sin(p) * cos(r), 6) AS m01, round(-cos(p) * sin(t), 6) AS m02, round(cos(t), 6) AS m22 FROM a""")
def euler_matrix(s, d):
    p = table(s, d, "part")
    m = angles.euler_matrix(*(F.col("p_size") * x for x in (7.0, 3.0, 11.0)))
    return p.select(F.col("p_partkey").alias("k"), *[F.round(m[i][j], 6).alias(f"m{i}{j}") for i, j in ((0, 0), (0, 1), (0, 2), (2, 2))])


@query("SELECT p_partkey AS k, round(degrees(acos(greatest(-1, least(1, cos(radians(p_size * 2.0)))))) * 2 / 3, 3) AS dist FROM part")
def angular_distance(s, d):
    z = F.lit(0.0)
    return table(s, d, "part").select(F.col("p_partkey").alias("k"), F.round(angles.angular_distance((z, z, z), (F.col("p_size") * 2.0, z, z)), 3).alias("dist"))


@query("""WITH p AS (SELECT p_partkey AS k, 10000.0 + p_size * 10 AS u, p_size / 200.0 AS x, 12.2643247 / sqrt(300000.0 * (1 + 300000.0 * 0.978466e-6)) AS l FROM part)
SELECT k, round(-sin(pi() * l * -u * x * x + pi() / 2 * 2.7e7 * pow(l, 3) * pow(x, 4) - atan(0.1 / sqrt(1 - 0.01))), 5) AS ctf FROM p""")
def ctf_profile(s, d):
    p = table(s, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") * 10 + 10000.0).alias("u"), (F.col("p_size") / 200.0).alias("x"))
    v = ctf_.ctf(F.col("x"), F.lit(0.0), F.col("u"), F.col("u"), F.lit(0.0), F.lit(300.0), F.lit(2.7), F.lit(0.1))
    return p.select("k", F.round(v, 5).alias("ctf"))


@query("""SELECT page_id, split_part(url, '/', -1) AS last, split_part(url, '/', 1) AS first, split_part(split_part(url, '/', -1), '.', 1) AS base, printf('%06d@%s', page_id, split_part(url, '/', 3)) AS composed FROM pages""")
def string_path_ops(s, d):
    u = F.col("url")
    host = F.element_at(F.split(u, "/"), 3)
    return table(s, d, "pages").select("page_id", strings.after_last(u, "/").alias("last"), strings.before_first(u, "/").alias("first"), strings.base_name(u).alias("base"), strings.compose(F.col("page_id"), host).alias("composed"))


@query("SELECT part AS k, CASE WHEN n > 0 THEN n ELSE NULL END AS n FROM (SELECT p_partkey AS part, try_cast(regexp_extract(p_size::VARCHAR || 'abc', '^([0-9]+)', 1) AS DOUBLE) AS n FROM part)")
def number_prefix(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("k"), strings.number_prefix(F.concat(F.col("p_size").cast("string"), F.lit("abc"))).alias("n"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT s_nationkey AS a, (s_nationkey * 3 + 1) % 25 AS b FROM supplier), r AS (SELECT 2 AS process UNION SELECT b FROM r JOIN e ON e.a = r.process) SELECT process FROM r""")
def downstream_delete(s, d):
    from .plans.graph import downstream

    e = table(s, d, "supplier").select("s_nationkey").distinct()
    outputs = e.select(F.col("s_nationkey").alias("process"), F.concat(F.lit("f"), F.col("s_nationkey")).alias("file"))
    inputs = e.select(((F.col("s_nationkey") * 3 + 1) % 25).alias("process"), F.concat(F.lit("f"), F.col("s_nationkey")).alias("file"))
    return downstream(inputs, outputs, s.range(2, 3).select(F.col("id").cast("int").alias("process")))[0]


from . import catalog_fields as catalog_fields  # noqa: E402  more queries register themselves
from . import catalog_more as catalog_more  # noqa: E402
from . import catalog_plans as catalog_plans  # noqa: E402
from . import catalog_tables as catalog_tables  # noqa: E402
from . import catalog_volumes as catalog_volumes  # noqa: E402
