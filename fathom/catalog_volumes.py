"""Queries of volumes (embeddings as cubes of 4 x 4 x 4), textures, correlations, draws and fits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .catalog import query, table
from .catalog_fields import FT, HALVES, N, V, _coefficients, images, r, spread, weighted
from .functions import stats
from .operators import aggregates as A
from .operators import fields as P
from .operators import images as I
from .operators import particles as Q
from .operators import picks as K
from .operators import volumes as U

C = "WITH c AS (SELECT vec_id, i // 16 AS z, i // 4 % 4 AS y, i % 4 AS x, v FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS i FROM embeddings))"


def cubes(s, d):
    return images(s, d).select("vec_id", "pixels")


# --- volumes ---------------------------------------------------------------------------------------------------------


@query(C + " SELECT vec_id, (y * 4 + x)::INTEGER AS i, round(sum(v), 5) + 0.0 AS v FROM c GROUP BY ALL")
def project_volume(s, d):
    c = cubes(s, d).withColumns({"ny": F.lit(16), "nx": F.lit(4)})
    return spread(I.per_image(c, lambda a: np.stack([I.project(v.reshape(4, 4, 4), np.eye(3)) for v in a])))


@query(C + """ SELECT k.vec_id, k.i::INTEGER AS i, round(coalesce(c.v, 0), 5) + 0.0 AS v FROM (SELECT vec_id, i FROM embeddings, range(64) r(i)) k
LEFT JOIN c ON c.vec_id = k.vec_id AND c.z = i // 16 AND c.x = i // 4 % 4 AND c.y = 4 - i % 4""")
def rotate_volume(s, d):
    return spread(U.per_volume(cubes(s, d), lambda v: U.rotated_volume(v, np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1.0]])), "pixels", 4))


@query(C + """ SELECT a.vec_id, (a.z * 16 + a.y * 4 + a.x)::INTEGER AS i, round((a.v + coalesce(b.v, 0)) / 2, 5) + 0.0 AS v FROM c a LEFT JOIN c b ON b.vec_id = a.vec_id AND b.z = a.z AND b.y = 4 - a.y AND b.x = 4 - a.x""")
def symmetrise_volume(s, d):
    group = U.symmetry_group("C2")
    return spread(U.per_volume(cubes(s, d), lambda v: U.symmetrised(v, group), "pixels", 4))


@query("""WITH f AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, v FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS i FROM embeddings))
SELECT 4::INTEGER AS z, y::INTEGER AS y, x::INTEGER AS x, round(sum(v * (1 + vec_id % 2)), 4) + 0.0 AS re, round(sum(-v * (1 + vec_id % 2)), 4) + 0.0 AS im, round(sum(1.0 + vec_id % 2), 4) AS weight FROM f GROUP BY ALL""")
def back_project(s, d):
    p = images(s, d).select(F.lit([1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0]).cast("array<double>").alias("m"), F.col("pixels").alias("re"), P.constant(F.col("pixels"), "multiply", -1.0).alias("im"), F.transform("pixels", lambda _: F.col("vec_id") % 2 + 1.0).alias("w"))
    return U.back_project(p, "m", "re", "im", "w", N).select("z", "y", "x", r("re", 4).alias("re"), r("im", 4).alias("im"), F.round("weight", 4).alias("weight"))


@query("""WITH g AS (SELECT id // 400 AS z, id // 20 % 20 AS y, id % 20 AS x FROM range(8000) r(id)), d AS (SELECT *, sqrt(pow(y - 10, 2) + pow(x - 10, 2)) AS r FROM g), b AS (SELECT *, greatest(r - 7, 3 - r, 0) AS b FROM d)
SELECT z::INTEGER AS z, y::INTEGER AS y, x::INTEGER AS x, round(CASE WHEN b >= 2 THEN 0 ELSE 0.5 + 0.5 * cos(pi() * b / 2) END, 6) AS v FROM b""")
def cylinder_reference(s, d):
    return U.cylinder(s, 20, 3.0, 7.0, 2.0).withColumn("v", F.round("v", 6))


@query("""WITH c AS (SELECT l_linenumber AS shell, 1.1 - 0.1 * l_linenumber + avg(l_discount) AS m, avg(l_tax) * 2 AS q FROM lineitem GROUP BY 1)
SELECT shell, round(CASE WHEN shell < 4 THEN m ELSE (m - q) / (1 - q) END, 6) AS fsc, round(0.4 * m / (1 + (0.4 - 1) * m), 6) AS part FROM c""")
def true_and_part_fsc(s, d):
    c = table(s, d, "lineitem").groupBy(F.col("l_linenumber").alias("shell")).agg(F.avg("l_discount").alias("m"), (F.avg("l_tax") * 2).alias("q")).withColumn("m", 1.1 - 0.1 * F.col("shell") + F.col("m"))
    return c.select("shell", F.round(U.true_fsc(F.col("m"), F.col("q"), F.col("shell"), 2), 6).alias("fsc"), F.round(U.part_fsc(F.col("m"), F.lit(0.4)), 6).alias("part"))


@query(HALVES.replace("c AS (SELECT round", "c AS (SELECT ky, kx, round") + """SELECT ky::INTEGER AS y, kx::INTEGER AS x, round(CASE WHEN shell <= 1 THEN (ar + br) / 2 ELSE ar END, 5) + 0.0 AS re0, round(CASE WHEN shell <= 1 THEN (ai + bi) / 2 ELSE bi END, 5) + 0.0 AS im1 FROM c""")
def joined_halves(s, d):
    c = U.joined_halves(_coefficients(s, d), "shell", 1, ["re0", "im0"], ["re1", "im1"])
    return c.select("y", "x", r("re0").alias("re0"), r("im1").alias("im1"))


@query("SELECT p_partkey AS k, round(0.9 * p_size + 0.1 * p_retailprice, 5) AS velocity, round(p_retailprice - 0.5 * (0.9 * p_size + 0.1 * p_retailprice), 5) + 0.0 AS value FROM part")
def momentum_step(s, d):
    p = table(s, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("gradient"), F.col("p_size").cast("double").alias("velocity"), F.col("p_retailprice").alias("value"))
    return U.momentum_step(p, "gradient", "velocity", "value", 0.9, 0.5).select("k", F.round("velocity", 5).alias("velocity"), r("value").alias("value"))


# --- images ------------------------------------------------------------------------------------------------------------


@query(weighted("1 / (1 - 0.1 * least(round(sqrt(sy * sy + sx * sx)), 4))"))
def mtf_division(s, d):
    return spread(I.per_image(images(s, d).drop("label"), lambda a: I.shell_weighted(a, 1 / (1 - 0.1 * np.arange(5)))))


@query(V + """, RECURSIVE_ AS (SELECT 1), m AS (SELECT vec_id, y * 8 + x AS i, y, x FROM v WHERE v >= 0.03),
e AS (SELECT a.vec_id, a.i, b.i AS j FROM m a JOIN m b ON a.vec_id = b.vec_id AND abs(a.y - b.y) + abs(a.x - b.x) = 1),
q AS (WITH RECURSIVE t AS (SELECT vec_id, i, i AS j FROM m UNION SELECT t.vec_id, t.i, e.j FROM t JOIN e ON e.vec_id = t.vec_id AND e.i = t.j) SELECT vec_id, i, min(j) AS j FROM t GROUP BY 1, 2)
SELECT vec_id, i::INTEGER AS i, (j + 1)::DOUBLE AS v FROM q""".replace(" RECURSIVE_ AS (SELECT 1),", ""))
def connected_parts(s, d):
    return spread(I.per_image(images(s, d).drop("label"), lambda a: I.blobs(a, 0.03))).where("v > 0")


@query(V + """, n AS (SELECT a.vec_id, a.y, a.x, sum(CASE WHEN b.v >= a.v THEN CASE (b.y - a.y) * 3 + b.x - a.x WHEN -4 THEN 1 WHEN -3 THEN 2 WHEN -2 THEN 4 WHEN 1 THEN 8 WHEN 4 THEN 16 WHEN 3 THEN 32 WHEN 2 THEN 64 ELSE 128 END ELSE 0 END) AS code
FROM v a JOIN v b ON a.vec_id = b.vec_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND (a.y <> b.y OR a.x <> b.x) WHERE a.y BETWEEN 1 AND 6 AND a.x BETWEEN 1 AND 6 GROUP BY ALL)
SELECT vec_id, code::INTEGER AS code, count(*) AS n FROM n GROUP BY 1, 2""")
def local_binary_patterns(s, d):
    p = images(s, d).select("vec_id", F.explode(P.binary_patterns(F.col("pixels"), N, N)).alias("code"))
    return A.group_sizes(p, "vec_id", "code")


@query(V + """, l AS (SELECT vec_id, y, x, least(3, floor((v - min(v) OVER (PARTITION BY vec_id)) / (max(v) OVER (PARTITION BY vec_id) - min(v) OVER (PARTITION BY vec_id)) * 4)) AS l FROM v),
p AS (SELECT a.vec_id, a.l AS a, b.l AS b, count(*) / 56.0 AS p FROM l a JOIN l b ON a.vec_id = b.vec_id AND a.y = b.y AND b.x = a.x + 1 GROUP BY ALL)
SELECT vec_id, round(sum(p * pow(a - b, 2)), 6) AS contrast, round(sum(p * p), 6) AS energy, round(sum(p / (1 + abs(a - b))), 6) AS homogeneity, round(sum(-p * ln(p)), 6) AS entropy FROM p GROUP BY 1""")
def haralick_texture(s, d):
    t = P.texture(P.long_form(images(s, d), "vec_id", "pixels", N), "vec_id", 4)
    return t.select("vec_id", *[F.round(c, 6).alias(c) for c in ("contrast", "energy", "homogeneity", "entropy")])


@query(V + " SELECT vec_id, y, x, round(CASE WHEN d >= 2 THEN v ELSE v * (0.5 - 0.5 * cos(pi() * (d + 1) / 3)) END, 5) + 0.0 AS v FROM (SELECT *, least(y, x, 7 - y, 7 - x) AS d FROM v)")
def taper_edges(s, d):
    return P.tapered(P.long_form(images(s, d), "vec_id", "pixels", N), N, N, 2).withColumn("v", r("v"))


@query(V + " SELECT vec_id, round(sqrt(pow(y - 4, 2) + pow(x - 4, 2)))::INTEGER AS ring, floor((v + 0.5) / 0.1)::INTEGER AS bin, count(*) AS n FROM v GROUP BY ALL")
def ring_histogram(s, d):
    return P.ring_histogram(P.long_form(images(s, d), "vec_id", "pixels", N), "vec_id", (4, 4), -0.5, 0.1)


_CC = V + """, c AS (SELECT vec_id, y, x, v - avg(v) OVER (PARTITION BY vec_id) AS v FROM v), k AS (SELECT y, x, v FROM c WHERE vec_id = 0),
n AS (SELECT vec_id, sqrt(sum(v * v) * (SELECT sum(v * v) FROM k)) AS n FROM c GROUP BY 1),
m AS (SELECT vec_id, (c.y - k.y + 8) % 8 AS y, (c.x - k.x + 8) % 8 AS x, sum(c.v * k.v) / any_value(n) AS v FROM c JOIN n USING (vec_id), k GROUP BY ALL) """


def _correlated(s, d):
    ref = np.array(images(s, d).where("vec_id = 0").first().pixels).reshape(N, N)  # one image, the reference
    return I.per_image(images(s, d).drop("label"), lambda a: I.cross_correlation(a, ref))


@query(_CC + "SELECT vec_id, CASE WHEN y > 4 THEN y - 8 ELSE y END::INTEGER AS dy, CASE WHEN x > 4 THEN x - 8 ELSE x END::INTEGER AS dx, round(v, 5) + 0.0 AS peak FROM m QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY v DESC) = 1")
def frame_shifts(s, d):
    a = F.col("pixels")
    dy, dx = P.wrapped_peak(a, N, N)
    return _correlated(s, d).select("vec_id", dy.alias("dy"), dx.alias("dx"), r(F.array_max(a)).alias("peak"))


@query(_CC + "SELECT a.vec_id, a.y::INTEGER AS y, a.x::INTEGER AS x FROM m a WHERE a.v >= 0.2 AND (SELECT count(*) FROM m b WHERE b.vec_id = a.vec_id AND abs(b.y - a.y) + abs(b.x - a.x) = 1 AND b.v < a.v) = 4")
def template_picks(s, d):
    return K.local_maxima(P.long_form(_correlated(s, d), "vec_id", "pixels", N), "vec_id", "x", "y", "v", 0.2).select("vec_id", "y", "x")


@query(V + """, p AS (SELECT s_suppkey AS k, s_nationkey AS img, s_suppkey % 9 - 2 AS y0, s_suppkey % 7 - 1 AS x0 FROM supplier)
SELECT k, (a * 4 + b)::INTEGER AS i, round(coalesce(v, 0), 5) + 0.0 AS v FROM p JOIN embeddings e ON e.vec_id = img, range(4) r(a), range(4) q(b) LEFT JOIN v ON v.vec_id = img AND v.y = y0 + a AND v.x = x0 + b""")
def extract_windows(s, d):
    p = table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").cast("long").alias("vec_id"), (F.col("s_suppkey") % 9 - 2).alias("y0"), (F.col("s_suppkey") % 7 - 1).alias("x0"))
    w = images(s, d).join(p, "vec_id").withColumn("w", P.window(F.col("pixels"), N, N, F.col("y0"), F.col("x0"), 4, 4))
    return w.select("k", F.posexplode("w").alias("i", "v")).select("k", "i", r("v").alias("v"))


# --- fits ----------------------------------------------------------------------------------------------------------------


@query("SELECT l_suppkey AS frame, round(4 * regr_slope(ln(l_quantity), pow(l_linenumber / 20.0, 2)), 3) + 0.0 AS b, round(regr_intercept(ln(l_quantity), pow(l_linenumber / 20.0, 2)), 4) + 0.0 AS scale FROM lineitem GROUP BY 1")
def frame_b_factors(s, d):
    li = table(s, d, "lineitem").select(F.col("l_suppkey").alias("frame"), F.pow(F.col("l_linenumber") / 20.0, F.lit(2.0)).alias("x"), F.log("l_quantity").alias("y"))
    f = A.line_fit(li, "x", "y", F.lit(1.0), "frame")
    return f.select("frame", r(4 * F.col("slope"), 3).alias("b"), r("intercept", 4).alias("scale"))


@query("""WITH o AS (SELECT p_brand AS k, p_size / 60.0 AS q, p_retailprice / 2000 - 0.5 AS amp FROM part), g AS (SELECT 5000.0 + 500 * i AS u FROM range(30) r(i)),
c AS (SELECT k, u, round(sum(pow(amp - sin(pi() * 0.0197 * u * q * q), 2)), 6) AS cost FROM o, g GROUP BY 1, 2)
SELECT k, u, cost FROM c QUALIFY row_number() OVER (PARTITION BY k ORDER BY cost, u) = 1""")
def defocus_search(s, d):
    import math

    o = table(s, d, "part").select(F.col("p_brand").alias("k"), (F.col("p_size") / 60.0).alias("q"), (F.col("p_retailprice") / 2000 - 0.5).alias("amp"))
    grid = s.range(30).select((F.col("id") * 500 + 5000.0).alias("u"))
    cost = F.pow(F.col("amp") - F.sin(math.pi * 0.0197 * F.col("u") * F.col("q") * F.col("q")), F.lit(2.0))
    return Q.best_on_grid(o, grid, cost, "k").select("k", "u", F.round("cost", 6).alias("cost"))


@query("""WITH p AS (SELECT l_suppkey AS g, l_quantity AS x, l_linenumber * 5.0 AS y, l_quantity * 1.02 + l_linenumber * 0.1 + l_tax AS u, l_linenumber * 4.9 - l_discount AS v FROM lineitem),
s AS (SELECT g, sum(x*x) xx, sum(x*y) xy, sum(y*y) yy, sum(x*u) xu, sum(y*u) yu, sum(x*v) xv, sum(y*v) yv FROM p GROUP BY 1)
SELECT g, round((xu*yy - yu*xy)/(xx*yy - xy*xy), 5) + 0.0 AS a, round((yu*xx - xu*xy)/(xx*yy - xy*xy), 5) + 0.0 AS b, round((xv*yy - yv*xy)/(xx*yy - xy*xy), 5) + 0.0 AS c, round((yv*xx - xv*xy)/(xx*yy - xy*xy), 5) + 0.0 AS d FROM s""")
def magnification_fit(s, d):
    li = table(s, d, "lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_quantity").alias("x"), (F.col("l_linenumber") * 5.0).alias("y"), (F.col("l_quantity") * 1.02 + F.col("l_linenumber") * 0.1 + F.col("l_tax")).alias("u"), (F.col("l_linenumber") * 4.9 - F.col("l_discount")).alias("v"))
    return Q.affine_fit(li, "x", "y", "u", "v", "g").select("g", *[r(c, 5).alias(c) for c in "abcd"])


@query("SELECT s_name AS first, (SELECT s_name FROM supplier ORDER BY s_suppkey DESC LIMIT 1 OFFSET 1) AS last_but_one FROM supplier WHERE s_suppkey = 0")
def table_cells(s, d):
    p = table(s, d, "supplier")
    a, b = Q.cell(p, "s_suppkey", 0, "s_name"), Q.cell(p, "s_suppkey", -2, "s_name")
    return a.withColumnRenamed("s_name", "first").crossJoin(F.broadcast(b.withColumnRenamed("s_name", "last_but_one")))  # one row each


@query("SELECT n_nationkey AS tomo, s_suppkey AS k, s_acctbal AS x, 50.0::DOUBLE AS r FROM nation JOIN supplier ON n_nationkey = s_nationkey")
def sphere_manifolds(s, d):
    t = table(s, d, "nation").select(F.col("n_nationkey").alias("tomo"))
    m = table(s, d, "supplier").select(F.col("s_nationkey").alias("tomo"), F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("x"), F.col("s_suppkey").alias("y"), F.lit(1).alias("z"), F.lit(50).alias("r"))
    return Q.spheres(t, m, "tomo").select("tomo", "k", F.element_at("sphere", 1).alias("x"), F.element_at("sphere", 4).alias("r"))


# --- draws and special functions --------------------------------------------------------------------------------------

_U = "((('0x' || substr(md5(p_partkey::VARCHAR || '{0}'), 1, 8))::BIGINT + 0.5) / 4294967296.0)"


@query(f"SELECT p_partkey AS k, round(2 + 3 * {_U.format(5)}, 6) AS u, round(sqrt(-2 * ln({_U.format(5)})) * cos(2 * pi() * {_U.format(6)}) * 2 + 1, 5) + 0.0 AS g, round(exp(ln(0.1) + (ln(10.0) - ln(0.1)) * {_U.format(7)}), 5) AS l FROM part")
def random_draws(s, d):
    k = F.col("p_partkey")
    return table(s, d, "part").select(k.alias("k"), F.round(stats.uniform_draw(k, 5, 2.0, 5.0), 6).alias("u"), r(stats.gaussian_draw(k, 5, 2.0, 1.0), 5).alias("g"), F.round(stats.log_draw(k, 7, 0.1, 10.0), 5).alias("l"))


@query("""WITH p AS (SELECT DISTINCT p_size AS k, p_size / 10.0 AS x FROM part)
SELECT k, round(sum(CASE WHEN m % 2 = 0 THEN 1 ELSE -1 END * pow(x / 2, 2 * m) / pow(gamma(m + 1), 2)), 6) + 0.0 AS j0, round(sum(CASE WHEN m % 2 = 0 THEN 1 ELSE -1 END * pow(x / 2, 2 * m + 1) / (gamma(m + 1) * gamma(m + 2))), 6) + 0.0 AS j1,
round(sum(pow(x / 2, 2 * m) / pow(gamma(m + 1), 2)), 5) AS i0 FROM p, range(40) r(m) GROUP BY 1""")
def bessel_functions(s, d):
    p = table(s, d, "part").select(F.col("p_size").alias("k")).distinct().withColumn("x", F.col("k") / 10.0)
    return p.select("k", r(stats.bessel_j(0)(F.col("x")), 6).alias("j0"), r(stats.bessel_j(1)(F.col("x")), 6).alias("j1"), F.round(stats.bessel_i(0)(F.col("x")), 5).alias("i0"))


@query("""WITH p AS (SELECT DISTINCT p_size AS k, sqrt(greatest(0, 1 - pow(p_size / 40.0, 2))) AS s FROM part), q AS (SELECT k, s, sum(pow(s * 3.5 / 2, 2 * m + 2) / (gamma(m + 1) * gamma(m + 3))) AS i, sum(pow(3.5 / 2, 2 * m + 2) / (gamma(m + 1) * gamma(m + 3))) AS top FROM p, range(40) r(m) GROUP BY 1, 2)
SELECT k, round(CASE WHEN k > 40 THEN 0 ELSE s * s * i / top END, 6) AS blob FROM q""")
def kaiser_blob(s, d):
    p = table(s, d, "part").select(F.col("p_size").alias("k")).distinct()
    return p.select("k", F.round(stats.kaiser_blob(F.col("k") * 1.0, 40.0, 3.5, 2), 6).alias("blob"))
