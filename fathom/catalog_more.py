"""Further queries: corrections of images, pyramids and tensors, sub-volumes, other tables and names."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .catalog import query, table
from .catalog_fields import FT, N, PAIR, V, _ctf_grid, _with_ctf, _CTF, filtered, images, r, spread
from .catalog_plans import folder
from .catalog_volumes import C, cubes
from .operators import fields as P
from .operators import images as I
from .plans import pipeline as B
from .sources import formats


@query(_with_ctf(f"{_CTF} / (pow({_CTF}, 2) + 0.1)"))
def wiener_division(s, d):
    grid = _ctf_grid()
    return filtered(s, d, lambda a: I.wiener_divided(a, grid, 0.1))


@query(V + """, g AS (SELECT *, pi() * sqrt(pow((y - 4) / 16.0, 2) + pow((x - 4) / 16.0, 2)) AS q FROM v)
SELECT vec_id, (y * 8 + x)::INTEGER AS i, round(v / CASE WHEN q = 0 THEN 1 ELSE pow(sin(q) / q, 2) END, 5) + 0.0 AS v FROM g""")
def gridding_correction(s, d):
    return filtered(s, d, lambda a: I.gridding_corrected(a, 2.0))


_REF = _with_ctf(_CTF).replace("FROM v, range(8) a(ky)", "FROM (SELECT * FROM v WHERE vec_id = 0) v, range(8) a(ky)").replace("round(sum(", "sum(").replace(") / 64, 5) + 0.0 AS v", ") / 64 AS v")


@query(f"SELECT e.vec_id, w.i, round(e.v - w.v, 5) + 0.0 AS v FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(64))::INTEGER AS i FROM embeddings) e JOIN ({_REF}) w ON e.i = w.i")
def particle_subtraction(s, d):
    grid, ref = _ctf_grid(), np.array(images(s, d).where("vec_id = 0").first().pixels).reshape(N, N)  # one image, the reference
    return filtered(s, d, lambda a: I.subtracted(a, ref, grid))


@query(FT + """, g AS (SELECT vec_id, ky, kx, re * w AS re, im * w AS im FROM (SELECT *, exp(-2 * pow(pi() * 0.8 * sqrt(sy * sy + sx * sx) / 8, 2)) AS w FROM f))
SELECT vec_id, (y // 2 * 4 + x // 2)::INTEGER AS i, round(sum(re * cos(2 * pi() * (ky * y + kx * x) / 8) - im * sin(2 * pi() * (ky * y + kx * x) / 8)) / 64, 5) + 0.0 AS v
FROM g, (SELECT unnest([0, 2, 4, 6]) AS y), (SELECT unnest([0, 2, 4, 6]) AS x) GROUP BY ALL""")
def gaussian_pyramid(s, d):
    return filtered(s, d, lambda a: I.smaller(a, 0.8))


@query(V + """, g AS (SELECT vec_id, y, x, (lead(v) OVER r - lag(v) OVER r) / 2 AS gx, (lead(v) OVER c - lag(v) OVER c) / 2 AS gy FROM v WINDOW r AS (PARTITION BY vec_id, y ORDER BY x), c AS (PARTITION BY vec_id, x ORDER BY y))
SELECT vec_id, y, x, round(gx * gx, 6) AS xx, round(gx * gy, 6) + 0.0 AS xy, round(gy * gy, 6) AS yy FROM g WHERE gx IS NOT NULL AND gy IS NOT NULL""")
def structure_tensor(s, d):
    t = P.structure_tensor(P.long_form(images(s, d), "vec_id", "pixels", N), "vec_id")
    return t.select("vec_id", "y", "x", *[r(c, 6).alias(c) for c in ("xx", "xy", "yy")])


@query(C + """, p AS (SELECT s_suppkey AS k, s_nationkey AS vol, s_suppkey % 5 - 1 AS z0, s_suppkey % 4 - 1 AS y0, s_suppkey % 3 AS x0 FROM supplier)
SELECT k, (a * 4 + b * 2 + e)::INTEGER AS i, round(coalesce(v, 0), 5) + 0.0 AS v FROM p JOIN embeddings m ON m.vec_id = vol, range(2) q(a), range(2) w(b), range(2) u(e) LEFT JOIN c ON c.vec_id = vol AND c.z = z0 + a AND c.y = y0 + b AND c.x = x0 + e""")
def extract_subvolumes(s, d):
    k = F.col("s_suppkey")
    p = table(s, d, "supplier").select(k.alias("k"), F.col("s_nationkey").cast("long").alias("vec_id"), (k % 5 - 1).alias("z0"), (k % 4 - 1).alias("y0"), (k % 3).alias("x0"))
    w = cubes(s, d).join(p, "vec_id").withColumn("w", P.window_3d(F.col("pixels"), 4, F.col("z0"), F.col("y0"), F.col("x0"), 2))
    return w.select("k", F.posexplode("w").alias("i", "v")).select("k", "i", r("v").alias("v"))


@query(V + """, o AS (SELECT vec_id, (y + vec_id % 3 + 8) % 8 AS y, (x - vec_id % 2 + 8) % 8 AS x, v FROM v),
b AS (SELECT vec_id, avg(v) AS m, stddev_pop(v) AS sd FROM o WHERE pow(y - 4, 2) + pow(x - 4, 2) > 9 GROUP BY 1), n AS (SELECT o.vec_id, y, x, (v - m) / sd AS v FROM o JOIN b USING (vec_id)),
m AS (SELECT *, CASE WHEN d < 3 THEN 1 WHEN d > 4 THEN 0 ELSE 0.5 - 0.5 * cos(pi() * (4 - d) / 1) END AS m FROM (SELECT *, sqrt(pow(y - 4, 2) + pow(x - 4, 2)) AS d FROM n)),
k AS (SELECT vec_id, sum(v * (1 - m)) / sum(1 - m) AS b FROM m GROUP BY 1) SELECT vec_id, y::INTEGER AS y, x::INTEGER AS x, round(m * v + (1 - m) * b, 4) + 0.0 AS v FROM m JOIN k USING (vec_id)""")
def prepared_images(s, d):
    p = P.long_form(images(s, d), "vec_id", "pixels", N)
    moved = p.withColumns({"y": F.pmod(F.col("y") + F.col("vec_id") % 3, F.lit(N)).cast("int"), "x": F.pmod(F.col("x") - F.col("vec_id") % 2, F.lit(N)).cast("int")})
    return P.masked(P.normalised(moved, "vec_id", (4, 4), 3.0), "vec_id", (4, 4), 3.0, 1.0).withColumn("v", r("v", 4)).select("vec_id", "y", "x", "v")


@query(PAIR + "SELECT vec_id, round(sum(pow(a - b, 2)), 6) AS diff2, round(sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 6) + 0.0 AS cc FROM p GROUP BY 1")
def frame_differences(s, d):
    from .catalog_fields import _paired

    e = _paired(s, d).select("vec_id", F.explode(F.arrays_zip(F.col("pixels").alias("a"), F.col("other").alias("b"))).alias("z")).select("vec_id", "z.a", "z.b")
    cc = F.sum(F.col("a") * F.col("b")) / F.sqrt(F.sum(F.col("a") * F.col("a")) * F.sum(F.col("b") * F.col("b")))
    return e.groupBy("vec_id").agg(F.round(F.sum((F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))), 6).alias("diff2"), r(cc, 6).alias("cc"))


@query("SELECT s_suppkey AS tag, 0.5::DOUBLE AS dx, s_nationkey * 10.0 AS tdrot, s_nationkey::BIGINT AS tomogram, s_acctbal AS x, 7.0::DOUBLE AS z FROM supplier")
def particle_table_columns(s, d):
    path = folder(s)
    filler = {4: F.lit(0.5), 7: F.col("s_nationkey") * 10.0, 20: F.col("s_nationkey"), 24: F.col("s_acctbal"), 26: F.lit(7.0)}
    table(s, d, "supplier").select(F.concat_ws(" ", F.col("s_suppkey"), *[filler.get(k, F.lit(0)) for k in range(2, 36)])).write.mode("overwrite").text(path)
    return formats.read_dynamo_table(s, path).select("tag", "dx", "tdrot", "tomogram", "x", "z")


@query("SELECT unnest(['region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations']) AS name, 2::INTEGER AS optics_group")
def imported_files(s, d):
    f = formats.import_files(s, d, "*.parquet", 2)
    return f.select(F.regexp_extract("file", r"([^/]+)\.parquet$", 1).alias("name"), "optics_group")


@query("SELECT n_nationkey || ' ' || n_name AS value FROM nation")
def printed_table(s, d):
    return formats.table_lines(table(s, d, "nation"), "n_nationkey", "n_name")


@query("SELECT n_nationkey AS k, '--in Class2D/job012/x --ref Import/job9' || n_nationkey AS value FROM nation")
def scheme_job_names(s, d):
    p = table(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.concat(F.lit("--in Class2D/classes/x --ref import"), F.col("n_nationkey")).alias("value"))
    return B.renamed_jobs(p, "value", {"Class2D/classes/": "Class2D/job012/", "import": "Import/job9"})
