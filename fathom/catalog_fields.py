"""Queries of the image operators: embeddings are read as images of 8 x 8 pixels. The SQL transforms by sums of sines."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .catalog import query, table
from .functions import ctf as ctf_
from .operators import aggregates as A
from .operators import fields as P
from .operators import images as I

N = 8
V = "WITH v AS (SELECT vec_id, (i // 8)::INTEGER AS y, (i % 8)::INTEGER AS x, v FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS i FROM embeddings))"
# every coefficient of the transform, and what an image with weighted coefficients is
FT = V + """, f AS (SELECT vec_id, ky, kx, CASE WHEN ky > 4 THEN ky - 8 ELSE ky END AS sy, CASE WHEN kx > 4 THEN kx - 8 ELSE kx END AS sx,
sum(v * cos(2 * pi() * (ky * y + kx * x) / 8)) AS re, -sum(v * sin(2 * pi() * (ky * y + kx * x) / 8)) AS im FROM v, range(8) a(ky), range(8) b(kx) GROUP BY ALL)"""


def weighted(weight: str) -> str:
    return FT + f""", g AS (SELECT vec_id, ky, kx, re * w AS re, im * w AS im FROM (SELECT *, {weight} AS w FROM f))
SELECT vec_id, (y * 8 + x)::INTEGER AS i, round(sum(re * cos(2 * pi() * (ky * y + kx * x) / 8) - im * sin(2 * pi() * (ky * y + kx * x) / 8)) / 64, 5) + 0.0 AS v
FROM g, range(8) a(y), range(8) b(x) GROUP BY ALL"""


def images(s, d):
    return table(s, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("pixels"), F.lit(N).alias("ny"), F.lit(N).alias("nx"))


def r(c, k=5):
    return F.round(c, k) + F.lit(0.0)


def spread(df, pixels="pixels"):
    """Every pixel as a row."""
    return df.select("vec_id", F.posexplode(pixels).alias("i", "v")).select("vec_id", "i", r("v").alias("v"))


def filtered(s, d, kernel):
    return spread(I.per_image(images(s, d).drop("label"), kernel))


def expressed(s, d, f):
    return spread(images(s, d).withColumn("pixels", f(F.col("pixels"))))


def plain(e, more=""):
    return f"{V} SELECT vec_id, (y * 8 + x)::INTEGER AS i, round({e}, 5) + 0.0 AS v FROM v {more}"


# --- arithmetic, masks, geometry ---------------------------------------------------------------------------------


@query(plain("(v + 2) * 3 / 7 - 1"))
def image_constant_arithmetic(s, d):
    return expressed(s, d, lambda a: P.constant(P.constant(P.constant(P.constant(a, "add", 2.0), "multiply", 3.0), "divide", 7.0), "subtract", 1.0))


@query(plain("greatest(-0.1, least(0.15, v))"))
def image_thresholds(s, d):
    return expressed(s, d, lambda a: P.clipped(a, -0.1, 0.15))


@query(plain("CASE WHEN v < -0.1 THEN 0.5 ELSE v END"))
def image_replace_nan(s, d):
    return expressed(s, d, lambda a: P.without_nan(F.transform(a, lambda v: F.when(v < -0.1, float("nan")).otherwise(v)), 0.5))


PAIR = V + ", p AS (SELECT a.vec_id, a.y, a.x, a.v AS a, b.v AS b FROM v a JOIN v b ON b.vec_id = a.vec_id + 1 AND a.y = b.y AND a.x = b.x) "


def _paired(s, d):
    a = images(s, d).select("vec_id", "pixels")
    return a.join(a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("pixels").alias("other")), "vec_id")


@query(PAIR + "SELECT vec_id, (y * 8 + x)::INTEGER AS i, round((a + b) * b - CASE WHEN abs(b) < 1e-10 THEN 0 ELSE a / b END, 3) + 0.0 AS v FROM p WHERE abs(b) > 0.01")
def image_image_arithmetic(s, d):
    a, b = F.col("pixels"), F.col("other")
    done = P.combined(P.combined(P.combined(a, b, "add"), b, "multiply"), P.combined(a, b, "divide"), "subtract")
    e = _paired(s, d).select("vec_id", F.posexplode(F.arrays_zip(done.alias("v"), b.alias("b"))).alias("i", "z"))
    return e.where(F.abs("z.b") > 0.01).select("vec_id", "i", r("z.v", 3).alias("v"))


@query(PAIR + ", k AS (SELECT vec_id, sum(a * b) / sum(b * b) AS s FROM p GROUP BY 1) SELECT vec_id, (y * 8 + x)::INTEGER AS i, round(a - s * b, 5) + 0.0 AS v FROM p JOIN k USING (vec_id)")
def image_scaled_difference(s, d):
    return spread(_paired(s, d).withColumn("pixels", P.scaled_difference(F.col("pixels"), F.col("other"))))


@query(V + """ SELECT vec_id, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) AS sigma, round(min(v), 6) + 0.0 AS low, round(max(v), 6) + 0.0 AS high, round(median(v), 6) + 0.0 AS median,
arg_max(y * 8 + x, struct_pack(a := v, b := -(y * 8 + x)))::BIGINT AS at_high, arg_min(y * 8 + x, struct_pack(a := v, b := y * 8 + x))::BIGINT AS at_low FROM v GROUP BY 1""")
def image_statistics(s, d):
    a = F.col("pixels")
    return images(s, d).select("vec_id", r(P.mean(a), 6).alias("mean"), F.round(P.deviation(a), 6).alias("sigma"), r(F.array_min(a), 6).alias("low"), r(F.array_max(a), 6).alias("high"), r(P.median(a), 6).alias("median"), P.first_max(a).alias("at_high"), P.first_min(a).alias("at_low"))


def moved(y, x):
    return f"{V} SELECT vec_id, (({y}) * 8 + {x})::INTEGER AS i, round(v, 5) + 0.0 AS v FROM v"


@query(moved("y", "7 - x"))
def image_flip_x(s, d):
    return expressed(s, d, lambda a: P.flip_x(a, N, N))


@query(moved("7 - y", "x"))
def image_flip_y(s, d):
    return expressed(s, d, lambda a: P.flip_y(a, N, N))


@query(moved("x", "y"))
def image_transpose(s, d):
    return expressed(s, d, lambda a: P.transposed(a, N, N))


@query(plain("-v"))
def image_invert_contrast(s, d):
    return expressed(s, d, lambda a: P.constant(a, "multiply", -1.0))


@query(V + " SELECT vec_id, (y // 2 * 4 + x // 2)::INTEGER AS i, round(avg(v), 5) + 0.0 AS v FROM v GROUP BY ALL")
def image_bin(s, d):
    return expressed(s, d, lambda a: P.binned(a, N, N, 2))


@query(V + """ SELECT k.vec_id, (p * 6 + q)::INTEGER AS i, round(coalesce(v, 9), 5) + 0.0 AS v FROM (SELECT vec_id, p, q FROM embeddings, range(5) a(p), range(6) b(q)) k
LEFT JOIN v ON v.vec_id = k.vec_id AND y = p - 2 AND x = q + 4""")
def image_window(s, d):
    return expressed(s, d, lambda a: P.window(a, N, N, -2, 4, 5, 6, 9.0))


@query(PAIR + """SELECT vec_id, (y * 8 + x)::INTEGER AS i, (CASE WHEN a >= 0 AND b >= 0 THEN 1 ELSE 0 END + CASE WHEN a >= 0 OR b >= 0 THEN 2 ELSE 0 END
+ CASE WHEN a >= 0 AND NOT b >= 0 THEN 4 ELSE 0 END + CASE WHEN a >= 0 OR NOT b >= 0 THEN 8 ELSE 0 END + CASE WHEN a >= 0 THEN 0 ELSE 16 END)::DOUBLE AS v FROM p""")
def mask_logic(s, d):
    a, b = (P.binary(F.col(c), 0.0) for c in ("pixels", "other"))
    parts = [P.constant(P.mask_logic(a, b, op), "multiply", k) for op, k in (("and", 1.0), ("or", 2.0), ("and_not", 4.0), ("or_not", 8.0))] + [P.constant(P.inverted(a), "multiply", 16.0)]
    total = parts[0]
    for p in parts[1:]:
        total = P.combined(total, p, "add")
    return spread(_paired(s, d).withColumn("pixels", total))


@query(V + """, m AS (SELECT *, CASE WHEN d < 2 THEN 1 WHEN d > 3.5 THEN 0 ELSE 0.5 - 0.5 * cos(pi() * (3.5 - d) / 1.5) END AS m FROM (SELECT *, sqrt(pow(y - 4, 2) + pow(x - 4, 2)) AS d FROM v)),
b AS (SELECT vec_id, sum(v * (1 - m)) / sum(1 - m) AS b FROM m GROUP BY 1) SELECT vec_id, y, x, round(m * v + (1 - m) * b, 5) + 0.0 AS v FROM m JOIN b USING (vec_id)""")
def soft_mask(s, d):
    return P.masked(P.long_form(images(s, d), "vec_id", "pixels", N), "vec_id", (4, 4), 2.0, 1.5).withColumn("v", r("v"))


@query(V + """, b AS (SELECT vec_id, avg(v) AS m, stddev_pop(v) AS sd FROM v WHERE pow(y - 4, 2) + pow(x - 4, 2) > 9 GROUP BY 1)
SELECT vec_id, y, x, round((v - m) / sd, 4) + 0.0 AS v FROM v JOIN b USING (vec_id)""")
def normalise_background(s, d):
    return P.normalised(P.long_form(images(s, d), "vec_id", "pixels", N), "vec_id", (4, 4), 3.0).withColumn("v", r("v", 4))


@query(V + """, b AS (SELECT vec_id, avg(v) AS m, stddev_pop(v) AS sd FROM v GROUP BY 1)
SELECT vec_id, y, x, round(CASE WHEN v - m > 1.5 * sd OR m - v > 2 * sd THEN m ELSE v END, 5) + 0.0 AS v FROM v JOIN b USING (vec_id)""")
def remove_dust(s, d):
    return P.without_dust(P.long_form(images(s, d), "vec_id", "pixels", N), "vec_id", 1.5, 2.0).withColumn("v", r("v"))


@query(V + """, w AS (SELECT vec_id, y, x, v, max(v) OVER (PARTITION BY vec_id, y ORDER BY x RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM v)
SELECT vec_id, y, x, round(v, 5) + 0.0 AS v FROM (SELECT *, max(m) OVER (PARTITION BY vec_id, x ORDER BY y RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS b FROM w) WHERE v = b""")
def box_maxima(s, d):
    return P.box_extrema(P.long_form(images(s, d), "vec_id", "pixels", N), "vec_id", 2).select("vec_id", "y", "x", r("v").alias("v"))


@query(V + """ SELECT a.vec_id, a.y, a.x, round(a.v, 5) + 0.0 AS v FROM v a WHERE NOT EXISTS (SELECT 1 FROM v b WHERE b.vec_id = a.vec_id AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 AND b.v < a.v)""")
def box_minima(s, d):
    return P.box_extrema(P.long_form(images(s, d), "vec_id", "pixels", N), "vec_id", 1, False).select("vec_id", "y", "x", r("v").alias("v"))


@query(V + """ SELECT a.vec_id, a.y, a.x FROM v a WHERE a.v >= 0.1 AND (SELECT count(*) FROM v b WHERE b.vec_id = a.vec_id AND abs(b.y - a.y) + abs(b.x - a.x) = 1 AND b.v < a.v) = 4""")
def local_maxima(s, d):
    from .operators.picks import local_maxima as f

    return f(P.long_form(images(s, d), "vec_id", "pixels", N), "vec_id", "x", "y", "v", 0.1).select("vec_id", "y", "x")


# --- over the table ----------------------------------------------------------------------------------------------


@query("SELECT label % 3 AS g, i::INTEGER AS i, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) AS sigma FROM (SELECT label, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS i FROM embeddings) GROUP BY 1, 2")
def average_image(s, d):
    return P.average_image(images(s, d).withColumn("g", F.col("label") % 3), "pixels", "g").select("g", "i", r("mean", 6).alias("mean"), F.round("sigma", 6).alias("sigma"))


@query("WITH t AS (SELECT i, sum(v) AS s FROM (SELECT unnest(embedding)::DOUBLE + 1 AS v, unnest(range(64)) AS i FROM embeddings) GROUP BY 1) SELECT i::INTEGER AS i, round(avg(s) OVER () / s, 6) AS gain FROM t")
def gain_reference(s, d):
    return P.gain(images(s, d).withColumn("pixels", P.constant(F.col("pixels"), "add", 1.0)), "pixels").select("i", F.round("gain", 6).alias("gain"))


@query(FT + """ SELECT round(sqrt(sy * sy + sx * sx))::BIGINT AS shell, round(avg((re * re + im * im) / 4096), 8) AS mean, count(*) AS n FROM f GROUP BY 1""")
def power_spectrum(s, d):
    p = P.long_form(I.per_image(images(s, d).drop("label"), I.power), "vec_id", "pixels", N)
    signed = [F.when(F.col(c) > 4, F.col(c) - 8).otherwise(F.col(c)) for c in ("y", "x")]
    a = A.shell_average(p.select(signed[0].alias("a"), signed[1].alias("b"), "v"), "v", "a", "b")
    return a.select("shell", F.round("mean", 8).alias("mean"), "n")


def _coefficients(s, d):
    """Complex coefficients of the mean images of even and odd labels."""
    m = images(s, d).select((F.col("label") % 2).alias("half"), F.posexplode("pixels").alias("i", "v")).groupBy("half", "i").agg(F.avg("v").alias("v"))
    stack = m.groupBy("half").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda z: z.v).alias("pixels")).select("half", "pixels", F.lit(N).alias("ny"), F.lit(N).alias("nx"))  # one row for each half
    parts = [P.long_form(I.per_image(stack, k), "half", "pixels", N).withColumnRenamed("v", n) for n, k in (("re", lambda a: np.fft.fft2(a).real), ("im", lambda a: np.fft.fft2(a).imag))]
    c = parts[0].join(parts[1], ["half", "y", "x"])
    a, b = (c.where(f"half = {h}").select("y", "x", F.col("re").alias(f"re{h}"), F.col("im").alias(f"im{h}")) for h in (0, 1))
    sy, sx = (F.when(F.col(k) > 4, F.col(k) - 8).otherwise(F.col(k)) for k in ("y", "x"))
    return a.join(b, ["y", "x"]).withColumn("shell", F.round(F.sqrt(sy * sy + sx * sx)).cast("long"))


HALVES = """WITH m AS (SELECT label % 2 AS h, i // 8 AS y, i % 8 AS x, avg(v) AS v FROM (SELECT label, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS i FROM embeddings) GROUP BY ALL),
f AS (SELECT h, ky, kx, sum(v * cos(2 * pi() * (ky * y + kx * x) / 8)) AS re, -sum(v * sin(2 * pi() * (ky * y + kx * x) / 8)) AS im FROM m, range(8) a(ky), range(8) b(kx) GROUP BY ALL),
c AS (SELECT round(sqrt(pow(CASE WHEN ky > 4 THEN ky - 8 ELSE ky END, 2) + pow(CASE WHEN kx > 4 THEN kx - 8 ELSE kx END, 2)))::BIGINT AS shell, a.re AS ar, a.im AS ai, b.re AS br, b.im AS bi
FROM f a JOIN f b USING (ky, kx) WHERE a.h = 0 AND b.h = 1) """


@query(HALVES + "SELECT shell, round(sum(ar * br + ai * bi) / sqrt(sum(ar * ar + ai * ai) * sum(br * br + bi * bi)), 5) + 0.0 AS fsc FROM c GROUP BY 1")
def half_map_correlation(s, d):
    return A.shell_correlation(_coefficients(s, d), "shell", ("re0", "im0"), ("re1", "im1")).select("shell", r("fsc").alias("fsc"))


@query(HALVES + """, t AS (SELECT shell, sqrt(ar * ar + ai * ai) AS p, sqrt(br * br + bi * bi) AS q, (atan2(ai, ar) - atan2(bi, br)) AS t FROM c WHERE abs(ai) + abs(bi) > 1e-9),
u AS (SELECT shell, p, q, CASE WHEN t > pi() THEN t - 2 * pi() WHEN t < -pi() THEN t + 2 * pi() ELSE t END AS t FROM t)
SELECT shell, round(CASE WHEN var_pop(p) < 1e-20 THEN 1 ELSE corr(p, q) END, 4) + 0.0 AS amplitude, round(degrees(sqrt(sum(t * t * (p + q)) / sum(p + q))), 3) AS residual, round(avg(cos(t)), 5) + 0.0 AS cosine FROM u GROUP BY 1""")
def amplitude_and_phase_shells(s, d):
    c = _coefficients(s, d).where("abs(im0) + abs(im1) > 1e-9")
    out = P.shells_of(c, F.col("shell"), ("re0", "im0"), ("re1", "im1"))
    return out.select("shell", r("amplitude", 4).alias("amplitude"), F.round("residual", 3).alias("residual"), r("cosine").alias("cosine"))


@query(V + """, z AS (SELECT (v - avg(v) OVER ()) / stddev_pop(v) OVER () AS z FROM v),
h AS (SELECT greatest(0, least(100, round((z + 10) / 0.2)))::INTEGER AS bin, count(*) AS n FROM z GROUP BY 1),
q AS (SELECT k::INTEGER AS bin, exp(-pow(k * 0.2 - 10, 2) / 2) AS g FROM range(101) r(k))
SELECT round(sum(n / t * ln((n / t) / (g / s))), 6) AS divergence FROM h JOIN q USING (bin), (SELECT sum(n) AS t FROM h), (SELECT sum(g) AS s FROM q)""")
def residual_divergence(s, d):
    v = P.long_form(images(s, d), "vec_id", "pixels", N)
    e = v.agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("sd"))  # one row
    z = v.crossJoin(F.broadcast(e)).select(((F.col("v") - F.col("m")) / F.col("sd")).alias("z"))
    return P.residual_divergence(z, "z").select(F.round("divergence", 6).alias("divergence"))


@query(V + """, f AS (SELECT vec_id % 4 AS frame, round(sqrt(pow(y, 2) + pow(x, 2)))::BIGINT AS shell, a.v AS a, b.v AS b FROM v a JOIN (SELECT vec_id - 1 AS vec_id, y, x, v FROM v) b USING (vec_id, y, x))
SELECT frame, shell, round(sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 6) + 0.0 AS fcc FROM f GROUP BY 1, 2""")
def frame_correlation(s, d):
    v = P.long_form(images(s, d), "vec_id", "pixels", N)
    pairs = v.withColumnRenamed("v", "a").join(v.select((F.col("vec_id") - 1).alias("vec_id"), "y", "x", F.col("v").alias("b")), ["vec_id", "y", "x"])
    c = pairs.select(F.struct((F.col("vec_id") % 4).alias("frame"), F.round(F.sqrt(F.col("y") * F.col("y") + F.col("x") * F.col("x"))).cast("long").alias("shell")).alias("k"), "a", "b", F.lit(0.0).alias("z"))
    return A.shell_correlation(c, "k", ("a", "z"), ("b", "z")).select("k.frame", "k.shell", r("fsc", 6).alias("fcc"))


# --- filters -------------------------------------------------------------------------------------------------------

_R = "(sqrt(sy * sy + sx * sx) / 8)"


@query(FT + " SELECT vec_id, (ky * 8 + kx)::INTEGER AS i, round(re, 5) + 0.0 AS v FROM f")
def transform_real(s, d):
    return filtered(s, d, lambda a: np.fft.fft2(a).real)


@query(FT + " SELECT vec_id, (ky * 8 + kx)::INTEGER AS i, round(im, 5) + 0.0 AS v FROM f")
def transform_imaginary(s, d):
    return filtered(s, d, lambda a: np.fft.fft2(a).imag)


@query(FT + " SELECT vec_id, (ky * 8 + kx)::INTEGER AS i, round(sqrt(re * re + im * im), 5) + 0.0 AS v FROM f")
def amplitude_map(s, d):
    return filtered(s, d, lambda a: np.abs(np.fft.fft2(a)))


@query(weighted(f"CASE WHEN {_R} <= 0.2 THEN 1 WHEN {_R} >= 0.4 THEN 0 ELSE 0.5 + 0.5 * cos(pi() * ({_R} - 0.2) / 0.2) END"))
def low_pass(s, d):
    return filtered(s, d, lambda a: I.low_pass(a, 0.2, 0.2))


@query(weighted(f"1 - CASE WHEN {_R} <= 0.2 THEN 1 WHEN {_R} >= 0.4 THEN 0 ELSE 0.5 + 0.5 * cos(pi() * ({_R} - 0.2) / 0.2) END"))
def high_pass(s, d):
    return filtered(s, d, lambda a: I.high_pass(a, 0.2, 0.2))


@query(weighted(f"exp(-10.0 / 4 * pow({_R} / 1.5, 2))"))
def b_factor(s, d):
    return filtered(s, d, lambda a: I.b_factor(a, 10.0, 1.5))


@query(weighted(f"pow(2 * pi() * {_R}, 2) * exp(-pow(2 * pi() * {_R}, 2) * 1.44 / 2)"))
def laplacian_of_gaussian(s, d):
    return filtered(s, d, lambda a: I.laplacian_of_gaussian(a, 1.2))


@query(moved("(y + 3) % 8", "(x + 6) % 8"))
def shift_by_phase(s, d):
    return filtered(s, d, lambda a: I.shift(a, 3, -2))


@query(FT + """, s AS (SELECT *, avg(re * re + im * im) OVER (PARTITION BY vec_id, round(sqrt(sy * sy + sx * sx))) AS p FROM f)
SELECT vec_id, (y * 8 + x)::INTEGER AS i, round(sum((re * cos(2 * pi() * (ky * y + kx * x) / 8) - im * sin(2 * pi() * (ky * y + kx * x) / 8)) / sqrt(p)) / 64, 5) + 0.0 AS v
FROM s, range(8) a(y), range(8) b(x) GROUP BY ALL""")
def whiten(s, d):
    return filtered(s, d, I.whitened)


@query(V + """, k AS (SELECT p, q, (p + 1) * (q + 2) / 10.0 AS w FROM range(3) a(p), range(3) b(q))
SELECT vec_id, ((y + p - 1 + 8) % 8 * 8 + (x + q - 1 + 8) % 8)::INTEGER AS i, round(sum(v * w), 5) + 0.0 AS v FROM v, k GROUP BY ALL""")
def convolution(s, d):
    return filtered(s, d, lambda a: I.convolved(a, np.outer(np.arange(1, 4), np.arange(2, 5)) / 10.0))


@query(V + """, c AS (SELECT vec_id, y, x, v - avg(v) OVER (PARTITION BY vec_id) AS v FROM v), k AS (SELECT y, x, v FROM c WHERE vec_id = 0),
n AS (SELECT vec_id, sqrt(sum(v * v) * (SELECT sum(v * v) FROM k)) AS n FROM c GROUP BY 1)
SELECT vec_id, ((c.y - k.y + 8) % 8 * 8 + (c.x - k.x + 8) % 8)::INTEGER AS i, round(sum(c.v * k.v) / any_value(n), 5) + 0.0 AS v FROM c JOIN n USING (vec_id), k GROUP BY ALL""")
def cross_correlation(s, d):
    ref = np.array(images(s, d).where("vec_id = 0").first().pixels).reshape(N, N)  # one image
    return filtered(s, d, lambda a: I.cross_correlation(a, ref))


@query(V + """, b AS (SELECT *, pow(y - 4, 2) + pow(x - 4, 2) > 9 AS bg FROM v),
s AS (SELECT vec_id, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(y * y) AS syy, sum(x * y) AS sxy, sum(v) AS sv, sum(x * v) AS sxv, sum(y * v) AS syv FROM b WHERE bg GROUP BY 1),
c AS (SELECT vec_id, sxx - sx * sx / n AS a, sxy - sx * sy / n AS b, syy - sy * sy / n AS c, sxv - sx * sv / n AS p, syv - sy * sv / n AS q, sx / n AS mx, sy / n AS my, sv / n AS mv FROM s),
g AS (SELECT *, (p * c - q * b) / (a * c - b * b) AS gx, (q * a - p * b) / (a * c - b * b) AS gy FROM c)
SELECT vec_id, (y * 8 + x)::INTEGER AS i, round(v - (gx * (x - mx) + gy * (y - my) + mv), 5) + 0.0 AS v FROM v JOIN g USING (vec_id)""")
def remove_ramp(s, d):
    return filtered(s, d, lambda a: I.without_ramp(a, 3))


def _ctf_grid():
    k = np.fft.fftfreq(N) / 1.5
    y, x = np.meshgrid(k, k, indexing="ij")
    lam = 12.2643247 / np.sqrt(3e5 * (1 + 3e5 * 0.978466e-6))
    r2 = x * x + y * y
    return -np.sin(np.pi * lam * -12000.0 * r2 + np.pi / 2 * 2.7e7 * lam**3 * r2 * r2 - np.arctan(0.1 / np.sqrt(0.99)))


_CTF = "-sin(pi() * l * -12000.0 * r2 + pi() / 2 * 2.7e7 * pow(l, 3) * r2 * r2 - atan(0.1 / sqrt(0.99)))"


def _with_ctf(weight):
    at = f"(SELECT {{}} FROM (SELECT 12.2643247 / sqrt(300000.0 * (1 + 300000.0 * 0.978466e-6)) AS l, pow({_R} / 1.5, 2) AS r2))"
    return weighted(at.format(weight))


@query(_with_ctf(_CTF))
def ctf_application(s, d):
    grid = _ctf_grid()
    return filtered(s, d, lambda a: I.ctf_applied(a, grid))


@query(_with_ctf(f"CASE WHEN {_CTF} < 0 THEN -1 ELSE 1 END"))
def phase_flip(s, d):
    grid = _ctf_grid()
    return filtered(s, d, lambda a: I.ctf_applied(a, grid, True))


@query("""WITH g AS (SELECT k, y, x, (CASE WHEN y > 4 THEN y - 8 ELSE y END) / 12.0 AS fy, (CASE WHEN x > 4 THEN x - 8 ELSE x END) / 12.0 AS fx, 10000.0 + 40 * k AS u, 9000.0 + 25 * k AS v, radians(7.0 * k) AS t,
12.2643247 / sqrt(300000.0 * (1 + 300000.0 * 0.978466e-6)) AS l FROM (SELECT s_suppkey AS k FROM supplier), range(8) a(y), range(8) b(x))
SELECT k, y::INTEGER AS y, x::INTEGER AS x, round(-sin(pi() * l * -((u * pow(cos(t), 2) + v * pow(sin(t), 2)) * fx * fx + 2 * (u - v) * cos(t) * sin(t) * fx * fy + (u * pow(sin(t), 2) + v * pow(cos(t), 2)) * fy * fy)
+ pi() / 2 * 2.7e7 * pow(l, 3) * pow(fx * fx + fy * fy, 2) - radians(20.0) - atan(0.1 / sqrt(0.99))) * exp(-50.0 / 4 * (fx * fx + fy * fy)), 5) + 0.0 AS ctf FROM g""")
def ctf_image(s, d):
    p = table(s, d, "supplier").select(F.col("s_suppkey").alias("k"))
    axis = s.range(N).select(F.col("id").cast("int").alias("y"))
    grid = axis.crossJoin(F.broadcast(axis.withColumnRenamed("y", "x")))  # 64 places
    g = p.crossJoin(F.broadcast(grid))
    fy, fx = (F.when(F.col(c) > 4, F.col(c) - 8).otherwise(F.col(c)) / 12.0 for c in ("y", "x"))
    k = F.col("k")
    v = ctf_.ctf(fx, fy, k * 40 + 10000.0, k * 25 + 9000.0, k * 7.0, F.lit(300.0), F.lit(2.7), F.lit(0.1), b_factor=F.lit(50.0), shift=F.lit(20.0))
    return g.select("k", "y", "x", r(v).alias("ctf"))
