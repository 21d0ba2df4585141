"""Aggregates: column statistics, histograms, fits, moments, spectra, votes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def column_stats(df: DataFrame, column: str) -> DataFrame:
    """Largest, smallest and mean value; an empty table has -99e99, 99e99 and 0."""
    c = F.col(column).cast("double")
    return df.agg(F.coalesce(F.max(c), F.lit(-99e99)).alias("max"), F.coalesce(F.min(c), F.lit(99e99)).alias("min"), F.coalesce(F.avg(c), F.lit(0.0)).alias("avg"))


def extreme_rows(df: DataFrame, column: str, rid: str) -> DataFrame:
    """Row numbers of the largest and smallest value, the first where several have it."""
    return df.agg(F.max_by(rid, F.struct(column, -F.col(rid))).alias("max_row"), F.min_by(rid, F.struct(column, rid)).alias("min_row"))


def sorted_pick(df: DataFrame, column: str, n: int, rid: str) -> DataFrame:
    """The row with the n-th largest value (1 is the largest), or from the smallest for negative n."""
    order = [F.col(column).desc(), F.col(rid)] if n > 0 else [F.col(column), F.col(rid)]
    top = df.orderBy(*order).limit(abs(n))
    back = [F.col(column), F.col(rid).desc()] if n > 0 else [F.col(column).desc(), F.col(rid).desc()]
    return top.orderBy(*back).limit(1)


def order_statistics(df: DataFrame, column: str, ranks: list[int], bins: int = 4096) -> list[float]:
    """Exact values at the given places (from 0) of the sorted column, nulls left out.

    Nothing is sorted or shuffled but counts: each pass counts the values in equal bins of the range that holds a
    place and goes on with its bin, until that holds one value only.
    """
    c = F.col(column).cast("double")
    rows = df.where(c.isNotNull()).select(c.alias("v"))
    low, high = rows.agg(F.min("v"), F.max("v")).first()
    out, known = [], {}
    for rank in ranks:
        lo, hi, before = low, high, 0
        while lo is not None and lo < hi:
            if (lo, hi) not in known:
                at = F.least(F.lit(bins - 1), F.floor((F.col("v") - lo) / ((hi - lo) / bins)).cast("int"))
                counted = rows.where(F.col("v").between(lo, hi)).groupBy(at.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
                known[lo, hi] = sorted(counted.collect(), key=lambda r: r.b)  # at most ``bins`` rows
            for r in known[lo, hi]:
                if rank < before + r.n:
                    lo, hi = r.lo, r.hi
                    break
                before += r.n
            else:
                raise IndexError(rank)
        out.append(lo)
    return out


def histogram(df: DataFrame, column: str, bins: int | None = None, low: float | None = None, high: float | None = None, iqr: str = "upper", most_bins: int = 5000) -> DataFrame:
    """(bin, count): bin 0 and the last hold what is below and above.

    Quartiles are values at n/4, n/2 and 3n/4 of the sorted column. iqr "upper" takes the third quartile less the
    median, "standard" less the first. Without bins, their width is 2 iqr / n^(1/3). low and high hold only with
    bins. A value less than one width below low counts in bin 1, as truncation has it.
    """
    c = F.col(column).cast("double")
    base = df.where(c.isNotNull()).agg(F.count("*").alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi"))
    n, lo, hi = base.first()
    if not n:
        return df.sparkSession.createDataFrame([], "bin long, count long")
    q1, q2, q3 = order_statistics(df, column, [min(n - 1, k) for k in (n // 4, n // 2, 3 * n // 4)])
    spread = q3 - (q2 if iqr == "upper" else q1)
    if bins is None:
        if spread == 0:
            bins, width = 1, 1.0
        else:
            bins = int(min(np.ceil((hi - lo) / (2 * spread / n ** (1 / 3))), most_bins)) or 1
            width = (hi - lo) / bins
    else:
        lo, hi = (lo if low is None else low), (hi if high is None else high)
        width = (hi - lo) / bins
    width = width or 1.0
    bin_ = F.greatest(F.lit(0), F.least(F.lit(bins + 1), ((c - lo) / width).cast("long") + 1))
    return df.where(c.isNotNull()).groupBy(F.when(c <= lo - width, F.lit(0)).otherwise(bin_).cast("long").alias("bin")).count()


def moments(df: DataFrame, column: str, *groups: str) -> DataFrame:
    """Sum, mean, population deviation, skewness and kurtosis (3 for a normal distribution), 0 for constants."""
    c = F.col(column)
    flat = F.stddev_pop(c) == 0
    return df.groupBy(*groups).agg(
        F.sum(c).alias("sum"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("sigma"),
        F.when(flat, 0.0).otherwise(F.skewness(c)).alias("skew"), F.when(flat, 0.0).otherwise(F.kurtosis(c) + 3).alias("kurtosis"),
    )


def line_fit(df: DataFrame, x: str, y: str, w: Column, *groups: str) -> DataFrame:
    """Weighted least squares: slope, intercept, r2."""
    X, Y = F.col(x), F.col(y)
    s = df.groupBy(*groups).agg(*[F.sum(e).alias(k) for k, e in {"w": w, "x": w * X, "y": w * Y, "xx": w * X * X, "xy": w * X * Y, "yy": w * Y * Y}.items()])
    sxx, sxy, syy = (F.expr(e) for e in ("xx - x * x / w", "xy - x * y / w", "yy - y * y / w"))
    s = s.withColumn("slope", F.try_divide(sxy, sxx)).withColumn("r2", F.try_divide(sxy * sxy, sxx * syy))
    return s.select(*groups, "slope", F.expr("(y - slope * x) / w").alias("intercept"), "r2")


def plane_fit(df: DataFrame, x: str, y: str, z: str, w: Column) -> tuple[float, float, float]:
    """a, b, c of z = a x + b y + c with weights squared. Six sums come to the driver."""
    v = {"x": F.col(x), "y": F.col(y), "1": F.lit(1.0), "z": F.col(z)}
    names = [(p, q) for p in ("x", "y", "1") for q in ("x", "y", "1", "z")]
    s = dict(zip(names, df.agg(*[F.sum(w * w * v[p] * v[q]) for p, q in names]).first(), strict=True))
    m = np.array([[s[p, q] for q in ("x", "y", "1")] for p in ("x", "y", "1")])
    return tuple(np.linalg.solve(m, [s[p, "z"] for p in ("x", "y", "1")]).tolist())


def covariance(df: DataFrame, vector: str) -> DataFrame:
    """(i, j, cov) of an array column, population covariance, j >= i. One row for each pair of places."""
    v = df.select(F.posexplode(vector).alias("i", "a"), F.col(vector).alias("__v"))
    pairs = v.select("i", F.col("a").cast("double").alias("a"), F.posexplode("__v").alias("j", "b")).where("j >= i")
    return pairs.groupBy("i", "j").agg(F.covar_pop("a", F.col("b").cast("double")).alias("cov"))


def principal(df: DataFrame, vector: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues and their vectors; the matrix, d x d, is solved on the driver."""
    rows = covariance(df, vector).collect()
    d = 1 + max((r.j for r in rows), default=-1)
    m = np.zeros((d, d))
    for r in rows:
        m[r.i, r.j] = m[r.j, r.i] = r["cov"]
    values, vectors = np.linalg.eigh(m)
    return values[::-1][:k], vectors[:, ::-1][:, :k]


def shell_average(voxels: DataFrame, value: str, *axes: str) -> DataFrame:
    """Mean value of each shell of rounded radius of a long table of voxels."""
    r = F.sqrt(sum((F.pow(F.col(a).cast("double"), F.lit(2.0)) for a in axes), F.lit(0.0)))
    return voxels.groupBy(F.round(r).cast("long").alias("shell")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def shell_correlation(df: DataFrame, shell: str, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """Normalised correlation of complex coefficients (re, im) of each shell; 0 where a side has no power."""
    (ar, ai), (br, bi) = ((F.col(x), F.col(y)) for x, y in (a, b))
    s = df.groupBy(shell).agg(F.sum(ar * br + ai * bi).alias("n"), F.sum(ar * ar + ai * ai).alias("p"), F.sum(br * br + bi * bi).alias("q"))
    return s.select(shell, F.coalesce(F.try_divide(F.col("n"), F.sqrt(F.col("p") * F.col("q"))), F.lit(0.0)).alias("fsc"))


def first_below(curve: DataFrame, shell: str, value: str, threshold: float) -> DataFrame:
    """The last shell before the curve first falls under the threshold."""
    return curve.agg((F.coalesce(F.min(F.when(F.col(value) < threshold, F.col(shell))), F.max(shell) + 1) - 1).cast("long").alias("last_shell"))


def centre_of_mass(voxels: DataFrame, value: str, *axes: str) -> DataFrame:
    return voxels.where(F.col(value) > 0).agg(*[(F.sum(F.col(a) * F.col(value)) / F.sum(value)).alias(f"com_{a}") for a in axes])


def vote(df: DataFrame, unit: list[str], group: str, threshold: float, relative: bool = True) -> DataFrame:
    """The group with most votes in each unit, if its (relative) count reaches the threshold, else "rest"; the first group wins ties."""
    n = df.groupBy(*unit, group).agg(F.count("*").alias("votes"))
    n = n.groupBy(*unit).agg(F.max_by(F.struct("votes", group), F.struct("votes", *[-F.ascii(F.col(group))])).alias("best"), F.sum("votes").alias("total"))
    share = F.col("best.votes") / F.col("total") if relative else F.col("best.votes")
    return n.select(*unit, F.when(share >= threshold, F.col(f"best.{group}")).otherwise("rest").alias("vote"), F.col("best.votes").alias("votes"))


def class_score(selection: Column, job_score: Column, resolution: Column, best_resolution: Column) -> Column:
    """Score of a class from its job's score, how it was selected, and its resolution."""
    w = F.pow(best_resolution / resolution, F.lit(2.0)) / 4
    gain = F.when(selection == 1, 0.75 + w).when(selection == 2, 0.25 + w).when(selection.isin(3, 4), w).when(selection == 5, 0.5 + w).otherwise(0.0)
    return F.when(job_score == -1, -1.0).otherwise(gain * job_score)


def group_sizes(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def frame_average(df: DataFrame, frame: str, every: int, value: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys, F.floor(F.col(frame) / every).cast("long").alias("bin")).agg(F.avg(value).alias("mean"))


def nearest_rank(df: DataFrame, column: str, *groups: str) -> DataFrame:
    w = Window.partitionBy(*groups).orderBy(column)
    return df.withColumn("rank", F.row_number().over(w) - 1)
