"""Coordinates picked on images: peaks, unions, tubes, curves and tilt pairs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def local_maxima(pixels: DataFrame, image: str, x: str, y: str, value: str, least: float) -> DataFrame:
    """Pixels of a long table that reach ``least`` and exceed their four neighbours, all of which must exist."""
    row = Window.partitionBy(image, y).orderBy(x)
    column = Window.partitionBy(image, x).orderBy(y)
    out, keep = pixels, F.col(value) >= least
    for k, (w, c) in enumerate(((row, x), (column, y))):
        for step, side in ((1, F.lag), (-1, F.lead)):
            name = f"__{k}{step}"
            near = side(c).over(w) == F.col(c) - step
            out = out.withColumn(name, F.when(near, side(value).over(w)))
            keep = keep & F.coalesce(F.col(value) > F.col(name), F.lit(False))
    return out.where(keep).select(pixels.columns)


def combine_picks(first: DataFrame, second: DataFrame, image: str, x: str, y: str, reach: float = 0.1) -> DataFrame:
    """All of the first picks and those of the second that have none of the first within reach in both axes."""
    from .joins import band_pairs

    key = [image, x, y]
    near = band_pairs(second.select(*key), first.select(*key), [(x, x), (y, y)], reach * 2**0.5, [image])
    near = near.where((F.abs(F.col(f"a_{x}") - F.col(f"b_{x}")) < reach) & (F.abs(F.col(f"a_{y}") - F.col(f"b_{y}")) < reach))
    gone = near.select(*[F.col(f"a_{c}").alias(c) for c in key]).distinct()
    return first.unionByName(second.join(gone, key, "left_anti"), allowMissingColumns=True)


def smooth_track_angles(df: DataFrame, tube: list[str], track: str, angle: str, sigma: float, cutoff: float = 3.0) -> DataFrame:
    """Angle of each segment as the Gaussian-weighted mean of unit vectors of segments within cutoff * sigma along its tube."""

    def run(pdf):
        t, a = pdf[track].to_numpy(float), np.radians(pdf[angle].to_numpy(float))
        order = np.argsort(t, kind="stable")
        ts, out = t[order], np.empty(len(t))
        low, high = np.searchsorted(ts, ts - cutoff * sigma, "left"), np.searchsorted(ts, ts + cutoff * sigma, "right")
        for k, (i, j) in enumerate(zip(low, high, strict=True)):
            w = np.exp(-0.5 * ((ts[i:j] - ts[k]) / sigma) ** 2)
            near = a[order[i:j]]
            out[order[k]] = np.degrees(np.arctan2((w * np.sin(near)).sum(), (w * np.cos(near)).sum()))
        return pdf.assign(**{f"{angle}_smooth": out})

    from pyspark.sql import types as T

    return df.groupBy(*tube).applyInPandas(run, T.StructType([*df.schema.fields, T.StructField(f"{angle}_smooth", T.DoubleType())]))


def tube_polarity(df: DataFrame, tube: list[str], flipped: str) -> DataFrame:
    """Whether each tube as a whole is to be turned, from the share of its segments that are, smoothed by one of each."""
    share = (F.sum(F.col(flipped).cast("int")) + 1) / (F.count("*") + 2)
    return df.groupBy(*tube).agg((share > 0.5).alias("turn"))


def curve_points(df: DataFrame, curve: list[str], order: str, x: str, y: str, step: float) -> DataFrame:
    """Points every ``step`` along the smooth curve (cubic Hermite, tangents from neighbours) through picked points."""

    def run(pdf):
        import pandas as pd

        p = pdf.sort_values(order)[[x, y]].to_numpy(float)
        if len(p) < 2:
            fine = p
        else:
            m = np.gradient(p, axis=0)
            u = np.linspace(0, 1, 64, endpoint=False)[:, None]
            h = (2 * u**3 - 3 * u**2 + 1, u**3 - 2 * u**2 + u, -2 * u**3 + 3 * u**2, u**3 - u**2)
            fine = np.concatenate([h[0] * p[k] + h[1] * m[k] + h[2] * p[k + 1] + h[3] * m[k + 1] for k in range(len(p) - 1)] + [p[-1:]])
        length = np.concatenate(([0], np.cumsum(np.hypot(*np.diff(fine, axis=0).T)))) if len(fine) > 1 else np.zeros(len(fine))
        at = np.arange(0, length[-1] + 1e-9, step) if len(fine) else np.zeros(0)
        out = {c: [pdf[c].iloc[0]] * len(at) for c in curve}
        return pd.DataFrame({**out, "n": np.arange(len(at)), x: np.interp(at, length, fine[:, 0]), y: np.interp(at, length, fine[:, 1])})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in curve)
    return df.groupBy(*curve).applyInPandas(run, f"{fields}, n long, `{x}` double, `{y}` double")


def tilt_pairs(untilted: DataFrame, tilted: DataFrame, matrix: list[list[float]], shift: tuple[float, float], reach: float, rid: str = "rid") -> DataFrame:
    """Pairs of untilted points, mapped, and tilted points strictly within reach, each tilted point with its nearest."""
    from .joins import band_pairs, nearest_free

    m = matrix
    mapped = untilted.select(rid, (m[0][0] * F.col("x") + m[0][1] * F.col("y") + shift[0]).alias("x"), (m[1][0] * F.col("x") + m[1][1] * F.col("y") + shift[1]).alias("y"))
    return nearest_free(band_pairs(mapped, tilted.select(rid, "x", "y"), [("x", "x"), ("y", "y")], reach).where(F.col("distance") < reach))


def name_contains(rows: DataFrame, names: DataFrame, column: str, name: str) -> DataFrame:
    """Rows whose text equals a name or ends in /name: the equi-join form of a substring match, without prefixes of other names."""
    last = F.substring_index(F.col(column), "/", -1)
    return rows.withColumn("__k", last).join(names.select(F.substring_index(F.col(name), "/", -1).alias("__k")).distinct(), "__k", "left_semi").drop("__k")
