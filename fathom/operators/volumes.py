"""Volumes and spectra: back-projection by voxel sums, symmetry groups, orientation grids, curve fits."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def back_project(df: DataFrame, matrix: str, re: str, im: str, weight: str, size: int) -> DataFrame:
    """(z, y, x, re, im, weight): central slices inserted into a Fourier volume.

    Each row has a centred transform of size x size, row-major, with weights, and a rotation of nine numbers. Slices
    of a batch are summed before rows leave the task, and by voxel after.
    """
    n, c = size, size // 2

    def run(batches):
        k = np.arange(n) - c
        y, x = np.meshgrid(k, k, indexing="ij")
        plane = np.stack((x.ravel(), y.ravel(), np.zeros(n * n)))
        total = np.zeros((3, n**3))
        seen = False
        for b in batches:
            for m, r, i, w in zip(*(b.column(s).to_pylist() for s in (matrix, re, im, weight)), strict=True):
                p = np.array(m).reshape(3, 3).T @ plane + c
                low = np.floor(p).astype(int)
                w = np.array(w, float)
                for corner in np.ndindex(2, 2, 2):
                    at = low + np.array(corner)[:, None]
                    share = np.prod(np.where(np.array(corner)[:, None] == 1, p - low, 1 - (p - low)), 0)
                    ok = ((at >= 0) & (at < n)).all(0) & (share > 0)
                    index = (at[2, ok] * n + at[1, ok]) * n + at[0, ok]
                    for out, v in zip(total, (np.array(r) * w, np.array(i) * w, w), strict=True):
                        out += np.bincount(index, v[ok] * share[ok], n**3)
                seen = True
        at = np.flatnonzero(total[2]) if seen else np.zeros(0, int)
        cols = [pa.array(v, pa.int32()) for v in (at // (n * n), at // n % n, at % n)] + [pa.array(t[at]) for t in total]
        yield pa.RecordBatch.from_arrays(cols, names=["z", "y", "x", "re", "im", "weight"])

    parts = df.select(matrix, re, im, weight).mapInArrow(run, "z int, y int, x int, re double, im double, weight double")
    return parts.groupBy("z", "y", "x").agg(*[F.sum(v).alias(v) for v in ("re", "im", "weight")])


def reconstructed(voxels: DataFrame, tau: float = 0.0) -> DataFrame:
    """Weighted sums divided by their weights, with 1/tau added where tau is given."""
    w = F.col("weight") + (1 / tau if tau else 0.0)
    return voxels.select("z", "y", "x", *[F.coalesce(F.try_divide(F.col(v), w), F.lit(0.0)).alias(v) for v in ("re", "im")])


def ssnr(fsc: Column, whole_map: bool = False) -> Column:
    """Spectral signal-to-noise ratio of a half-map correlation, clamped to 0.001..0.999."""
    f = F.greatest(F.lit(0.001), F.least(F.lit(0.999), fsc))
    f = F.sqrt(2 * f / (1 + f)) if whole_map else f
    return f / (1 - f)


def guinier_fit(df: DataFrame, resolution: str, log_amplitude: str, low: float, high: float) -> DataFrame:
    """(slope, intercept, r2, b_factor) of log amplitudes against squared inverse resolution within a range."""
    from .aggregates import line_fit

    rows = df.where(F.col(resolution).between(low, high)).withColumn("__s", 1 / (F.col(resolution) * F.col(resolution)))
    return line_fit(rows, "__s", log_amplitude, F.lit(1.0)).withColumn("b_factor", 4 * F.col("slope"))


def axis_rotation(axis: tuple[float, float, float], degrees: float) -> np.ndarray:
    """Right-handed rotation about an axis."""
    x, y, z = np.array(axis, float) / np.linalg.norm(axis)
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    a = math.radians(degrees)
    return np.eye(3) + math.sin(a) * k + (1 - math.cos(a)) * k @ k


def symmetry_group(name: str) -> list[np.ndarray]:
    """The rotations of a point group: Cn, Dn, T, O or I, closed under products of its generators."""
    name = name.upper()
    golden = (1 + 5**0.5) / 2
    if name[0] in "CD" and name[1:].isdigit():
        gen = [axis_rotation((0, 0, 1), 360 / int(name[1:]))] + ([axis_rotation((1, 0, 0), 180)] if name[0] == "D" else [])
    elif name in ("T", "O", "I"):
        gen = {"T": [axis_rotation((1, 1, 1), 120), axis_rotation((0, 0, 1), 180)], "O": [axis_rotation((1, 1, 1), 120), axis_rotation((0, 0, 1), 90)], "I": [axis_rotation((0, 1, golden), 72), axis_rotation((0, 0, 1), 180)]}[name]
    else:
        raise ValueError(f"no point group {name}")
    group = [np.eye(3)]
    for m in group:  # grows while it is walked
        for g in gen:
            p = m @ g
            if not any(np.allclose(p, q, atol=1e-6) for q in group):
                group.append(p)
    return group


def orientations(spark: SparkSession, n: int, psi_step: float) -> DataFrame:
    """(id, rot, tilt, psi): n nearly even directions of a golden spiral, each with in-plane angles every psi_step degrees."""
    psis = max(1, round(360 / psi_step))
    i = F.floor(F.col("id") / psis)
    return spark.range(n * psis).select("id", F.pmod(i * (180 * (3 - math.sqrt(5))), F.lit(360.0)).alias("rot"), F.degrees(F.acos(1 - (2 * i + 1) / n)).alias("tilt"), (F.col("id") % psis * (360 / psis)).alias("psi"))


def translations(spark: SparkSession, reach: float, step: float) -> DataFrame:
    """(dx, dy) of a square grid within a circle."""
    k = int(reach / step)
    axis = spark.range(-k, k + 1).select((F.col("id") * step).alias("v"))
    return axis.select(F.col("v").alias("dx")).crossJoin(F.broadcast(axis.select(F.col("v").alias("dy")))).where(F.col("dx") ** 2 + F.col("dy") ** 2 <= reach * reach)


def rotated_volume(volume: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """A cube turned about n // 2, what was at p coming to matrix * p (x, y, z), by linear interpolation; 0 where nothing came."""
    n = volume.shape[0]
    z, y, x = (g - n // 2 for g in np.mgrid[:n, :n, :n])
    p = np.round(np.einsum("ji,jzyx->izyx", matrix, np.stack((x, y, z)).astype(float)) + n // 2, 9)
    low = np.floor(p).astype(int)
    out = np.zeros(volume.shape)
    for c in np.ndindex(2, 2, 2):
        step = np.array(c)[:, None, None, None]
        at = low + step
        w = np.prod(np.where(step == 1, p - low, 1 - (p - low)), 0)
        ok = ((at >= 0) & (at < n)).all(0)
        i, j, k = np.clip(at, 0, n - 1)
        out += np.where(ok, w, 0) * volume[k, j, i]
    return out


def symmetrised(volume: np.ndarray, group: list[np.ndarray]) -> np.ndarray:
    """The mean of a cube over the rotations of a group."""
    return sum(rotated_volume(volume, m) for m in group) / len(group)


def per_volume(df: DataFrame, kernel, pixels: str, n: int) -> DataFrame:
    """The table with a kernel applied to its cubes (arrays of n * n * n, z slowest), one at a time."""
    from pyspark.sql.pandas.types import to_arrow_type

    from ..session import ship

    ship(df.sparkSession)
    kind = to_arrow_type(df.schema[pixels].dataType)

    def run(batches):
        for b in batches:
            out = [None if v is None else kernel(np.array(v, float).reshape(n, n, n)).ravel() for v in b.column(pixels).to_pylist()]
            yield b.set_column(b.schema.names.index(pixels), pixels, pa.array(out, kind))

    return df.mapInArrow(run, df.schema)


def cylinder(spark: SparkSession, n: int, inner: float, outer: float, soft: float) -> DataFrame:
    """(z, y, x, v): a hollow cylinder along z with raised cosine walls outside both radii."""
    i = F.col("id")
    z, y, x = F.floor(i / (n * n)), F.floor(i / n) % n, i % n
    r = F.sqrt(F.pow(y - n // 2, F.lit(2.0)) + F.pow(x - n // 2, F.lit(2.0)))
    beyond = F.greatest(r - outer, inner - r, F.lit(0.0))
    v = F.when(beyond >= soft, 0.0).otherwise(0.5 + 0.5 * F.cos(math.pi * beyond / soft))
    return spark.range(n**3).select(z.cast("int").alias("z"), y.cast("int").alias("y"), x.cast("int").alias("x"), v.alias("v"))


def true_fsc(masked: Column, randomised: Column, shell: Column, start: int) -> Column:
    """A masked correlation freed of what the mask adds, two shells after randomisation began; the masked one before."""
    return F.when(shell < start + 2, masked).otherwise((masked - randomised) / (1 - randomised))


def part_fsc(whole: Column, fraction: Column) -> Column:
    """Correlation that part of a map with this fraction of its signal would have."""
    return fraction * whole / (1 + (fraction - 1) * whole)


def joined_halves(coefficients: DataFrame, shell: str, upto: int, a: list[str], b: list[str]) -> DataFrame:
    """Coefficients of two halves side by side, both replaced by their mean within the first shells."""
    low = F.col(shell) <= upto
    return coefficients.withColumns({c: F.when(low, (F.col(p) + F.col(q)) / 2).otherwise(F.col(c)) for p, q in zip(a, b, strict=True) for c in (p, q)})


def momentum_step(model: DataFrame, gradient: str, velocity: str, value: str, mu: float, rate: float) -> DataFrame:
    """A step down the gradient with momentum: velocity' = mu velocity + (1 - mu) gradient, value' = value - rate velocity'."""
    v = mu * F.col(velocity) + (1 - mu) * F.col(gradient)
    return model.withColumns({velocity: v, value: F.col(value) - rate * v})
