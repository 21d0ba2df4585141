"""One row to many: symmetry mates, helical copies, segments of tubes, points on spheres."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cyclic_expand(df: DataFrame, n: int, rot: str) -> DataFrame:
    """Each row and its mates of an n-fold axis along z; mate counts from 0."""
    return df.withColumn("mate", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(rot, F.pmod(F.col(rot) + F.col("mate") * (360.0 / n) + 180.0, F.lit(360.0)) - 180.0)


def helical_expand(df: DataFrame, units: int, rise: float, twist: float, rot: str, tilt: str, psi: str, x: str, y: str) -> DataFrame:
    """Copies at z = -(units-1)/2 .. units/2 of a helix; z = 0 is the row itself."""
    z = F.explode(F.sequence(F.lit(-((units - 1) // 2)), F.lit(units // 2)))
    out = df.withColumn("z", z)
    step = F.sin(F.radians(tilt)) * F.col("z") * rise
    return out.withColumns({rot: F.col(rot) - F.col("z") * twist, x: F.col(x) + step * F.cos(F.radians(psi)), y: F.col(y) - step * F.sin(F.radians(psi))})


def tube_segments(df: DataFrame, tube: str, start: tuple[str, str], end: tuple[str, str], step: float) -> DataFrame:
    """Points every step along the line of each tube, the start included; n counts them."""
    (x1, y1), (x2, y2) = start, end
    length = F.sqrt(F.pow(F.col(x2) - F.col(x1), F.lit(2.0)) + F.pow(F.col(y2) - F.col(y1), F.lit(2.0)))
    out = df.withColumn("__l", length).withColumn("n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("__l") / step).cast("long"))))
    share = F.coalesce(F.try_divide(F.col("n") * step, F.col("__l")), F.lit(0.0))
    return out.select(tube, "n", (F.col(x1) + share * (F.col(x2) - F.col(x1))).alias("x"), (F.col(y1) + share * (F.col(y2) - F.col(y1))).alias("y"))


def sphere_points(df: DataFrame, key: str, x: str, y: str, z: str, radius: str, n: int) -> DataFrame:
    """n points of a golden spiral on each sphere, with the tilt and rotation of the outward normal in degrees."""
    out = df.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    h = 1 - (2 * F.col("i") + 1) / n
    ring, turn = F.sqrt(1 - h * h), F.col("i") * (math.pi * (3 - math.sqrt(5)))
    return out.select(
        key, "i", (F.col(x) + F.col(radius) * ring * F.cos(turn)).alias("px"), (F.col(y) + F.col(radius) * ring * F.sin(turn)).alias("py"), (F.col(z) + F.col(radius) * h).alias("pz"),
        F.degrees(F.acos(h)).alias("tilt"), F.degrees(F.atan2(ring * F.sin(turn), ring * F.cos(turn))).alias("rot"),
    )
