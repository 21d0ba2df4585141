"""Tilt-series geometry: projection matrices, particle positions, groups of tomograms."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rotation(axis: str, degrees: float) -> np.ndarray:
    """Right-handed 4 x 4 rotation about x, y or z."""
    a = math.radians(degrees)
    c, s = math.cos(a), math.sin(a)
    i, j = {"x": (1, 2), "y": (2, 0), "z": (0, 1)}[axis]
    m = np.eye(4)
    m[i, i], m[i, j], m[j, i], m[j, j] = c, -s, s, c
    return m


def translation(*shift: float) -> np.ndarray:
    m = np.eye(4)
    m[: len(shift), 3] = shift
    return m


def projection(tilt: float, axis: float, x_tilt: float, shift: tuple[float, float], specimen: tuple[float, float, float], image: tuple[float, float]) -> np.ndarray:
    """From a position in the specimen to one in the tilt image: centre, tilts, in-plane rotation, shift, image centre."""
    centre = translation(*(-x for x in specimen))
    return translation(*image) @ translation(*shift) @ rotation("z", axis) @ rotation("y", tilt) @ rotation("x", x_tilt) @ centre


def projected(matrix: Column, x: Column, y: Column, z: Column) -> list[Column]:
    """x and y in the image of a position, by a matrix of rows of four numbers in one array."""
    return [matrix[4 * r] * x + matrix[4 * r + 1] * y + matrix[4 * r + 2] * z + matrix[4 * r + 3] for r in (0, 1)]


def per_tilt(particles: DataFrame, tilts: DataFrame, tomogram: str, matrix: str = "matrix") -> DataFrame:
    """A row for each particle and tilt image of its tomogram, with the particle's place in the image."""
    j = particles.join(tilts, tomogram)
    px, py = projected(F.col(matrix), F.col("x"), F.col("y"), F.col("z"))
    return j.withColumns({"image_x": px, "image_y": py})


def centred_positions(particles: DataFrame, tomograms: DataFrame, tomogram: str, binning: float = 1.0) -> DataFrame:
    """Positions in Angstrom from the tomogram's centre. tomograms has pixel, size_x, size_y and size_z."""
    j = particles.join(tomograms, tomogram)
    return j.withColumns({c: F.col(c) * F.col("pixel") * binning - (F.col(f"size_{c}") / 2 - 1) * F.col("pixel") for c in ("x", "y", "z")}).drop("size_x", "size_y", "size_z")


def split_optics(particles: DataFrame, optics: DataFrame, tomogram: str, group: str, name: str) -> tuple[DataFrame, DataFrame]:
    """One optics group for each tomogram, a copy of the first optics row named after it. Tomograms are a small dimension."""
    toms = particles.select(tomogram).distinct().withColumn("__g", F.row_number().over(Window.orderBy(tomogram)))
    first = optics.orderBy(group).limit(1).drop(group, name)
    new = toms.crossJoin(F.broadcast(first)).withColumnRenamed("__g", group).withColumn(name, F.col(tomogram)).drop(tomogram)
    return particles.drop(group).join(F.broadcast(toms.withColumnRenamed("__g", group)), tomogram), new


def even_split(lists: DataFrame, key: str, size: str, workers: int) -> DataFrame:
    """Worker of each list, so that sizes even out: lists by falling size in turn, there and back."""
    k = F.row_number().over(Window.orderBy(F.desc(size), key)) - 1
    lap, at = F.floor(k / workers), k % workers
    return lists.withColumn("worker", F.when(lap % 2 == 0, at).otherwise(workers - 1 - at).cast("int"))
