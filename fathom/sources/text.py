"""Fixed-width and keyed text sources: atoms, coordinates, tilt-series notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_atoms(spark: SparkSession, paths) -> DataFrame:
    """Atoms of PDB files."""
    cut = {"serial": (7, 5, "int"), "name": (13, 4, "string"), "residue": (18, 3, "string"), "chain": (22, 1, "string"), "number": (23, 4, "int"), "x": (31, 8, "double"), "y": (39, 8, "double"), "z": (47, 8, "double"), "occupancy": (55, 6, "double"), "b_factor": (61, 6, "double")}
    rows = spark.read.text(paths).where(F.substring("value", 1, 6).isin("ATOM  ", "HETATM"))
    return rows.select(*[F.trim(F.substring("value", a, n)).try_cast(t).alias(c) for c, (a, n, t) in cut.items()])


def read_boxes(spark: SparkSession, paths) -> DataFrame:
    """Centres of boxes (corner x, corner y, width, height) of text files."""
    v = F.split(F.trim("value"), r"\s+")
    n = [F.try_element_at(v, F.lit(k)).try_cast("double") for k in range(1, 5)]
    return spark.read.text(paths).select(F.col("_metadata.file_path").alias("file_path"), (n[0] + n[2] / 2).alias("x"), (n[1] + n[3] / 2).alias("y")).where("x is not null and y is not null")


def read_tilt_notes(spark: SparkSession, paths) -> DataFrame:
    """One row for each [ZValue] section of mdoc files, its keys as a map, ordered by DateTime in each file."""
    lines = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), F.posexplode(F.split("value", r"\[ZValue = ")))
    pairs = F.filter(F.split("col", "\n"), lambda x: F.contains(x, F.lit(" = ")))
    keys = F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, " = ", 1)).alias("k"), F.trim(F.regexp_replace(x, "^.*? = ", "")).alias("v"))))
    rows = lines.where("pos > 0").select("file_path", F.regexp_extract("col", r"^(\d+)", 1).cast("int").alias("z"), keys.alias("keys"))
    when = F.coalesce(F.try_to_timestamp(F.col("keys")["DateTime"], F.lit("dd-MMM-yy  HH:mm:ss")), F.try_to_timestamp(F.col("keys")["DateTime"]))
    return rows.withColumn("order", F.row_number().over(Window.partitionBy("file_path").orderBy(when, "z")) - 1)
