"""Sets of tables in STAR files: rows with their optics groups, tilt series with their global table, and large tables
written in parts."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import undefined_groups
from ..session import ship
from .star import blocks, formatted_column, read_star, write_star

ROWS = ("particles", "micrographs", "movies", "tilt_images")  # tables that may stand beside optics, the first that is there counts


def _text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first().value


def load_with_optics(spark: SparkSession, path: str, name: str = "discover", types: dict[str, str] | None = None, group: str = "optics_group") -> tuple[DataFrame, DataFrame, str]:
    """(rows, optics, name of the rows' table) of a file. Fails without optics, or where a row's group is not defined."""
    there = {b[0]: b[2] for b in blocks(_text(spark, path))}
    found = next((n for n in ROWS if n in there), None) if name == "discover" else name if name in there else None
    if found is None or "optics" not in there:
        raise ValueError(f"{path}: no table of {', '.join(ROWS) if name == 'discover' else name} beside one of optics")
    rows, optics = (read_star(spark, path, n, types, there[n]) for n in (found, "optics"))
    missing = [r[0] for r in undefined_groups(rows, optics, group).limit(20).collect()]
    if missing:
        raise ValueError(f"{path}: undefined groups {missing}")
    return rows, optics.drop("file_path", "rid"), found


def save_with_optics(rows: DataFrame, optics: DataFrame, path: str, name: str = "particles", general: DataFrame | None = None, order: str | None = None) -> None:
    """One file with the general table, if there is one, optics and the rows, renamed into place when complete."""
    write_star(({"general": general} if general is not None else {}) | {"optics": optics, name: rows}, path, order)


def read_tilt_series(spark: SparkSession, path: str, name: str, file: str, types: dict[str, str] | None = None, series: str | None = None, root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(global table without the files' column, images of all tilt series or of one) of a set.

    The global table names each series and its file, relative to root (the set's folder); images carry the series' name.
    """
    root = os.path.dirname(path) if root is None else root
    whole = read_star(spark, path, "global", (types or {}) | {name: "string"})
    whole = whole if series is None else whole.where(F.col(name) == series)
    listed = whole.orderBy("rid").select(name, file).collect()  # one row for each tilt series
    if not listed:
        raise ValueError(f"{path}: no tilt series" + (f" {series}" if series else ""))
    full = {r[0]: r[1] if os.path.isabs(r[1]) or "://" in r[1] else os.path.join(root, r[1]) for r in listed}
    images = read_star(spark, list(full.values()), None, types)
    last = F.substring_index("file_path", "/", -1)
    names = spark.createDataFrame([(n, os.path.basename(p)) for n, p in full.items()], "__name string, __file string")
    images = images.drop(name).withColumn("__file", last).join(F.broadcast(names), "__file").withColumnRenamed("__name", name).drop("__file", "file_path")
    return whole.drop(file, "file_path"), images


def write_tilt_series(whole: DataFrame, images: DataFrame, path: str, name: str, file: str, order: str) -> None:
    """A set: the global table at path and one file for each tilt series beside it. Series are a small dimension."""
    folder = os.path.join(os.path.dirname(path), "tilt_series")
    os.makedirs(folder, exist_ok=True)
    for r in whole.select(name).collect():
        write_star({r[0]: images.where(F.col(name) == r[0])}, os.path.join(folder, f"{r[0]}.star"), order)
    write_star({"global": whole.withColumn(file, F.concat(F.lit("tilt_series/"), F.col(name), F.lit(".star")))}, path, name)


def write_parts(df: DataFrame, folder: str, name: str, rows: int = 100_000) -> None:
    """A large table as a folder of files of at most so many rows, each complete with its header, written by the tasks that hold the rows."""
    ship(df.sparkSession)
    fields = [x for x in df.schema.fields if x.name not in ("rid", "file_path")]
    head = ["", f"data_{name}", "", "loop_", *[f"_{x.name} #{k}" for k, x in enumerate(fields, 1)]]

    def run(batches):
        n = 0
        for b in batches:
            cols = [formatted_column(b.column(x.name).to_pylist(), x.dataType) for x in fields]
            lines = list(map(" ".join, zip(*cols, strict=True)))
            cuts = [0, *range(-n % rows, len(lines), rows), len(lines)]  # where files begin, each with the header
            out = lines[: cuts[1]]
            for i, j in zip(cuts[1:], cuts[2:], strict=False):
                out += head + lines[i:j]
            n += len(lines)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    lines = df.select([x.name for x in fields]).mapInArrow(run, "value string")
    lines.write.mode("overwrite").option("maxRecordsPerFile", len(head) + rows).text(folder)


def count_rows(spark: SparkSession, paths, table: str | None = None) -> DataFrame:
    """(file_path, n) rows of a table in each file, without making them; 0 where a file lacks it."""
    ship(spark)

    def run(batches):
        for b in batches:
            n = []
            for text in b.column("value").to_pylist():
                total, seen, wanted, loop, ended, listed = 0, False, False, False, False, False
                for line in text.split("\n"):
                    line = line.strip()
                    if line.startswith("data_"):
                        wanted = line[5:] == table if table is not None else not seen
                        seen, loop, ended = True, False, False
                    elif not wanted or line.startswith("#"):
                        continue
                    elif line == "loop_":
                        loop = True
                    elif line.startswith("_"):
                        listed = listed or not loop
                    elif loop and line and not ended:
                        total += 1
                    elif loop and total and not line:
                        ended = True
                n.append(total if total or not listed else 1)
            yield pa.RecordBatch.from_arrays([b.column("file_path"), pa.array(n, pa.int64())], names=["file_path", "n"])

    return spark.read.text(paths, wholetext=True).select("value", "_metadata.file_path").mapInArrow(run, "file_path string, n long")


def scan_lines(spark: SparkSession, paths, labels: list[str], types: dict[str, str] | None = None) -> DataFrame:
    """Rows of files that hold one loop each, cut by the scan itself, so that one large file is many tasks.

    Values are words between blanks; quoted blanks need read_star. Types are cast as written, nothing leaves the JVM.
    """
    types = types or {}
    line = F.trim(F.regexp_replace("value", r"\s+", " "))
    kept = spark.read.text(paths).select(line.alias("v")).where("v <> ''").where(~F.col("v").rlike("^(data_|loop_|_|#)"))
    words = F.split("v", " ")
    return kept.select(*[F.get(words, F.lit(k)).try_cast(T._parse_datatype_string(types.get(c, "string"))).alias(c) for k, c in enumerate(labels)])
