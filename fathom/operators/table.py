"""Projection, filter, sort, split and combination operators on tables. All are lazy unless they say otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULTS = {T.StringType: "", T.BooleanType: False, T.DoubleType: 0.0, T.FloatType: 0.0, T.IntegerType: 0, T.LongType: 0}


def _default(kind: T.DataType):
    return F.lit(DEFAULTS.get(type(kind))).cast(kind)


def with_row_id(df: DataFrame, *keys: str, name: str = "rid") -> DataFrame:
    """Rows numbered from 0 in the order of keys, without a single-partition window (eager: one sort, kept).

    The sorted rows are checkpointed where spark.checkpoint.dir is set, else cached; only one count for each
    partition comes to the driver.
    """
    return number_rows(df.repartitionByRange(*keys).sortWithinPartitions(*keys), name)


def number_rows(ordered: DataFrame, name: str = "rid") -> DataFrame:
    """Rows of an ordered table numbered from 0 (eager: the rows are kept, see with_row_id)."""
    s, df = ordered.withColumn("__m", F.monotonically_increasing_id()), ordered
    s = s.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else s.cache()
    s = s.withColumn("__p", F.shiftright("__m", 33))
    counts = s.groupBy("__p").count().collect()  # a number for each partition
    at, offsets = 0, []
    for r in sorted(counts, key=lambda r: r["__p"]):
        offsets.append((r["__p"], at))
        at += r["count"]
    table = df.sparkSession.createDataFrame(offsets, "__p long, __before long")
    place = (F.col("__before") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")
    return s.join(F.broadcast(table), "__p").withColumn(name, place).drop("__m", "__p", "__before")


# --- columns ---------------------------------------------------------------------------------------------------


def remove_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def add_column(df: DataFrame, name: str, kind: str, value=None, copy_from: str | None = None) -> DataFrame:
    """A column of the given type from a constant or, for any type, from another column; exactly one of them."""
    if (value is None) == (copy_from is None):
        raise ValueError("give either a value or a column to copy from")
    return df.withColumn(name, (F.lit(value) if copy_from is None else F.col(copy_from)).cast(kind))


def operate(df: DataFrame, columns: list[str], multiply_by: float = 1.0, add_to: float = 0.0, set_to=None) -> DataFrame:
    """x * multiply_by + add_to in each column, or set_to, which wins. The first column's type is taken for all; whole numbers truncate."""
    kind = df.schema[columns[0]].dataType
    if set_to is None and not isinstance(kind, T.NumericType):
        raise TypeError(f"no arithmetic on {kind.simpleString()}")
    value = {c: F.lit(set_to) if set_to is not None else F.col(c) * multiply_by + add_to for c in columns}
    return df.withColumns({c: v.cast(kind) for c, v in value.items()})


def fill_defaults(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns that are absent, with their type's default; nulls in present ones become the default too."""
    for c, kind in columns.items():
        t = T._parse_datatype_string(kind)
        df = df.withColumn(c, F.coalesce(F.col(c), _default(t)) if c in df.columns else _default(t))
    return df


# --- filters ---------------------------------------------------------------------------------------------------


def range_select(df: DataFrame, column: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Rows with low <= column <= high."""
    if not isinstance(df.schema[column].dataType, T.NumericType):
        raise TypeError(f"{column} is not numeric")
    return df.where((F.lit(True) if low is None else F.col(column) >= low) & (F.lit(True) if high is None else F.col(column) <= high))


def substring_select(df: DataFrame, column: str, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """Rows whose text has (or has not) a substring, by case."""
    if (include is None) == (exclude is None):
        raise ValueError("give either include or exclude")
    return df.where(F.contains(column, F.lit(include)) if exclude is None else ~F.contains(column, F.lit(exclude)))


def renumber_groups(rows: DataFrame, groups: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Drops groups without rows and numbers the others from 1 in their order. groups is a small dimension."""
    used = groups.join(rows.select(key).distinct(), key, "left_semi")
    new = used.orderBy(key).select(key).withColumn("__new", F.row_number().over(_whole(key)))
    renumbered = [x.join(new, key).drop(key).withColumnRenamed("__new", key) for x in (rows, used)]
    return renumbered[0], renumbered[1]


def _whole(*order):
    from pyspark.sql import Window

    return Window.orderBy(*order)


def sigma_clip(df: DataFrame, mean: str, deviation: str, k: float) -> DataFrame:
    """Rows strictly within k population deviations of the ensemble mean, in both statistics."""
    e = df.agg(F.avg(mean).alias("m1"), F.stddev_pop(mean).alias("s1"), F.avg(deviation).alias("m2"), F.stddev_pop(deviation).alias("s2"))
    near = (F.abs(F.col(mean) - F.col("m1")) < k * F.col("s1")) & (F.abs(F.col(deviation) - F.col("m2")) < k * F.col("s2"))
    return df.crossJoin(F.broadcast(e)).where(near).drop("m1", "s1", "m2", "s2")  # one row broadcast


def tilt_deviation(df: DataFrame, tilt: str, most: float) -> DataFrame:
    return df.where(F.abs(F.col(tilt) - 90) < most)


def circular(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.when(d > 180, F.abs(d - 360)).otherwise(d)


def psi_deviation(df: DataFrame, psi: str, prior: str, most: float) -> DataFrame:
    return df.where(circular(F.col(psi), F.col(prior)) < most)


def open_ranges(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows strictly inside all ranges; ranges of absent columns do not count."""
    inside = [(F.col(c) > a) & (F.col(c) < b) for c, (a, b) in ranges.items() if c in df.columns]
    return df.where(reduce(lambda x, y: x & y, inside, F.lit(True)))


def unfinished(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    return inputs.join(outputs.select(key), key, "left_anti")


def relative_score_select(df: DataFrame, score: str, low: float, high: float = 1.0) -> DataFrame:
    """Rows whose score is between the given shares of the best score."""
    best = df.agg(F.max(score).alias("__best"))
    return df.crossJoin(F.broadcast(best)).where(F.col(score).between(low * F.col("__best"), high * F.col("__best"))).drop("__best")


# --- order, splits, samples --------------------------------------------------------------------------------


def sort_rows(df: DataFrame, column: str, rid: str, reverse: bool = False, part: str | None = None) -> DataFrame:
    """Sorted rows, ties in row order, all of it reversed on request; part "before" or "after" sorts on that side of @."""
    key = F.col(column) if part is None else F.substring_index(column, "@", 1 if part == "before" else -1)
    return df.orderBy(key.desc(), F.col(rid).desc()) if reverse else df.orderBy(key, rid)


def random_key(key: str | Column, seed: int | str) -> Column:
    """A whole number below 2**32 that any engine with md5 can give."""
    c = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(F.concat(c.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long")


def shuffle_rows(df: DataFrame, key: str, seed: int) -> DataFrame:
    return df.orderBy(random_key(key, seed), key)


def split_rows(df: DataFrame, rid: str, size: int | None = None, parts: int | None = None, total: int | None = None) -> DataFrame:
    """Rows with their split, from 0. With size and parts, rows beyond the last split go; with parts alone, equal sizes and the rest in the last."""
    if size is None:
        n = (total if total is not None else df.count()) // parts
        return df.withColumn("split", F.least(F.floor(F.col(rid) / max(n, 1)), F.lit(parts - 1)).cast("long"))
    out = df.withColumn("split", F.floor(F.col(rid) / size).cast("long"))
    return out if parts is None else out.where(F.col("split") < parts)


def cap_each(df: DataFrame, group: str, most: int, *order) -> DataFrame:
    """At most so many rows of each group, the first in the given order."""
    from pyspark.sql import Window

    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def top_up(classes: DataFrame, selected: Column, score: str, size: str, least_size: int, key: str) -> DataFrame:
    """Selected classes, and the best others until least_size members are reached. classes is a small table of a model."""
    from pyspark.sql import Window

    w = _whole(F.col("__sel").desc(), F.col(score).desc(), F.col(key)).rowsBetween(Window.unboundedPreceding, -1)
    had = classes.withColumn("__sel", selected.cast("int")).withColumn("__before", F.coalesce(F.sum(size).over(w), F.lit(0)))
    return had.where((F.col("__sel") == 1) | (F.col("__before") < least_size)).drop("__sel", "__before")


# --- combination -------------------------------------------------------------------------------------------


def combine(*tables: DataFrame) -> DataFrame:
    """All rows of all tables in the columns that all have, in the first one's order."""
    shared = [c for c in tables[0].columns if all(c in t.columns for t in tables)]
    return reduce(DataFrame.unionByName, (t.select(*shared) for t in tables))


def append_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    if not same_labels(a, b):
        raise ValueError("tables differ in their columns")
    return a.unionByName(b)


def same_labels(a: DataFrame, b: DataFrame) -> bool:
    return set(a.columns) == set(b.columns)


def combine_padded(*tables: DataFrame) -> DataFrame:
    """All rows in the columns that any table has, with type defaults where a table lacks one."""
    kinds = {}
    for t in tables:
        for f in t.schema.fields:
            kinds.setdefault(f.name, f.dataType)
    return reduce(DataFrame.unionByName, (t.select(*[F.col(c) if c in t.columns else _default(k).alias(c) for c, k in kinds.items()]) for t in tables))


def combine_rekeyed(tables: list[tuple[DataFrame, DataFrame]], key: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(rows, groups) of several (rows, groups) tables: equal names become one group, others get new numbers by first appearance.

    groups are dimensions; whether they are broadcast is left to their size.
    """
    named = [g.select(key, name, F.lit(i).alias("__t")) for i, (_, g) in enumerate(tables)]
    firsts = reduce(DataFrame.unionByName, named).groupBy(name).agg(F.min(F.struct("__t", key)).alias("first"))
    numbered = firsts.withColumn("__new", F.row_number().over(_whole("first"))).drop("first")
    rows = []
    for i, (r, _) in enumerate(tables):
        rows.append(r.join(named[i].join(numbered, name).select(key, "__new"), key).drop(key).withColumnRenamed("__new", key))
    return combine(*rows), numbered.select(F.col("__new").alias(key), name)
