"""Order-dependent operators: duplicates by distance, grouping with reset, halves, doses, weights."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .joins import band_pairs
from .table import random_key


def _near_cell(on: list[str], reach: float) -> list[Column]:
    """Cells so small that all rows of one are within reach of each other."""
    width = reach / len(on) ** 0.5 * (1 - 1e-9)
    return [(F.floor(F.col(c) / width) if reach > 0 else F.col(c)).alias(f"__{k}") for k, c in enumerate(on)]


def remove_near(df: DataFrame, group: list[str], on: list[str], reach: float, rid: str) -> DataFrame:
    """Rows without a later row of their group within reach (inclusive). Removed rows still remove earlier ones.

    Of a cell in which all rows are near each other only the last can stay; only these last ones meet the rows around
    them, so the pairs looked at grow with the rows however dense a place is.
    """
    keys = df.select(*group, *on, rid)
    last = keys.groupBy(*group, *_near_cell(on, reach)).agg(F.max_by(F.struct(*on, rid), rid).alias("__r")).select(*group, "__r.*")
    gone = band_pairs(last, keys, [(c, c) for c in on], reach, group).where(F.col(f"b_{rid}") > F.col(f"a_{rid}")).select(F.col(f"a_{rid}").alias(rid)).distinct()
    return df.join(last.select(rid).join(gone, rid, "left_anti"), rid, "left_semi")


def too_close(df: DataFrame, group: list[str], on: list[str], reach: float, rid: str) -> DataFrame:
    """Rows whose nearest neighbour in the group is strictly farther than reach; both of a close pair go.

    Only rows that are alone in their cell (see remove_near) meet the rows around them.
    """
    keys = df.select(*group, *on, rid)
    alone = keys.groupBy(*group, *_near_cell(on, reach)).agg(F.count("*").alias("__n"), F.first(F.struct(*on, rid)).alias("__r")).where("__n = 1").select(*group, "__r.*")
    gone = band_pairs(alone, keys, [(c, c) for c in on], reach, group).where(F.col(f"b_{rid}") != F.col(f"a_{rid}")).select(F.col(f"a_{rid}").alias(rid)).distinct()
    return df.join(alone.select(rid).join(gone, rid, "left_anti"), rid, "left_semi")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def regroup(groups: DataFrame, outer: str, order: list[str], size: str, average: Column | float, label: str = "new_group") -> DataFrame:
    """Consecutive groups gathered into larger ones: within each outer group, in order, sizes add up; when the sum
    exceeds the average a new group starts with the group that made it so, and the sum starts from 0.

    groups is one row for each small group. Outer groups are sorted where they lie and folded row by row in Arrow-backed
    Python, which holds a batch at a time.
    """
    rows = groups.withColumn("__avg", (average if isinstance(average, Column) else F.lit(average)).cast("double"))
    rows = rows.repartition(outer).sortWithinPartitions(outer, *order)
    ship(groups.sparkSession)

    def run(batches):
        now, total, gid = object(), 0.0, 0
        for b in batches:
            out = []
            for o, n, most in zip(*(b.column(c).to_pylist() for c in (outer, size, "__avg")), strict=True):
                if o != now:
                    now, total, gid = o, 0.0, 0
                total += float(n or 0)
                if total > most:
                    total, gid = 0.0, gid + 1
                out.append(gid)
            yield b.drop_columns(["__avg"]).append_column(label, pa.array(out, pa.int64()))

    return rows.mapInArrow(run, T.StructType([*groups.schema.fields, T.StructField(label, T.LongType())]))


def random_halves(df: DataFrame, key: str, seed: int, name: str = "half") -> DataFrame:
    """Half 1 or 2 from a hash of the key."""
    return df.withColumn(name, (F.pmod(random_key(key, seed), F.lit(2)) + 1).cast("int"))


def balanced_halves(groups: DataFrame, key: str, size: str, seed: int) -> DataFrame:
    """Groups in random order, each to the smaller half, ties to half 2. groups is a table of groups with sizes.

    Each choice depends on all before it, so the sorted groups (not their rows) pass one task, a batch at a time.
    """
    g = groups.select(F.col(key), F.col(size).cast("long").alias(size), random_key(key, seed).alias("__r"))
    g = g.repartition(1).sortWithinPartitions("__r", key).drop("__r")
    ship(groups.sparkSession)

    def run(batches):
        had = [0, 0]
        for b in batches:
            out = []
            for n in b.column(size).to_pylist():
                half = 0 if had[0] < had[1] else 1
                had[half] += n or 0
                out.append(half + 1)
            yield b.append_column("half", pa.array(out, pa.int32()))

    return g.mapInArrow(run, T.StructType([*g.schema.fields, T.StructField("half", T.IntegerType())]))


def cumulative_dose(df: DataFrame, group: str, order: list[str], dose: Column, before: bool = False, name: str = "dose") -> DataFrame:
    """Running sum of the dose of each group, shifted by one for the dose before exposure."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    return df.withColumn(name, F.coalesce(F.sum(dose).over(w), F.lit(0.0)))


def dose_order(df: DataFrame, group: str, *order) -> DataFrame:
    return df.withColumn("order", (F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1).cast("long"))


def softmax_weights(df: DataFrame, unit: str, diff2: str, log_prior: Column, name: str = "weight") -> DataFrame:
    """exp(log prior + least diff2 - diff2) of each sample, 0 where the exponent is under -700."""
    e = log_prior + F.min(diff2).over(Window.partitionBy(unit)) - F.col(diff2)
    return df.withColumn(name, F.when(e < -700, 0.0).otherwise(F.exp(e)))


def significant_samples(df: DataFrame, unit: str, weight: str, fraction: float, most: int | None = None, order: str | None = None) -> DataFrame:
    """Positive samples with a flag: the largest weights that hold the fraction of the unit's sum, ties at the cut included.

    Weights add up in ascending order; the cut is the first whose running sum exceeds (1 - fraction) of the total.
    """
    pos = df.where(F.col(weight) > 0)
    by = [F.col(weight), *([F.col(order)] if order else [])]
    run = Window.partitionBy(unit).orderBy(*by)
    all_ = Window.partitionBy(unit)
    pos = pos.withColumn("__c", F.sum(weight).over(run.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__t", F.sum(weight).over(all_))
    pos = pos.withColumn("__cut", F.min(F.when(F.col("__c") > (1 - fraction) * F.col("__t"), F.col(weight))).over(all_))
    if most is not None:
        down = Window.partitionBy(unit).orderBy(*[c.desc() for c in by])
        pos = pos.withColumn("__n", F.row_number().over(down)).withColumn("__cut", F.greatest("__cut", F.min(F.when(F.col("__n") <= most, F.col(weight))).over(all_))).drop("__n")
    return pos.withColumn("significant", F.col(weight) >= F.col("__cut")).drop("__c", "__t", "__cut")


def best_sample(df: DataFrame, unit: str, weight: str, *columns: str) -> DataFrame:
    """Of each unit the sample with the largest weight (ties: smallest columns) and its share of the sum."""
    rank = F.struct(F.col(weight), *[-F.col(c) for c in columns])
    g = df.groupBy(unit).agg(F.max_by(F.struct(*columns), rank).alias("b"), (F.max(weight) / F.sum(weight)).alias("p_max"))
    return g.select(unit, *[F.col(f"b.{c}").alias(c) for c in columns], "p_max")


def prune_peaks(df: DataFrame, group: list[str], x: str, y: str, score: str, reach: float) -> DataFrame:
    """Greedy non-maximum suppression: by falling score, a peak stays unless a kept one of its group is within reach.

    Sequential within a group (a micrograph), so groups run one by one in Arrow-backed Python.
    """

    def run(pdf):
        import numpy as np

        pdf = pdf.sort_values([score, x, y], ascending=[False, True, True])
        kept: list[int] = []
        p = pdf[[x, y]].to_numpy(float)
        for i in range(len(p)):
            if not kept or (np.hypot(*(p[kept] - p[i]).T) > reach).all():
                kept.append(i)
        return pdf.iloc[kept]

    return df.groupBy(*group).applyInPandas(run, df.schema)
