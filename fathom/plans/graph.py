"""Job graphs: processes, files, and what depends on what."""

from __future__ import annotations

from pyspark.sql import DataFrame


def downstream(inputs: DataFrame, outputs: DataFrame, start: DataFrame, most_rounds: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(processes, files) that deleting the start processes removes: they and all that read their output, and what those write.

    inputs (process, file) are read by, outputs (process, file) written by a process; start has process. One join
    pair for each step of the longest chain; the frontier is kept after each.
    """

    def kept(df):
        return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.cache()

    step = outputs.join(inputs.withColumnRenamed("process", "reader"), "file").select("process", "reader").distinct()
    found = frontier = kept(start.select("process").distinct())
    for _ in range(most_rounds):
        frontier = kept(step.join(frontier, "process", "left_semi").select(step.reader.alias("process")).distinct().join(found, "process", "left_anti"))
        if frontier.isEmpty():
            break
        found = kept(found.unionByName(frontier))
    return found, outputs.join(found, "process", "left_semi").select("file").distinct()


def has_dependants(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Processes whose output another one reads."""
    return outputs.join(inputs.select("file").distinct(), "file", "left_semi").select("process").distinct()
