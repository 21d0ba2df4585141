"""Processing on the fly: a growing set of files, each row once, in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def on_the_fly(spark: SparkSession, folder: str, schema, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, most_files: int | None = None, every: str | None = None, kind: str = "parquet") -> StreamingQuery:
    """Starts work on files as they appear and appends its rows as Parquet; what is done is remembered at checkpoint.

    most_files bounds a batch. Without ``every`` the query ends when all files there are done, and a later
    call goes on from there.
    """
    read = spark.readStream.format(kind).schema(schema)
    read = read.option("maxFilesPerTrigger", most_files) if most_files else read
    write = work(read.load(folder)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (write.trigger(processingTime=every) if every else write.trigger(availableNow=True)).start()


def while_growing(spark: SparkSession, folder: str, schema, step: Callable[[DataFrame, int], None], checkpoint: str, most_files: int = 1, kind: str = "parquet") -> StreamingQuery:
    """Calls step(new rows, rows so far) for each batch that brought rows."""
    seen = 0

    def each(df: DataFrame, _: int) -> None:
        nonlocal seen
        n = df.count()
        if n:
            seen += n
            step(df, seen)

    stream = spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", most_files).load(folder)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_for(query: StreamingQuery, seconds: float) -> bool:
    """Lets a query work for so long at most; whether it ended by itself. What it has not done a later start goes on with."""
    ended = query.awaitTermination(seconds)
    if not ended:
        query.stop()
    return bool(ended)
