"""The book of a workflow: processes, files, and which process reads and writes which file, as four tables.

processes (process, kind, status, alias), files (file, kind), inputs and outputs (process, file). All operators
return new tables; nothing on disk is touched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# States of a process.
RUNNING, SCHEDULED, SUCCEEDED, FAILED, ABORTED = "Running", "Scheduled", "Succeeded", "Failed", "Aborted"


def add_process(book: dict[str, DataFrame], process: str, kind: str, reads: list[tuple[str, str]], writes: list[tuple[str, str]], status: str = SCHEDULED) -> dict[str, DataFrame]:
    """The book with one more process and its (file, kind) inputs and outputs; files that are known stay one row."""
    spark = book["processes"].sparkSession
    p = spark.createDataFrame([(process, kind, status, None)], "process string, kind string, status string, alias string")
    f = spark.createDataFrame([*reads, *writes], "file string, kind string") if reads or writes else spark.createDataFrame([], "file string, kind string")
    edges = {k: spark.createDataFrame([(process, n) for n, _ in v], "process string, file string") for k, v in (("inputs", reads), ("outputs", writes))}
    new = f.dropDuplicates(["file"]).join(book["files"].select("file"), "file", "left_anti")
    return {"processes": book["processes"].where(F.col("process") != process).unionByName(p), "files": book["files"].unionByName(new.select("file", "kind"))} | {k: book[k].unionByName(e).distinct() for k, e in edges.items()}


def find(processes: DataFrame, name: str) -> DataFrame:
    """The process of that name or alias, a slash at the end or not."""
    bare = name.rstrip("/")
    return processes.where(F.rtrim(F.col("process"), F.lit("/")).eqNullSafe(bare) | F.rtrim(F.col("alias"), F.lit("/")).eqNullSafe(bare))


def completed(processes: DataFrame, marks: DataFrame) -> DataFrame:
    """Processes with the state that exit marks (process, mark) give to running ones: success before failure before abortion."""
    rank = F.when(F.col("mark") == SUCCEEDED, 0).when(F.col("mark") == FAILED, 1).when(F.col("mark") == ABORTED, 2)
    m = marks.groupBy("process").agg(F.min(rank).alias("__m"))
    got = F.element_at(F.array(*[F.lit(x) for x in (SUCCEEDED, FAILED, ABORTED)]), F.col("__m") + 1)
    changed = F.when((F.col("status") == RUNNING) & F.col("__m").isNotNull(), got).otherwise(F.col("status"))
    return processes.join(m, "process", "left").withColumn("status", changed).drop("__m")


def dangling_outputs(processes: DataFrame, outputs: DataFrame, present: DataFrame) -> DataFrame:
    """(process, file) outputs of succeeded processes that are not among the files present."""
    done = processes.where(F.col("status") == SUCCEEDED).select("process")
    return outputs.join(done, "process", "left_semi").join(present.select("file"), "file", "left_anti").select("process", "file")


def runnable(processes: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Scheduled processes none of whose inputs is still to be written by a process that has not succeeded."""
    open_ = outputs.join(processes.where(F.col("status") != SUCCEEDED).select("process"), "process", "left_semi").select("file")
    waits = inputs.join(open_, "file", "left_semi").select("process").distinct()
    return processes.where(F.col("status") == SCHEDULED).join(waits, "process", "left_anti")


def run_order(processes: DataFrame, inputs: DataFrame, outputs: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(process, level): level 0 reads nothing that a process writes, others one more than the highest they read from.

    One join for each level; fails where processes wait for each other.
    """

    def kept(df):
        return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.cache()

    edges = kept(outputs.withColumnRenamed("process", "before").join(inputs, "file").select("before", "process").distinct())
    left, levels = kept(processes.select("process")), []
    for level in range(most_rounds):
        waiting = edges.join(left.withColumnRenamed("process", "before"), "before", "left_semi").select("process").distinct()
        ready = kept(left.join(waiting, "process", "left_anti"))
        if ready.isEmpty():
            break
        levels.append(ready.withColumn("level", F.lit(level)))
        left = kept(left.join(ready, "process", "left_anti"))
    if not left.isEmpty():
        raise ValueError("processes wait for each other")
    return reduce(DataFrame.unionByName, levels) if levels else processes.select("process").withColumn("level", F.lit(0))


def set_alias(processes: DataFrame, process: str, alias: str | None) -> DataFrame:
    """Gives or takes an alias; fails where another process has it or it begins like a job's own name."""
    if alias is not None:
        if alias.split("/")[-1].startswith("job") or not alias or " " in alias:
            raise ValueError(f"no alias: {alias}")
        if not processes.where((F.col("alias") == alias) & (F.col("process") != process)).isEmpty():
            raise ValueError(f"alias {alias} is taken")
    return processes.withColumn("alias", F.when(F.col("process") == process, F.lit(alias)).otherwise(F.col("alias")))


def to_clean(processes: DataFrame, files: DataFrame, keep: DataFrame, patterns: dict[str, list[str]], harsh: dict[str, list[str]] | None = None) -> DataFrame:
    """(process, file) that a clean-up removes: files below succeeded processes that match a pattern of the process's kind
    (also those of ``harsh``, if given), but for files to keep, such as nodes of the graph."""
    rules = {k: [*patterns.get(k, []), *((harsh or {}).get(k, []))] for k in {*patterns, *(harsh or {})}}
    done = processes.where(F.col("status") == SUCCEEDED).select("process", "kind")
    below = files.withColumn("process", F.concat(F.concat_ws("/", F.slice(F.split("file", "/"), 1, 2)), F.lit("/"))).join(done, "process")
    hit = reduce(lambda a, b: a | b, [(F.col("kind") == k) & F.col("file").rlike("|".join(p)) for k, p in rules.items() if p], F.lit(False))
    return below.where(hit).join(keep.select("file"), "file", "left_anti").select("process", "file")


def exported(book: dict[str, DataFrame], chosen: DataFrame) -> dict[str, DataFrame]:
    """The chosen processes with their edges, and the files on these."""
    p = chosen.select("process")
    edges = {k: book[k].join(p, "process", "left_semi") for k in ("inputs", "outputs")}
    used = edges["inputs"].select("file").union(edges["outputs"].select("file")).distinct()
    return {"processes": book["processes"].join(p, "process", "left_semi").withColumn("status", F.lit(SCHEDULED)), "files": book["files"].join(used, "file", "left_semi")} | edges


def imported(book: dict[str, DataFrame], other: dict[str, DataFrame], first: int, width: int = 3) -> dict[str, DataFrame]:
    """The book with another's processes, Folder/jobNNN/, numbered on from ``first`` in their order, their files renamed with them."""
    old = [r[0] for r in other["processes"].orderBy("process").select("process").collect()]  # processes are few
    new = {p: f"{p.split('/')[0]}/job{first + k:0{width}d}/" for k, p in enumerate(old)}
    table = F.create_map(*[F.lit(x) for kv in new.items() for x in kv]) if new else F.lit(None).cast("map<string,string>")
    own = F.concat(F.concat_ws("/", F.slice(F.split("file", "/"), 1, 2)), F.lit("/"))
    file = F.coalesce(F.concat(F.element_at(table, own), F.substring_index("file", "/", -1)), F.col("file"))
    out = {}
    for k, df in other.items():
        df = df.withColumn("file", file) if "file" in df.columns else df
        df = df.withColumn("process", F.element_at(table, F.col("process"))) if "process" in df.columns else df
        out[k] = book[k].unionByName(df).distinct()
    return out


def substituted(commands: DataFrame, rows: DataFrame, command: str, mark: str = "xxx") -> DataFrame:
    """For each row of a table the command with xxx<column>xxx replaced by the row's values."""
    out = rows.crossJoin(F.broadcast(commands.select(F.col(command).alias("command")).limit(1)))  # one row
    text = F.col("command")
    for c in rows.columns:
        text = F.replace(text, F.lit(f"{mark}{c}{mark}"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return out.withColumn("command", text)


def renamed_jobs(df: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    """Job names inside a column of parameters replaced by those of the jobs that a repeated run made; names is a scheme's few jobs."""
    out = F.col(column)
    for old, new in names.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return df.withColumn(column, out)
