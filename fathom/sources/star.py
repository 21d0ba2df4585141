"""STAR files: labelled tables in text.

A file holds blocks, data_<name>, each a loop of rows or a list of label-value pairs. Labels start with _. Types come
from a dictionary given by the caller, never from values; labels without one are text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import ship

TOKEN = re.compile(r"\s*(?:\"((?:[^\"]|\"(?=\S))*)\"(?=\s|$)|'((?:[^']|'(?=\S))*)'(?=\s|$)|(#.*)|(\S+))")


def tokens(line: str) -> list[str]:
    """Words of a line: quoted ones without their quotes, up to a comment that starts a word."""
    if not any(c in line for c in "\"'#"):
        return line.split()
    out = []
    for m in TOKEN.finditer(line):
        if m.group(3) is not None:
            break
        if m.group(0).strip():
            out.append(next(g for g in (m.group(1), m.group(2), m.group(4)) if g is not None))
    return out


def pieces(text: str, chars: int = 1 << 18) -> Iterator[tuple[int, str, bool, list[str], list[list[str]]]]:
    """(number of the block, name, is a list, labels, rows) of stretches of a text, so that rows of a few lines are held at a time.

    The last piece of a block has its final labels and may be without rows. A loop ends at an empty line; CR at a line's end is an error.
    """
    if "\r\n" in text:
        raise ValueError("CR LF line ends")
    number, name, labels, rows, loop, ended, at = 0, None, [], [], False, False, 0

    def closed():
        return number, name, not loop, labels, rows if loop else [[r[0] for r in rows]] if rows else []

    seen = False  # rows of the loop came in earlier pieces
    while at <= len(text):
        end = text.find("\n", at + chars)
        end = len(text) if end < 0 else end
        part, at = text[at:end], end + 1
        lines = part.split("\n")
        if loop and labels and not ended and not any(c in part for c in "\"'#"):
            words = [line.split() for line in lines]
            if set(map(len, words)) == {len(labels)} and not ("_" in part and any(w[0].startswith(("_", "data_", "loop_")) for w in words)):
                yield number, name, False, labels, rows + words
                rows, seen = [], True
                continue
        for line in lines:
            bare = line.strip()
            if bare.startswith("data_"):
                if name is not None:
                    yield closed()
                    number += 1
                name, labels, rows, loop, ended, seen = bare[5:], [], [], False, False, False
            elif name is None or bare.startswith("#"):
                continue
            elif bare == "loop_":
                if labels:  # a list, or a loop, came before in the same block
                    yield closed()
                    number, labels, rows, ended, seen = number + 1, [], [], False, False
                loop = True
            elif bare.startswith("_"):
                t = tokens(bare)
                labels = [*labels, t[0][1:]]
                if not loop:
                    rows = [*rows, [t[1] if len(t) > 1 else ""]]
            elif not bare:
                ended = ended or bool(loop and (rows or seen))
            elif loop and not ended:
                t = tokens(bare)
                if len(t) > len(labels) or len(t) < len(labels) and len(labels) > 2:
                    raise ValueError(f"{name}: {len(t)} values for {len(labels)} labels")
                rows.append(t + [""] * (len(labels) - len(t)))
        if loop and rows:
            yield number, name, False, labels, rows
            rows, seen = [], True
    if name is not None:
        yield closed()


def blocks(text: str) -> list[tuple[str, bool, list[str], list[list[str]]]]:
    """(name, is a list, labels, rows) of each block."""
    out = []
    for number, name, listed, labels, rows in pieces(text):
        if number < len(out):
            earlier = out.pop()[3]
            earlier += rows
            rows = earlier
        out.append((name, listed, labels, rows))
    return out


def _cast(values: list[str], kind: T.DataType) -> list:
    if isinstance(kind, T.ArrayType):
        inner = float if isinstance(kind.elementType, T.FractionalType) else int
        return [[inner(x) for x in v.strip("[]").split(",") if x.strip()] for v in values]
    if isinstance(kind, T.BooleanType):
        return [v.lower() in ("1", "true", "yes") for v in values]
    if isinstance(kind, T.IntegralType):
        return [int(float(v)) if v else 0 for v in values]
    return [float(v) if v else 0.0 for v in values] if isinstance(kind, T.FractionalType) else values


def read_star(spark: SparkSession, paths: str | list[str], table: str | None = None, types: dict[str, str] | None = None, labels: list[str] | None = None) -> DataFrame:
    """One block (the first, or that named) of all files, with the file's path and the row's number in it.

    Labels are those of the first file unless given. Each file is one task's, which holds its text and the rows of a stretch of it.
    """
    ship(spark)
    types = types or {}
    raw = spark.read.text(paths, wholetext=True).select("value", "_metadata.file_path")
    if labels is None:
        first = raw.limit(1).collect()
        found = [b for b in blocks(first[0].value) if table is None or b[0] == table] if first else []
        labels = found[0][2] if found else []
    schema = T.StructType([T.StructField(c, T._parse_datatype_string(types.get(c, "string"))) for c in labels])
    full = T.StructType([*schema.fields, T.StructField("file_path", T.StringType()), T.StructField("rid", T.LongType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(full)

    def run(batches):
        for b in batches:
            for value, path in zip(b.column("value"), b.column("file_path").to_pylist(), strict=True):
                wanted, first, n = None, [], 0
                for number, name, _, own, rows in pieces(value.as_py()):  # to the end, since a later block may be malformed
                    if wanted is None and (table is None or name == table):
                        wanted = number
                    if number != wanted:
                        continue
                    first = first if n else own
                    if len(own) != len(first):
                        raise ValueError(f"{name}: labels after rows")
                    if rows:
                        cols = dict(zip(own, zip(*rows, strict=True), strict=True))
                        data = [_cast(list(cols.get(f.name, [""] * len(rows))), f.dataType) for f in schema.fields]
                        ends = [[path] * len(rows), list(range(n, n + len(rows)))]
                        yield pa.RecordBatch.from_arrays([pa.array(d, t) for d, t in zip([*data, *ends], arrow.types, strict=True)], schema=arrow)
                        n += len(rows)

    return raw.mapInArrow(run, full)


def read_all(spark: SparkSession, path: str, types: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """All blocks of one file."""
    text = spark.read.text(path, wholetext=True).first().value
    return {name: read_star(spark, path, name, types, labels) for name, _, labels, _ in blocks(text)}


def quoted(text: str) -> str:
    if text == "":
        return '""'
    if not re.search(r"\s", text) and text[0] not in "\"'#_":
        return text
    return f'"{text}"' if '"' not in text else f"'{text}'"


def formatted(value, kind: T.DataType) -> str:
    """A value as written: numbers right-aligned in 12 places, six decimals (five if negative), exponents for very small and large ones."""
    if isinstance(kind, T.ArrayType):
        return "[" + ",".join(repr(x) for x in value) + "]"
    if isinstance(kind, T.FractionalType):
        value = float(value or 0)
        decimals = 5 if value < 0 else 6
        return f"{value:12.{decimals}{'e' if 0 < abs(value) < 0.001 or abs(value) > 100000 else 'f'}}"
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return f"{int(value or 0):12d}"
    return quoted(str(value if value is not None else ""))


def formatted_column(values: list, kind: T.DataType) -> list[str]:
    """Values as formatted() has them, whole numbers and plain words without a call for each."""
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return ["%12d" % (v or 0) for v in values]
    if isinstance(kind, T.FractionalType):
        return ["%12.6f" % v if v is not None and 0.001 <= v <= 100000 else formatted(v, kind) for v in values]
    if isinstance(kind, T.StringType):
        return [v if v is not None and v.isalnum() else formatted(v, kind) for v in values]
    return [formatted(v, kind) for v in values]


def write_star(tables: dict[str, DataFrame], path: str, order: str | None = None) -> None:
    """Blocks of a file on the driver's disk, a row at a time, renamed into place when complete."""
    with open(path + ".tmp", "w") as f:
        for name, df in tables.items():
            f.write(f"\ndata_{name}\n\nloop_\n")
            df = df.orderBy(order) if order and order in df.columns else df
            fields = [x for x in df.schema.fields if x.name not in ("rid", "file_path")]
            for k, x in enumerate(fields, 1):
                f.write(f"_{x.name} #{k}\n")
            for row in df.toLocalIterator():
                f.write(" ".join(formatted(row[x.name], x.dataType) for x in fields) + "\n")
            f.write("\n")
    os.replace(path + ".tmp", path)
