"""Helpers that the operators of this subpackage share: chunking, hashing, packing and routing.

Conventions kept by every operator here:

* a null text counts as an empty one unless the operator says otherwise;
* input columns other than those named are ignored, so extra columns, whatever they are called, do no harm;
* rows are judged one by one, so a repeated ``doc_id`` gives one result row for each input row.
"""

from __future__ import annotations

import ctypes
import functools
import tempfile
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

CHUNK_BYTES = 4 << 20
NO_ID = np.iinfo(np.int64).max  # stands for a null doc_id: larger than any other

U64 = np.uint64
pa.set_memory_pool(pa.system_memory_pool())  # so that trim() covers what Arrow has freed
_BASE = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="fathom-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def small_batches(spark: SparkSession) -> None:
    """Readies a session: this package on the executors, and smaller Arrow batches than Spark's defaults, since whole
    texts are held by the JVM and by Python at once."""
    ship(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 2000), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        now = spark.conf.get(key, None)
        if now is None or not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows, kept in the shared folder: lineage ends there and survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fan_out(df: DataFrame, bytes_each: int = 16 << 20) -> int:
    """Partitions for a shuffle of df's text: the session's number, or more where the input is larger."""
    spark = df.sparkSession
    small_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    try:
        size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
    except Exception:  # only a hint; a session without a JVM handle has no estimate
        size = 0
    return int(min(max(n, size // bytes_each), 1_000_000)) if size < 1 << 60 else n


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@functools.cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def trim() -> None:
    """Gives freed memory back to the system; Python workers live on between tasks."""
    if libc := _libc():
        libc.malloc_trim(0)


def pieces(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the text of each piece stays near the limit (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(size) - size) // limit
        cut = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), n], strict=True):
            yield batch.slice(a, b - a)
            trim()


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 of each row; null is empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def ids(batch: pa.RecordBatch, name: str = "doc_id") -> list[int | None]:
    return batch.column(name).to_pylist()


def mix(a: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    a = a ^ (a >> U64(30))
    a = a * U64(0xBF58476D1CE4E5B9)
    a ^= a >> U64(27)
    a *= U64(0x94D049BB133111EB)
    a ^= a >> U64(31)
    return a


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 16)
        base = _BASE[which]
        have = tuple(np.multiply.accumulate(np.concatenate(([U64(1)], np.full(n - 1, b, U64)))) for b in (base, pow(base, -1, 1 << 64)))
        _powers[which] = have
    return have[0][:n], have[1][:n]


class RangeHash:
    """Hashes of any range of a sequence in constant time, by prefix sums of value * base**i modulo 2**64."""

    def __init__(self, values: np.ndarray, which: int = 0):
        n = len(values)
        up, self.down = powers(n + 1, which)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(values * up[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U64))


class Names(dict):
    """word -> index of its 64-bit hash. Call fresh() between chunks: it keeps the table within its bound."""

    def __init__(self, bound: int = 200_000):
        self.bound, self.hashes, self.array = bound, [], np.zeros(0, U64)

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self.hashes)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        return at

    def fresh(self) -> None:
        if len(self) > self.bound:
            self.clear()
            self.hashes, self.array = [], np.zeros(0, U64)

    def of(self, words: list[bytes]) -> np.ndarray:
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if len(self.array) < len(self.hashes):
            self.array = np.concatenate((self.array, np.array(self.hashes[len(self.array) :], dtype=U64)))
        return self.array[at]


def uid(doc_id: int | None, text: bytes) -> int:
    """Key of a row: rows share it only where both doc_id and text are equal, and then their results are too."""
    return xxhash.xxh3_64_intdigest(text, seed=xxhash.xxh3_64_intdigest(str(doc_id).encode()))


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


_TYPES = [np.dtype(t) for t in ("u1", "u2", "u4", "u8", "i1", "i2", "i4", "i8")]
_CODE = {t: k for k, t in enumerate(_TYPES)}


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers as bytes."""
    head = np.array([x for a in arrays for x in (_CODE[a.dtype], len(a))], np.uint32).tobytes()
    return len(arrays).to_bytes(4, "little") + head + b"".join(a.tobytes() for a in arrays)


def unpack(data: bytes, at: int = 0) -> list[np.ndarray]:
    n = int.from_bytes(data[at : at + 4], "little")
    head = np.frombuffer(data, np.uint32, 2 * n, at + 4).tolist()
    at, out = at + 4 + 8 * n, []
    for code, size in zip(head[::2], head[1::2], strict=True):
        out.append(np.frombuffer(data, _TYPES[code], size, at))
        at += size * _TYPES[code].itemsize
    return out


def small(a: np.ndarray) -> np.ndarray:
    """The same numbers, none negative, in as few bytes each as the largest needs."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else U64)


def steps(owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owners, positions of each, steps from one to the next) of positions that rise within each owner; owners stand together."""
    if not len(owner):
        return owner, np.zeros(0, np.uint8), np.zeros(0, np.uint8)
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    at = at.astype(np.int64)
    step = np.concatenate((at[:1], at[1:] - at[:-1]))
    step[first] = at[first]
    return owner[first], small(np.diff(np.concatenate((first, [len(owner)])))), small(step)


def positions(count: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The positions whose steps() these are."""
    total = np.cumsum(step.astype(np.int64))
    first = np.cumsum(count.astype(np.int64)) - count
    return total - np.repeat(total[first] - step[first], count)


def by_part(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(part, positions) of each part that occurs."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    part = part[order]
    edge = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
    for a, b in zip(edge, edge[1:], strict=False):
        yield int(part[a]), order[a:b]


class Seen:
    """What a task met before, so that common keys are settled before the shuffle.

    At most ``bound`` keys are held; beyond it those met once are forgotten, then all. What is forgotten is met as if
    for the first time, which costs a few rows more and changes no result. Use only one of the three methods.
    """

    def __init__(self, bound: int = 400_000):
        self.bound, self.keys, self.count, self.value = bound, np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def before(self, keys: np.ndarray) -> np.ndarray:
        """How often each of the keys was met before, here or in earlier calls."""
        order, first, times, near, known = self._found(keys)
        count = self._held(self.count, near, known, 0)
        self._keep(keys[order[first]], near, known, count + times, count)
        out = np.empty(len(keys), np.int64)
        out[order] = np.repeat(count - first, times) + np.arange(len(keys))
        return out

    def others(self, keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """How often each of the keys was met before with another owner than the first one that it was met with."""
        order, first, times, near, known = self._found(keys)
        count = self._held(self.count, near, known, 0)
        own = np.where(known, self._held(self.value, near, known, 0), owner[order[first]])
        other = owner[order] != np.repeat(own, times)
        upto = np.concatenate(([0], np.cumsum(other)))
        self._keep(keys[order[first]], near, known, count + upto[first + times] - upto[first], own)
        out = np.empty(len(keys), np.int64)
        out[order] = np.repeat(count - upto[first], times) + upto[:-1]
        return out

    def least(self, keys: np.ndarray, value: np.ndarray, after: int = 0) -> np.ndarray:
        """The smallest value that each of the keys was met with, here or in earlier calls; NO_ID for keys that earlier calls
        did not meet ``after`` times."""
        order, first, times, near, known = self._found(keys)
        low = np.minimum(np.minimum.reduceat(value[order], first), self._held(self.value, near, known, NO_ID)) if len(keys) else np.zeros(0, np.int64)
        count = self._held(self.count, near, known, 0)
        self._keep(keys[order[first]], near, known, count + times, low)
        out = np.empty(len(keys), np.int64)
        out[order] = np.repeat(np.where(count >= after, low, NO_ID), times)
        return out

    def _found(self, keys: np.ndarray):
        order = np.argsort(keys, kind="stable")
        by = keys[order]
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(by)), bool), by[1:] != by[:-1])))
        near = np.searchsorted(self.keys, by[first])
        known = np.zeros(len(first), bool)
        inside = near < len(self.keys)
        known[inside] = self.keys[near[inside]] == by[first][inside]
        return order, first, np.diff(np.concatenate((first, [len(keys)]))), near, known

    @staticmethod
    def _held(column: np.ndarray, near: np.ndarray, known: np.ndarray, default: int) -> np.ndarray:
        out = np.full(len(near), default, np.int64)
        out[known] = column[near[known]]
        return out

    def _keep(self, keys: np.ndarray, near: np.ndarray, known: np.ndarray, count: np.ndarray, value: np.ndarray) -> None:
        self.count[near[known]], self.value[near[known]] = count[known], value[known]
        new = ~known
        self.keys, self.count, self.value = (np.insert(x, near[new], y[new]) for x, y in ((self.keys, keys), (self.count, count), (self.value, value)))
        if len(self.keys) > self.bound:
            keep = self.count > 1
            if 2 * keep.sum() > self.bound:
                keep[:] = False
            self.keys, self.count, self.value = self.keys[keep], self.count[keep], self.value[keep]


# --- documents and what was found about them, brought together by row key ---------------------------------


ROUTED = "part int, kind int, data binary"
DOCS, WHOLE, RANGES, EDGES, OTHER, HOT, NAMES = range(7)  # kinds of rows; WHOLE, RANGES, EDGES and HOT are marks


def rows_of(part: list[int], kind: list[int], data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], names=["part", "kind", "data"])


def part_of(uids: np.ndarray, parts: int) -> np.ndarray:
    return uids.view(U64) % U64(parts)


def marks(kind: int, parts: int, uids: np.ndarray, *columns: np.ndarray) -> tuple[list[int], list[int], list[bytes]]:
    """Rows that bring marks to their documents, a row for each part."""
    out_p, out_d = [], []
    for p, sel in by_part(part_of(uids, parts)):
        sel = sel[np.argsort(uids[sel], kind="stable")]
        own, count, _ = steps(uids[sel], np.zeros(len(sel), np.int64))
        out_p.append(p)
        out_d.append(pack(own, count, *[c[sel] for c in columns]))
    return out_p, [kind] * len(out_p), out_d


class Marks:
    """All marks of a part, by row key."""

    def __init__(self):
        self.held: dict[int, list[list[np.ndarray]]] = {}
        self.sorted: dict[int, tuple[dict[int, tuple[int, int]], list[np.ndarray]]] | None = None

    def add(self, kind: int, data: bytes) -> None:
        own, count, *columns = unpack(data)
        self.held.setdefault(kind, []).append([np.repeat(own, count), *columns])

    def of(self, key: int) -> dict[int, list[np.ndarray]]:
        if self.sorted is None:
            self.sorted = {}
            for kind, blocks in self.held.items():
                uids, *columns = (np.concatenate(c) for c in zip(*blocks, strict=True))
                order = np.argsort(uids, kind="stable")
                uids = uids[order]
                edge = [*np.flatnonzero(np.concatenate(([True], uids[1:] != uids[:-1]))).tolist(), len(uids)]
                self.sorted[kind] = ({k: (a, b) for k, a, b in zip(uids[edge[:-1]].tolist(), edge, edge[1:], strict=False)}, [c[order] for c in columns])
            self.held = {}
        out = {}
        for kind, (where, columns) in self.sorted.items():
            if key in where:
                a, b = where[key]
                out[kind] = [c[a:b] for c in columns]
        return out


def _packed(parts: int):
    def run(batches):
        press = zstandard.ZstdCompressor(level=3)
        for b in pieces(batches, limit=2 * CHUNK_BYTES):
            body, doc_ids = texts(b), ids(b)
            uids = np.array([uid(i, t) for i, t in zip(doc_ids, body, strict=True)], U64).view(np.int64)
            rest = b.column("rest") if "rest" in b.schema.names else None
            out_p, out_d = [], []
            for p, sel in by_part(part_of(uids, parts)):
                k = sel.tolist()
                own = b""
                if rest is not None:
                    sink = pa.BufferOutputStream()
                    one = pa.RecordBatch.from_arrays([rest.take(pa.array(sel))], names=["rest"])
                    with pa.ipc.new_stream(sink, one.schema) as writer:
                        writer.write_batch(one)
                    own = sink.getvalue().to_pybytes()
                text = b"".join([body[i] for i in k])
                out_p.append(p)
                out_d.append(press.compress(pack(
                    uids[sel], np.array([0 if doc_ids[i] is None else doc_ids[i] for i in k], np.int64), np.array([doc_ids[i] is not None for i in k]).astype(np.uint8),
                    np.array([len(body[i]) for i in k], np.uint32), np.frombuffer(own, np.uint8), np.frombuffer(text, np.uint8),
                )))
            yield rows_of(out_p, [DOCS] * len(out_p), out_d)

    return run


def carried(docs: DataFrame, columns: list[str]) -> DataFrame:
    """doc_id and text, and the named columns as one struct, rest, if there are any."""
    rest = [F.struct(*[F.col(f"`{c}`") for c in columns]).alias("rest")] if columns else []
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *rest)


def schema_of(docs: DataFrame, own: str) -> str:
    """own, and rest as carried() made it."""
    return own + "".join(f", rest {f.dataType.simpleString()}" for f in docs.schema.fields if f.name == "rest")


def routed(docs: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """Documents and the marks found for them, packed, one shuffle; in each of the n parts marks come first.

    docs has doc_id and text, and perhaps rest; found has rows of marks().
    """
    return docs.mapInArrow(_packed(n), ROUTED).unionByName(found).repartitionById(n, F.col("part")).sortWithinPartitions(F.desc("kind"))


def streamed(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """(uid, doc_id, text, marks by kind, rest) of each document of a routed() part, a document at a time."""
    unpress, found = zstandard.ZstdDecompressor(), Marks()
    for b in batches:
        for kind, data in zip(b.column("kind").to_pylist(), b.column("data").to_pylist(), strict=True):
            if kind != DOCS:
                found.add(kind, data)
                continue
            uids, doc_ids, valid, size, own, text = unpack(unpress.decompress(data))
            rest = pa.ipc.open_stream(own.tobytes()).read_all().column("rest").to_pylist() if len(own) else repeat(None)
            text, at = text.tobytes(), 0
            for key, doc_id, is_id, n, more in zip(uids.tolist(), doc_ids.tolist(), valid.tolist(), size.tolist(), rest, strict=False):
                yield key, doc_id if is_id else None, text[at : at + n], found.of(key), more
                at += n


def grouped(rows: Iterator[tuple], limit: int = CHUNK_BYTES) -> Iterator[list[tuple]]:
    """Lists of streamed() documents whose text stays near the limit."""
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += len(row[2]) + 64
        if size >= limit:
            yield out
            out, size = [], 0
            trim()
    if out:
        yield out
    trim()
