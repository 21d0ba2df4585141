"""Benchmark decontamination: windows of benchmark words found in documents, verified, and the words hit.

The windows are held as a broadcast hash set. Its size is bounded: benchmark items are dealt into as many blocks
as keep each block's text under BLOCK_BYTES, and documents pass the blocks one after the other, carrying what was
hit so far; beyond one block each pass is kept in the shared folder, so a task never holds two tables. A document word outside the block's vocabulary ends any window, so only stretches of
known words are hashed; each hash found is verified word by word. Nothing is shuffled.

Null texts, of documents or items, have no words. Items with equal windows are all reported. A null item_id is
written as the text null.
"""

from __future__ import annotations

import hashlib
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

WINDOW = 10
BLOCK_BYTES = 24 << 20
_KEPT = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
# lower-cases A-Z and turns what cannot be in a word into a space
TABLE = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if (b + 32 if 0x41 <= b <= 0x5A else b) in _KEPT else 0x20 for b in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


class Windows:
    """The windows of some items: vocabulary, sorted hashes for each length, and the exact windows behind them."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        exact: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for item, text in items:
            w = [self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in words(text)]
            n = min(window, len(w))
            for i in range(len(w) - n + 1 if n else 0):
                exact.setdefault(n, {}).setdefault(tuple(w[i : i + n]), set()).add(item)
        self.exact = exact
        self.values = C.mix(np.arange(len(self.vocabulary) + 1, dtype=np.uint64) + np.uint64(0xA24BAED4963EE407))
        self.hashes = {}
        for n, found in exact.items():
            flat = self.values[np.array(list(found), np.int64).reshape(-1)]
            at = np.arange(len(found)) * n
            self.hashes[n] = np.sort(C.RangeHash(flat)(at, at + n))

    def hits(self, at: np.ndarray):
        """(start, length, items) of the windows in a sequence of vocabulary numbers, 0 for other words."""
        if not at.any():
            return
        sums = None
        known = np.concatenate(([0], np.cumsum(at == 0)))
        for n, hashes in self.hashes.items():
            if len(at) < n:
                continue
            start = np.flatnonzero(known[n:] == known[:-n])
            if not len(start):
                continue
            sums = sums or C.RangeHash(self.values[at])
            h = sums(start, start + n)
            k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            for s in start[hashes[k] == h].tolist():
                if found := self.exact[n].get(tuple(at[s : s + n].tolist())):
                    yield s, n, found


def _marked(w: Windows, b: pa.RecordBatch) -> tuple[list[list[bytes]], list, list]:
    """(words, hits, items) of the documents of a batch with a block's hits added: a byte for each word, or null, and sets."""
    get = w.vocabulary.get
    split = [words(t) for t in C.texts(b)]
    hits, items = ((b.column(c).to_pylist() for c in ("__hit", "__items")) if "__hit" in b.schema.names else ([None] * len(split), [None] * len(split)))
    size = np.array([len(x) for x in split], np.int64)
    begin = np.concatenate(([0], np.cumsum(size + 1)))
    flat = np.zeros(int(begin[-1]), np.int64)
    for x, a in zip(split, begin.tolist(), strict=False):
        flat[a : a + len(x)] = np.fromiter(map(get, x, repeat(0)), np.int64, len(x))
    marked: dict[int, np.ndarray] = {}
    for s, n, found in w.hits(flat):
        d = int(np.searchsorted(begin, s, "right")) - 1
        if d not in marked:
            marked[d] = np.frombuffer(hits[d], np.uint8).copy() if hits[d] else np.zeros(size[d], np.uint8)
            items[d] = set(items[d] or ())
        marked[d][s - begin[d] : s - begin[d] + n] = 1
        items[d] |= found
    for d, m in marked.items():
        hits[d] = m.tobytes()
    return split, hits, items


def _pass(block):
    """Adds a block's hits to each document, for a further pass."""

    def run(batches):
        for b in C.pieces(batches):
            _, hits, items = _marked(block.value, b)
            found = [pa.array(hits, pa.binary()), pa.array([sorted(x) if x else None for x in items], pa.list_(pa.string()))]
            own = [k for k, n in enumerate(b.schema.names) if n not in ("__hit", "__items")]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in own), *found], names=[*(b.schema.names[k] for k in own), "__hit", "__items"])

    return run


def without(text: bytes, hit: np.ndarray) -> bytes:
    """The text less each stretch of hit words, with what stands between them."""
    spans = [m.span() for m in WORD.finditer(text)]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit, [0]))))
    out, at = [], 0
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        out.append(text[at : spans[a][0]])
        at = spans[b - 1][1]
    return b"".join([*out, text[at:]])


def _digest(block, clean: bool):
    """The last pass: adds a block's hits and gives each document's row."""
    kinds = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_hit": pa.int64(), "n_items": pa.int64(), "items_sha256": pa.string(), "contaminated": pa.bool_(), "clean_text": pa.string()}

    def run(batches):
        for b in C.pieces(batches):
            out = []
            split, hits, sets = _marked(block.value, b)
            for i, t, w, hit, items in zip(C.ids(b), C.texts(b), split, hits, sets, strict=True):
                n = hit.count(1) if hit else 0
                items = sorted(items or ())
                row = [i, len(w), n, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), n > 0]
                out.append([*row, without(t, np.frombuffer(hit, np.uint8).astype(np.int8)).decode() if n else t.decode()] if clean else row)
            arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds.values(), strict=False)]
            names = [*kinds][: len(arrays)]
            if "rest" in b.schema.names:
                arrays.append(b.column("rest"))
                names.append("rest")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The benchmark in parts whose text is under block_bytes each (or a single item)."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    total, n = items.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    if not n:
        return []
    k = max(1, -(-int(total or 0) // block_bytes))
    while k > 1:
        part = items.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(k)))
        most = part.groupBy("part").agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).where("n > 1").agg(F.max("b")).first()[0]
        if (most or 0) <= block_bytes or k > 16 * n:
            return [part.where(F.col("part") == i).drop("part") for i in range(k)]
        k *= 2
    return [items]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, clean: bool = False, carry: tuple[str, ...] = (), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    docs needs doc_id and text, benchmark item_id and text. A window is ``window`` consecutive words of an
    item, or all its words where it has fewer; a document word inside any occurrence of a window is hit.
    On request also clean_text, the text without the stretches hit, and the columns of docs named in ``carry``.
    """
    C.small_batches(docs.sparkSession)
    spark = docs.sparkSession
    docs = C.carried(docs, list(carry))
    out = docs
    passing = C.schema_of(docs, "doc_id long, text string") + ", __hit binary, __items array<string>"
    blocks = _blocks(benchmark, block_bytes)
    tables = (Windows([(r.item, r.text.encode()) for r in block.collect()], window) for block in blocks)  # each bounded by block_bytes
    last = next(tables, Windows([]))
    for table in tables:
        out = C.checkpointed(out.mapInArrow(_pass(spark.sparkContext.broadcast(last)), passing))
        last = table
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean" + ", clean_text string" * clean
    out = out.mapInArrow(_digest(spark.sparkContext.broadcast(last), clean), C.schema_of(docs, schema))
    return out.select("*", *[F.col("rest").getField(c).alias(c) for c in carry]).drop("rest") if carry else out
