"""SimHash near-dedup by segment-popcount embedding: fingerprints that differ in few bits, and their groups.

A fingerprint is mapped to the numbers of set bits in its 32 two-bit segments. The Manhattan distance of two such
vectors is at most the Hamming distance of their fingerprints. If it is k or less, and the segments are dealt into
B blocks, at least B - k blocks of the vectors are equal; so a range join of radius k meets every pair in the
cells given by B - k of the blocks. Within a cell, pairs are first filtered by the difference of their numbers of set
bits and by the Manhattan bound, then verified exactly. B grows with the number of different fingerprints, so that cells stay small; no B loses a pair.

Only different fingerprints are joined, each standing for all its documents; a cell gives a spanning forest of its
links, never all pairs. Groups are connected components, found by alternating large-star and small-star rounds
on the links, each kept in the shared folder.

Null texts have no words: fingerprint 0. Rows with a null doc_id link like others but name no group.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

U64 = np.uint64
SHINGLE, SEED, BITS = 3, 42, 3
TILE, LARGE = 1024, 8192
KEY = "__row_key"
_ODD = U64(0x5555555555555555)


def fingerprint(text: bytes) -> bytes:
    """Eight bytes, the highest bit first."""
    words = text.lower().split()
    if not words:
        return bytes(8)
    plain = b" ".join(words)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) < SHINGLE:
        hashes = xxhash.xxh64_digest(plain, SEED)
    else:
        start = np.concatenate(([0], end[: -SHINGLE] + 1)).tolist()
        digest = xxhash.xxh64_digest
        hashes = b"".join([digest(plain[a:b], SEED) for a, b in zip(start, end[SHINGLE - 1 :].tolist(), strict=True)])
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    count = np.zeros(64, np.int64)
    for a in range(0, len(rows), 1 << 14):
        count += np.unpackbits(rows[a : a + (1 << 14)], axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * count > len(rows)).tobytes()


def _fingerprints(batches):
    for b in C.pieces(batches):
        marks = [int.from_bytes(fingerprint(t), "big", signed=True) for t in C.texts(b)]
        keys = [k for k in b.schema.names if k == KEY]
        yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(marks, pa.int64()), *map(b.column, keys)], names=["doc_id", "mark", *keys])


def embed(marks: np.ndarray) -> np.ndarray:
    """Set bits of each two-bit segment, in two bits each."""
    a, b = marks & _ODD, (marks >> U64(1)) & _ODD
    return ((a & b) << U64(1)) | (a ^ b)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of two embedded fingerprints."""
    low, high = _ODD, _ODD << U64(1)
    diff = a ^ b
    # fields: 0/1/2 in binary; |0-1| = |1-2| = 1, |0-2| = 2
    one = diff & low
    two = diff & high & ~(one << U64(1))
    return np.bitwise_count(one).astype(np.int16) + 2 * np.bitwise_count(two).astype(np.int16)


def blocks_for(n: int, bits: int = BITS) -> int:
    """Blocks to deal the segments into, for n different fingerprints."""
    return bits + (3 if n < 1 << 19 else 4 if n < 1 << 22 else 5 if n < 1 << 26 else 7)


def masks(blocks: int, bits: int = BITS) -> list[int]:
    """The cells' coordinates: all choices of blocks - bits blocks, as masks of embedded fingerprints."""
    edge = [round(32 * i / blocks) for i in range(blocks + 1)]
    each = [sum(3 << 2 * s for s in range(a, b)) for a, b in zip(edge, edge[1:], strict=False)]
    return [sum(c) for c in combinations(each, blocks - bits)]


def _cells(parts: int, choices: list[int]):
    def run(batches):
        for b in batches:
            marks = b.column("mark").to_numpy(zero_copy_only=False).view(U64)
            if not len(marks):
                continue
            code = embed(marks)
            keys = np.concatenate([C.mix((code & U64(m)) + C.mix(np.array([k + 1], U64))) for k, m in enumerate(choices)])
            rows = np.tile(marks, len(choices))
            out_p, out_d = [], []
            for p, sel in C.by_part((keys >> U64(32)) % U64(parts)):
                out_p.append(p)
                out_d.append(C.pack(keys[sel], rows[sel]))
            yield pa.RecordBatch.from_arrays([pa.array(out_p, pa.int32()), pa.array(out_d, pa.binary())], names=["part", "data"])

    return run


class Union:
    """Disjoint sets of numbers."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        r = x
        while (p := self.up.setdefault(r, r)) != r:
            r = p
        while self.up[x] != r:
            self.up[x], x = r, self.up[x]
        return r

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _verified(a: np.ndarray, b: np.ndarray, bits: int):
    """The pairs that differ in at most ``bits`` bits."""
    near = np.flatnonzero(manhattan(embed(a), embed(b)) <= bits)
    return near[np.bitwise_count(a[near] ^ b[near]) <= bits]


def _joined(a: np.ndarray, b: np.ndarray, sets: Union) -> None:
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        sets.join(x, y)


def _link(marks: np.ndarray, bits: int, sets: Union, split: bool = True) -> None:
    """Links within one cell: a range join on the sum of the segments' counts, which the Manhattan distance bounds too,
    then the Manhattan bound itself, then the exact distance. Large cells are split by exact blocks first, and of
    what is still large the neighbours are looked up; neither loses a pair."""
    if split and len(marks) > LARGE:
        each = [U64(0xFF << 8 * i) for i in range(8)]
        for c in combinations(each, 8 - bits):
            fixed = np.bitwise_or.reduce(np.array(c, U64))
            key = marks & fixed
            order = np.argsort(key, kind="stable")
            edge = np.concatenate(([0], np.flatnonzero(np.diff(key[order])) + 1, [len(key)]))
            for a, b in zip(edge.tolist(), edge[1:].tolist(), strict=False):
                if b - a > LARGE:
                    _look_up(np.sort(marks[order[a:b]]), ~fixed, bits, sets)
                elif b - a > 1:
                    _link(marks[order[a:b]], bits, sets, False)
        return
    total = np.bitwise_count(marks)
    order = np.argsort(total, kind="stable")
    marks, total = marks[order], total[order].astype(np.int64)
    code = embed(marks)
    for a in range(0, len(marks), TILE):
        one = slice(a, a + TILE)
        upto = int(np.searchsorted(total, total[one][-1] + bits, "right"))
        for b in range(a, upto, TILE):
            two = slice(b, min(b + TILE, upto))
            i, j = np.nonzero(manhattan(code[one, None], code[None, two]) <= bits)
            if a == b:
                i, j = i[i < j], j[i < j]
            x, y = marks[one][i], marks[two][j]
            near = np.bitwise_count(x ^ y) <= bits
            _joined(x[near], y[near], sets)


def _look_up(marks: np.ndarray, free: np.uint64, bits: int, sets: Union) -> None:
    """Links of sorted fingerprints that differ in ``free`` bits only: each is looked up with up to ``bits`` of them turned."""
    single = [1 << k for k in range(64) if int(free) >> k & 1]
    for n in range(1, bits + 1):
        for turned in combinations(single, n):
            other = marks ^ U64(sum(turned))
            at = np.minimum(np.searchsorted(marks, other), len(marks) - 1)
            hit = (marks[at] == other) & (marks < other)
            _joined(marks[hit], other[hit], sets)


def _links(bits: int):
    def run(batches):
        keys, marks = [], []
        for b in batches:
            for data in b.column("data").to_pylist():
                k, m = C.unpack(data)
                keys.append(k)
                marks.append(m)
        if not keys:
            return
        key, mark = np.concatenate(keys), np.concatenate(marks)
        order = np.lexsort((mark, key))
        key, mark = key[order], mark[order]
        edge = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)]))
        size = np.diff(edge)
        sets = Union()
        for n in range(2, 33):  # small cells of one size together
            at = edge[:-1][size == n]
            if not len(at):
                continue
            rows = mark[at[:, None] + np.arange(n)]
            for i, j in combinations(range(n), 2):
                ok = _verified(rows[:, i], rows[:, j], bits)
                for x, y in zip(rows[ok, i].tolist(), rows[ok, j].tolist(), strict=True):
                    sets.join(x, y)
        for k in np.flatnonzero(size > 32).tolist():  # the others were joined above, by the same bounds
            _link(mark[edge[k] : edge[k + 1]], bits, sets)
        pairs = [(x, r) for x in sets.up if (r := sets.root(x)) != x]
        if pairs:
            a, b = np.array(pairs, U64).T
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b); root is the component's smallest node."""

    def fingerprint_of(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = C.checkpointed(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = fingerprint_of(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        now = C.checkpointed(small)
        before, state = state, fingerprint_of(now)
        if before == state:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _grouped(marks: DataFrame, n: int, bits: int) -> DataFrame:
    """(mark, component_id, root) of each different fingerprint of marks (doc_id, mark)."""
    different = C.checkpointed(marks.groupBy("mark").agg(F.min("doc_id").alias("least")))
    choices = masks(blocks_for(different.count(), bits), bits)
    cells = different.select("mark").mapInArrow(_cells(n, choices), "part int, data binary").repartition(n, "part")
    found = components(cells.mapInArrow(_links(bits), "a long, b long"))
    rooted = different.join(found, different.mark == found.node, "left").select("mark", "least", F.coalesce("root", "mark").alias("root"))
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(groups, "root").select("mark", "component_id", "root")


def simhash_dedup(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    docs needs doc_id and text. Fingerprints that differ in at most ``bits`` (up to 3) bits are linked;
    component_id is the smallest doc_id that links reach.
    """
    docs = docs.select("doc_id", "text")
    n = C.fan_out(docs)
    marks = C.checkpointed(docs.mapInArrow(_fingerprints, "doc_id long, mark long"))
    named = _grouped(marks, n, bits)
    return marks.join(named, "mark").select("doc_id", F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """docs with exactly one row of each group, the one with the smallest doc_id; null ids come last.

    Rows are told apart by a key of doc_id and text. Rows that share it are copies of one group, of which one stays;
    so a repeated doc_id, in one group or in several, keeps no further row.
    """
    n = C.fan_out(docs.select("doc_id", "text"))
    keyed = docs.withColumn(KEY, F.xxhash64("doc_id", "text"))
    marks = C.checkpointed(keyed.select("doc_id", "text", KEY).mapInArrow(_fingerprints, f"doc_id long, mark long, {KEY} long"))
    named = _grouped(marks.select("doc_id", "mark"), n, bits)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", KEY)).alias("first")
    kept = marks.join(named, "mark").groupBy("root").agg(first).select(f"first.{KEY}").distinct()
    return keyed.dropDuplicates([KEY]).join(kept, KEY, "left_semi").select(*docs.columns)
