"""Suffix-array dedup by external induced sorting: bytes inside any long repeated string are removed.

The recursion of induced sorting keeps, level by level, only the suffixes that start at a local minimum of the
level above, naming what lies between two of them. Here a name is a hash, so that all documents agree on
names and on their order without an exchange, and the recursion stops at the levels whose minima are dense
enough that every window of ``length`` bytes holds one near its start. Only those suffixes become tuples.
A tuple carries the name of its first length/2 bytes and the name of the whole stretch of text that the
windows led by that suffix cover. A disk-backed priority queue sorts the tuples of each shard; equal names of
neighbours are their common-prefix values. A stretch that occurs twice is removed at once. Where only the
prefix is common, the stretches themselves meet in a second round and every window in them is compared.
The full order of all byte suffixes is never needed and not built (see README).

A suffix leads a window if it is the leftmost minimum, of the highest level that has one, whose surroundings
inside the window determine it; so equal windows have the same leader at the same offset. Windows without a
leader (long runs of one byte) are named whole.

Shuffles: tuples, the stretches whose prefix alone is shared, and the texts twice, with what was found about
them. Copies within a chunk are folded before the first one.

Null texts are empty. Rows are documents: two rows that are equal in all columns repeat each other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import _common as C
from .disk_queue import DiskQueue

U64 = np.uint64
LENGTH, LEVELS = 400, 4
FEW = 16  # tuples of one prefix that a task sends at most, and one more that says there are MANY
MOST = 1000  # stretches of one prefix that are compared in one place; windows of more meet by name
MANY = np.uint16(1 << 15)
CHUNK = 1 << 20
TUPLE = np.dtype([("prefix", U64), ("stretch", U64), ("uid", np.int64), ("start", np.uint32), ("count", np.uint16), ("lead", np.uint16)])
_BYTES = C.mix(np.arange(256, dtype=U64) + U64(0xC2B2AE3D27D4EB4F))


def minima(sym: np.ndarray, st: np.ndarray, dl: np.ndarray, dr: np.ndarray):
    """Local minima of a sequence of symbols: (start, first needed, after the last needed)."""
    first = np.flatnonzero(np.concatenate(([True], sym[1:] != sym[:-1])))
    last = np.concatenate((first[1:], [len(sym)])) - 1
    name = sym[first]
    low = np.zeros(len(name), bool)
    low[1:-1] = (name[1:-1] < name[:-2]) & (name[1:-1] < name[2:])
    k = np.flatnonzero(low)
    return st[first[k]], dl[first[k] - 1], dr[last[k] + 1]


def recursion(sym: np.ndarray, sums: C.RangeHash, levels: int = LEVELS):
    """The minima of each level, lowest first."""
    n = len(sym)
    at = np.arange(n, dtype=np.int32)
    st, dl, dr = minima(sym, at, at, at + 1)
    out = [(st, dl, dr)]
    for _ in range(levels - 1):
        if len(st) < 4:
            break
        name = sums(st[:-1], st[1:])
        st, dl, dr = minima(name, st[:-1], dl[:-1], dr[1:])
        out.append((st, dl, dr))
    return out


def leaders(sym: np.ndarray, sums: C.RangeHash, starts: np.ndarray, length: int):
    """For the window at each start: (start and level of the suffix that leads it), -1 where there is none."""
    lead, level = np.full(len(starts), -1, np.int32), np.zeros(len(starts), np.uint8)
    open_ = np.arange(len(starts), dtype=np.int32)
    found = recursion(sym, sums)
    for k, (st, dl, dr) in reversed(list(enumerate(found, 1))):
        if not len(open_) or not len(st):
            continue
        upto = np.zeros(len(sym) + 1, np.int32)
        np.cumsum(np.bincount(dl, minlength=len(sym))[: len(sym)], out=upto[1:])
        w = starts[open_]
        j = upto[w]
        ok = j < len(st)
        j = np.minimum(j, len(st) - 1)
        ok &= (dr[j] <= w + length) & (st[j] - w <= length - length // 2)
        got = open_[ok]
        lead[got], level[got] = st[j[ok]], k
        open_ = open_[~ok]
    return lead, level


def _flat(bodies: list[bytes]):
    size = np.array([len(b) for b in bodies], np.int64)
    begin = np.cumsum(size + 1) - size
    stop = np.concatenate(([0], begin + size))
    sym = np.empty(int(size.sum()) + len(bodies) + 1, U64)
    inner = np.ones(len(sym), bool)
    inner[stop] = False
    sym[inner] = _BYTES[np.frombuffer(b"".join(bodies), np.uint8)]
    sym[stop] = C.mix(np.arange(len(stop), dtype=U64) + U64(0x5851F42D4C957F2D))
    return sym, begin, size


def _starts(begin: np.ndarray, size: np.ndarray, length: int):
    count = np.maximum(size - length + 1, 0)
    doc = np.repeat(np.arange(len(size), dtype=np.int32), count)
    return (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count - begin, count)).astype(np.int32), doc


def tuples(bodies: list[bytes], length: int):
    """(prefix name, stretch name, document, first window, windows, where the suffix starts after that) of each leader."""
    sym, begin, size = _flat(bodies)
    starts, doc = _starts(begin, size, length)
    if not len(starts):
        return None
    sums = C.RangeHash(sym)
    lead, level = leaders(sym, sums, starts, length)
    none = lead < 0
    lead[none] = -1 - np.flatnonzero(none)
    new = np.flatnonzero(np.concatenate(([True], (lead[1:] != lead[:-1]) | (level[1:] != level[:-1]) | (doc[1:] != doc[:-1]))))
    count = np.diff(np.concatenate((new, [len(lead)])))
    s, p, lv, d = starts[new], lead[new], level[new], doc[new]
    own = p < 0
    p = np.where(own, s, p)
    prefix = C.mix(sums(p, p + np.where(own, length, length // 2)) + lv.astype(U64))
    stretch = C.mix(sums(s, s + count + length - 1) + (p - s).astype(U64))
    return prefix, stretch, d, (s - begin[d]).astype(np.uint32), count.astype(np.uint16), (p - s).astype(np.uint16)


def _emit(parts: int, length: int):
    def run(batches):
        alike, led = C.Seen(), C.Seen()
        for batch in C.pieces(batches, limit=CHUNK):
            rows: dict[bytes, list] = {}
            for i, t in zip(C.ids(batch), C.texts(batch), strict=True):
                rows.setdefault(t, []).append(C.uid(i, t))
            whole = [u for t, us in rows.items() if len(us) > 1 and len(t) >= length for u in us]
            out = C.marks(C.WHOLE, parts, np.array(whole, U64).view(np.int64))
            if got := tuples(list(rows), length):
                prefix, stretch, d, s, count, lead = got
                uid = np.array([us[0] for us in rows.values()], U64).view(np.int64)
                # a stretch that this task met twice is removed for sure; of a prefix that it meets often no more tuples go out
                twice = alike.before(C.mix(prefix) + stretch) > 1
                met = np.where(twice, 0, FEW)
                met[~twice] = led.before(prefix[~twice])
                hot = met > FEW
                full = C.marks(C.RANGES, parts, uid[d[twice]], s[twice], count[twice])
                more = C.marks(C.HOT, parts, uid[d[hot]], prefix[hot], s[hot], count[hot], lead[hot])
                count = np.where(met == FEW, count | MANY, count)
                for into, x, y in zip(out, full, more, strict=True):
                    into.extend([*x, *y])
                left = np.flatnonzero(~twice & ~hot)
                for p, sel in C.by_part((prefix[left] >> U64(40)) % U64(parts)):
                    sel = left[sel]
                    used, times, step = C.steps(d[sel], s[sel])
                    out[0].append(p)
                    out[1].append(C.OTHER)
                    out[2].append(C.pack(prefix[sel], stretch[sel], uid[used], times, step, C.small(count[sel]), C.small(lead[sel])))
            yield C.rows_of(*out)

    return run


def _sorted(parts: int, memory: int):
    """Tuples in order -> stretches that occur twice (ranges), stretches that share a prefix only (edges)."""

    def run(batches):
        queue = DiskQueue(TUPLE, ["prefix", "stretch"], memory)
        for b in batches:
            for p, kind, data in zip(*(b.column(c).to_pylist() for c in ("part", "kind", "data")), strict=True):
                if kind != C.OTHER:
                    yield C.rows_of([p], [kind], [data])
                    continue
                prefix, stretch, uid, times, step, count, lead = C.unpack(data)
                block = np.empty(len(prefix), TUPLE)
                for name, v in zip(TUPLE.names, (prefix, stretch, np.repeat(uid, times), C.positions(times, step), count, lead), strict=True):
                    block[name] = v
                queue.push(block)
        for t in queue.pops():
            new_p = np.concatenate(([True], t["prefix"][1:] != t["prefix"][:-1]))
            new_s = new_p | np.concatenate(([True], t["stretch"][1:] != t["stretch"][:-1]))
            at_s = np.flatnonzero(new_s)
            times = np.diff(np.concatenate((at_s, [len(t)])))
            twice = np.repeat(times > 1, times)
            group = np.cumsum(new_p[at_s]) - 1
            kinds = np.bincount(group)  # different stretches of each prefix
            many = np.logical_or.reduceat(t["count"] >= MANY, np.flatnonzero(new_p)) | (kinds > MOST)
            t["count"] &= MANY - np.uint16(1)
            edge, hot = np.zeros(len(t), bool), np.zeros(len(t), bool)
            edge[at_s] = (kinds > 1)[group] & ~many[group]  # one tuple of each stretch stands for it
            hot[at_s] = many[group]
            full = t[twice]
            if len(full):
                yield C.rows_of(*C.marks(C.RANGES, parts, full["uid"], full["start"], full["count"]))
            for kind, x in ((C.EDGES, t[edge]), (C.HOT, t[hot])):
                if len(x):
                    yield C.rows_of(*C.marks(kind, parts, x["uid"], x["prefix"], x["start"], x["count"], x["lead"]))

    return run


def _stretches(parts: int, length: int):
    """The text of stretches that share a prefix only, dealt out by prefix; where a prefix has many, the names of their
    windows, dealt out by name."""

    def run(batches):
        met = C.Seen()
        for rows in C.grouped((r for r in C.streamed(batches) if r[3]), CHUNK):
            got = []
            yield C.rows_of(*_named([(r[0], r[2], r[3][C.HOT]) for r in rows if C.HOT in r[3]], met, parts, length))
            for key, _, text, marks, _ in rows:
                if C.EDGES not in marks:
                    continue
                prefix, s, count, lead = marks[C.EDGES]
                got += [(x, key, a, c, o, text[a : a + c + length - 1]) for x, a, c, o in zip(prefix.tolist(), s.tolist(), count.tolist(), lead.tolist(), strict=True)]
            out = [], [], []
            if got:
                part = (np.array([g[0] for g in got], U64) >> U64(40)) % U64(parts)
                press = zstandard.ZstdCompressor(level=1)
                for p, sel in C.by_part(part):
                    x = [got[i] for i in sel.tolist()]
                    cols = [np.array([g[i] for g in x], t) for i, t in ((0, U64), (1, np.int64), (2, np.uint32), (3, np.uint16), (4, np.uint16))]
                    out[0].append(p)
                    out[1].append(C.OTHER)
                    out[2].append(press.compress(C.pack(*cols, np.frombuffer(b"".join(g[5] for g in x), np.uint8))))
            yield C.rows_of(*out)

    return run


def _named(rows: list[tuple], met: C.Seen, parts: int, length: int):
    """Rows with the names of all windows of the stretches of (uid, text, their marks)."""
    names, owner, start = [], [], []
    for uid, text, (prefix, s, count, lead) in rows:
        sums = C.RangeHash(_BYTES[np.frombuffer(text, np.uint8)], 1)
        n = count.astype(np.int64)
        j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        w = np.repeat(s.astype(np.int64), n) + j
        name = sums(w, w + length) + C.mix(np.repeat(prefix, n) + (np.repeat(lead.astype(np.int64), n) - j + 65536).astype(U64))
        order = np.argsort(w)
        names.append(C.mix(name[order]))
        start.append(w[order])
        owner.append(np.full(len(w), uid, np.int64))
    out = [], [], []
    if names:
        name, uid, s = (np.concatenate(x) for x in (names, owner, start))
        twice = met.before(name) > 1  # sure, since the first two go out
        for into, x in zip(out, C.marks(C.RANGES, parts, *_runs(uid[twice], s[twice])), strict=True):
            into.extend(x)
        left = np.flatnonzero(~twice)
        for p, sel in C.by_part((name[left] >> U64(32)) % U64(parts)):
            sel = left[sel]
            used, times, step = C.steps(uid[sel], s[sel])
            out[0].append(p)
            out[1].append(C.NAMES)
            out[2].append(C.pack(name[sel], used, times, step))
    return out


def _runs(uid: np.ndarray, s: np.ndarray):
    """(uid, first, number) of the runs of windows."""
    order = np.lexsort((s, uid))
    s, uid = s[order], uid[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(s)), bool), (uid[1:] != uid[:-1]) | (s[1:] > s[:-1] + 1))))
    end = s[np.concatenate((first[1:], np.full(min(1, len(s)), len(s)))) - 1] + 1
    return uid[first], s[first].astype(np.uint32), (end - s[first]).astype(np.uint32)


def _met(parts: int, rows: list[bytes]):
    """Ranges of the windows whose names two of _named()'s rows have."""
    name, uid, s = [], [], []
    for data in rows:
        n, own, times, step = C.unpack(data)
        name.append(n)
        uid.append(np.repeat(own, times))
        s.append(C.positions(times, step))
    name, uid, s = (np.concatenate(x) for x in (name, uid, s))
    order = np.argsort(name, kind="stable")
    same = name[order][1:] == name[order][:-1]
    again = np.zeros(len(name), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return C.rows_of(*C.marks(C.RANGES, parts, *_runs(uid[again], s[again])))


def _compared(parts: int, length: int, at_once: int = 300_000):
    """Windows of stretches with a common prefix that two stretches have -> ranges of window starts."""

    def run(batches):
        cols = [[] for _ in range(5)]
        text, here = [], 0
        places = []
        unpress = zstandard.ZstdDecompressor()
        named: list[bytes] = []
        for b in batches:
            for p, kind, data in zip(*(b.column(c).to_pylist() for c in ("part", "kind", "data")), strict=True):
                if kind == C.RANGES:
                    yield C.rows_of([p], [kind], [data])
                if kind == C.NAMES:
                    named.append(data)
                if kind != C.OTHER:
                    continue
                *five, body = C.unpack(unpress.decompress(data))
                for c, v in zip(cols, five, strict=True):
                    c.append(v)
                size = five[3].astype(np.int64) + length - 1
                places.append(here + np.cumsum(size) - size)
                text.append(body)
                here += len(body)
        if named:
            yield _met(parts, named)
        if not text:
            return
        prefix, uid, start, count, lead = (np.concatenate(c) for c in cols)
        place, body = np.concatenate(places), np.concatenate(text)
        order = np.argsort(prefix, kind="stable")
        prefix, uid, start, count, lead, place = (x[order] for x in (prefix, uid, start, count, lead, place))
        count = count.astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], prefix[1:] != prefix[:-1])))
        work = np.add.reduceat(count, new)
        block = (np.cumsum(work) - work) // at_once
        firsts = new[np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))]
        for a, b in zip(firsts.tolist(), [*firsts[1:].tolist(), len(prefix)], strict=True):
            n, size = count[a:b], count[a:b] + length - 1
            flat = np.concatenate([body[q : q + z] for q, z in zip(place[a:b].tolist(), size.tolist(), strict=True)])
            at = np.cumsum(size) - size
            j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            w = np.repeat(at, n) + j
            name = C.RangeHash(_BYTES[flat], 1)(w, w + length)
            key = C.mix(np.repeat(prefix[a:b], n) + (np.repeat(lead[a:b].astype(np.int64), n) - j + 65536).astype(U64))
            order = np.lexsort((name, key))
            same = (name[order][1:] == name[order][:-1]) & (key[order][1:] == key[order][:-1])
            again = np.zeros(len(name), bool)
            again[order[1:][same]] = True
            again[order[:-1][same]] = True
            if again.any():
                which = np.repeat(np.arange(a, b), n)[again]
                s = start[which].astype(np.int64) + j[again]
                yield C.rows_of(*C.marks(C.RANGES, parts, *_runs(uid[which], s)))

    return run


def removed_bytes(n: int, marks: dict[int, list[np.ndarray]], length: int = LENGTH) -> np.ndarray:
    """True for each of the n bytes that a repeated window covers."""
    if C.WHOLE in marks:
        return np.full(n, n >= length)
    start, count = marks[C.RANGES]
    change = np.bincount(start, minlength=n + 1) - np.bincount(start.astype(np.int64) + count + length - 1, minlength=n + 1)
    return np.cumsum(change[:n]) > 0


def _apply(length: int, keep: str, rest: pa.DataType | None):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string() if keep == "text" else pa.binary()]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]

    def run(batches):
        for rows in C.grouped(C.streamed(batches), CHUNK):
            out = []
            for _, doc_id, text, marks, _ in rows:
                kept, removed, spans = text, 0, 0
                if marks and len(text) >= length:
                    gone = removed_bytes(len(text), marks, length)
                    removed = int(gone.sum())
                    spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                row = [doc_id, len(text), removed, spans, hashlib.sha256(kept).hexdigest()]
                out.append([*row, kept.decode("utf-8", "ignore") if keep == "text" else kept] if keep else row)
            arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=False)]
            own = names[: len(arrays)]
            if rest is not None:
                arrays.append(pa.array([r[4] for r in rows], rest))
                own = [*own, "rest"]
            yield pa.RecordBatch.from_arrays(arrays, names=own)

    return run


def suffix_dedup(docs: DataFrame, length: int = LENGTH, keep: str = "", carry: tuple[str, ...] = (), memory: int = 64 << 20) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    docs needs doc_id and text. A byte goes if a string of ``length`` bytes covers it that also starts
    anywhere else, in this document or another. With keep="bytes" also kept, the remaining bytes, which need
    not be whole characters; with keep="text" as text, without characters that lost a byte. Columns of docs
    named in ``carry`` come along. ``memory`` bounds what a shard's queue
    holds before it goes to disk.
    """
    docs = C.carried(docs, list(carry))
    n = C.fan_out(docs)
    plain = docs.select("doc_id", "text")
    part = F.col("part")
    found = C.checkpointed(plain.mapInArrow(_emit(n, length), C.ROUTED).repartitionById(n, part).mapInArrow(_sorted(n, memory), C.ROUTED))  # read twice below
    edges, full = (found.where(f"kind {test} ({C.EDGES}, {C.HOT})") for test in ("in", "not in"))
    stretches = C.routed(plain, edges, n).mapInArrow(_stretches(n, length), C.ROUTED)
    more = stretches.repartitionById(n, part).mapInArrow(_compared(n, length), C.ROUTED)
    schema = C.schema_of(docs, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + {"": "", "bytes": ", kept binary", "text": ", kept string"}[keep])
    rest = to_arrow_type(docs.schema["rest"].dataType) if carry else None
    out = C.routed(docs, full.unionByName(more), n).mapInArrow(_apply(length, keep, rest), schema)
    return out.select("*", *[F.col("rest").getField(c).alias(c) for c in carry]).drop("rest") if carry else out
