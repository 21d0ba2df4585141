"""Substring dedup by recompression: word windows that an earlier document has are removed.

Recompression names runs of equal symbols and then disjoint pairs of symbols, round after round. A name is
a hash of what it stands for, so names are the same in every document and on every executor without any
exchange. Each symbol also carries the stretch of words on which its being there depends; a symbol whose
stretch lies inside a window occurs, at the same offset, in every other occurrence of that window. So for
each window one interior symbol is chosen by its content alone, and only windows whose symbol is shared by
two documents can repeat. The words of those windows go to the part of their symbol, where equal windows are found by
hash and then compared byte for byte; the smallest doc_id decides. Symbols that a task meets in two documents, and
windows that it meets often (by 64 bits of hash), are settled there, so that no part of a shuffle grows with the copies
of one passage.

Of the interior symbols, rather of four words or more, else of three, the one with the least hash is chosen, so
neighbouring windows mostly choose the same. Runs are named in the first round only: to be a run, or none, is a
matter of both neighbours, and asking it of every round would leave too few symbols that a window determines.

Shuffles, all of packed rows: the chosen symbols, the candidate windows, and the texts twice, with what was found
about them. Copies within a chunk are folded before the first one.

Null texts have no words. A null doc_id counts as larger than any other. Equal doc_ids do not remove from
each other. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

U64 = np.uint64
WINDOW, ROUNDS = 13, 3
_BYTES = C.mix(np.arange(256, dtype=U64) + U64(0x8EBC6AF09C88C6E3))
OFTEN = 16  # times that a task meets a window before it judges later ones itself
LEAST, GOOD = 3, 4  # words in a chosen symbol, at least and rather; windows without one are named whole


def recompress(sym: np.ndarray, rounds: int = ROUNDS):
    """Yields (name, start, end, first needed, after the last needed) of the symbols after each round."""
    n = len(sym)
    st, en = np.arange(n, dtype=np.int32), np.arange(1, n + 1, dtype=np.int32)
    dl, dr = st.copy(), en.copy()
    for r in range(rounds):
        if r == 0:
            first = np.flatnonzero(np.concatenate(([True], sym[1:] != sym[:-1])))
            last = np.concatenate((first[1:], [len(sym)])) - 1
            size = last - first + 1
            name = sym[first]
            long = size > 1
            if long.any():
                name = np.where(long, C.mix(name * U64(0xA0761D6478BD642F) + size.astype(U64)), name)
            left, right = np.maximum(first - 1, 0), np.minimum(last + 1, len(sym) - 1)
            st, en, dl, dr = st[first], en[last], dl[left], dr[right]
            sym = name
        side = C.mix(sym + U64(0x9E3779B97F4A7C15 * (r + 1) & (1 << 64) - 1)) & U64(1) == 0
        pair = np.zeros(len(sym), bool)
        pair[:-1] = side[:-1] & ~side[1:]
        second = np.zeros(len(sym), bool)
        second[1:] = pair[:-1]
        alone = ~pair & ~second
        nxt, prv = np.concatenate((dr[1:], dr[-1:])), np.concatenate((dl[:1], dl[:-1]))
        e2, r2, s2 = np.concatenate((en[1:], en[-1:])), nxt, np.concatenate((sym[1:], sym[-1:]))
        dl = np.where(alone & ~side, prv, dl)
        dr = np.where(pair, r2, np.where(alone & side, nxt, dr))
        en = np.where(pair, e2, en)
        sym = np.where(pair, C.mix(C.mix(sym) + s2 * U64(0xE7037ED1A0B428DB)), sym)
        keep = ~second
        sym, st, en, dl, dr = sym[keep], st[keep], en[keep], dl[keep], dr[keep]
        yield sym, st, en, dl, dr


def anchors(sym: np.ndarray, starts: np.ndarray, window: int = WINDOW):
    """For the window at each of the starts: (name of its symbol, where that begins), and the windows without one."""
    n = len(sym)
    best, at = np.full(len(starts), np.iinfo(np.uint64).max, U64), np.full(len(starts), -1, np.int32)
    for name, st, en, dl, dr in recompress(sym):
        ok = (en - st >= LEAST) & (dr - dl <= window)
        if not ok.any():
            continue
        short = (en - st < GOOD)[ok].astype(U64) << U64(63)
        name, st, dl, dr = C.mix(name[ok]) >> U64(1) | short, st[ok], dl[ok], dr[ok]
        # neither dl nor dr falls from one symbol to the next: those inside a window are neighbours
        below, upto = np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int32)
        np.cumsum(np.bincount(dl, minlength=n)[:n], out=below[1:])
        upto[:] = np.cumsum(np.bincount(dr, minlength=n + 1)[: n + 1])
        k, end = below[starts], upto[starts + window]
        open_ = np.flatnonzero(k < end)
        k, end = k[open_], end[open_]
        while len(open_):
            now, here = name[k], st[k]
            better = (now < best[open_]) | ((now == best[open_]) & (here < at[open_]))
            got = open_[better]
            best[got], at[got] = now[better], here[better]
            k = k + 1
            more = k < end
            open_, k, end = open_[more], k[more], end[more]
    return best, at, np.flatnonzero(at < 0)


def _flat(plain: list[bytes]):
    """Symbols (hashes of words) of all texts with a stop of its own before, between and after them, and where each text starts.
    A text is its words, one at least, with a blank between and a line break behind."""
    body = np.frombuffer(b"".join(plain), np.uint8)
    end = np.flatnonzero((body == 32) | (body == 10))
    size = np.array([t.count(b" ") + 1 for t in plain], np.int64)
    begin = np.cumsum(size + 1) - size
    sym = np.empty(int(size.sum()) + len(plain) + 1, U64)
    stop = np.concatenate(([0], begin + size))
    inner = np.ones(len(sym), bool)
    inner[stop] = False
    sym[inner] = C.RangeHash(_BYTES[body])(np.concatenate(([0], end[:-1] + 1)), end)
    sym[stop] = C.mix(np.arange(len(stop), dtype=U64) + U64(0x5851F42D4C957F2D))
    return sym, begin, size


def _starts(begin: np.ndarray, size: np.ndarray, window: int):
    """Start of every window in the flat sequence, and its document's number."""
    count = np.maximum(size - window + 1, 0)
    doc = np.repeat(np.arange(len(size)), count)
    return (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)).astype(np.int64), doc


def _window_names(sym: np.ndarray, starts: np.ndarray, window: int):
    return C.RangeHash(sym)(starts, starts + window)


def _emit(parts: int, window: int):
    def run(batches):
        seen = C.Seen()
        for batch in C.pieces(batches):
            best: dict[bytes, int] = {}
            keys = [C.NO_ID if i is None else i for i in C.ids(batch)]
            body = C.texts(batch)
            for k, t in enumerate(body):
                if (j := best.setdefault(t, k)) != k and keys[k] < keys[j]:
                    best[t] = k
            rows = [k for k in sorted(best.values()) if body[k] and not body[k].isspace()]
            uids = np.array([C.uid(None if i == C.NO_ID else i, t) for i, t in zip(keys, body, strict=True)], U64).view(np.int64)
            # copies of a smaller doc_id in this chunk: each of their windows is removed
            later = np.array([k for k, t in enumerate(body) if keys[k] > keys[best[t]]], np.int64)
            out = C.marks(C.WHOLE, parts, uids[later])
            sym, begin, size = _flat([b" ".join(body[k].split()) + b"\n" for k in rows]) if rows else (None, np.zeros(0, np.int64), np.zeros(0, np.int64))
            starts, doc = _starts(begin, size, window)
            if len(starts):
                name, at, left = anchors(sym, starts, window)
                if len(left):
                    name[left] = _window_names(sym, starts[left], window)
                    at[left] = -1 - np.arange(len(left))
                new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (name[1:] != name[:-1]) | (doc[1:] != doc[:-1]))))
                count = np.diff(np.concatenate((new, [len(at)])))
                name, d, s = name[new], doc[new], (starts - begin[doc])[new]
                own, part = uids[rows], (name >> U64(32)) % U64(parts)
                # a symbol that this task met in two documents is shared for sure: windows go straight back
                sure = seen.others(name, own[d]) > 0
                known = C.marks(C.RANGES, parts, own[d[sure]], s[sure].astype(np.uint32), C.small(count[sure]), C.small(part[sure]))
                for into, more in zip(out, known, strict=True):
                    into.extend(more)
                left = np.flatnonzero(~sure)
                for p, sel in C.by_part(part[left]):
                    sel = left[sel]
                    used, times, step = C.steps(d[sel], s[sel])
                    out[0].append(p)
                    out[1].append(C.OTHER)
                    out[2].append(C.pack(name[sel].astype(np.uint32), own[used], times, step, C.small(count[sel])))
            yield C.rows_of(*out)

    return run


def _shared(parts: int):
    """Symbols that two documents have -> the windows that chose them, by document."""

    def run(batches):
        got = []
        for b in batches:
            for p, kind, data in zip(*(b.column(c).to_pylist() for c in ("part", "kind", "data")), strict=True):
                if kind != C.OTHER:
                    yield C.rows_of([p], [kind], [data])
                    continue
                name, own, times, step, count = C.unpack(data)
                got.append((np.full(len(name), p, np.uint32), name, np.repeat(own, times), C.positions(times, step).astype(np.uint32), count.astype(np.uint32)))
        if not got:
            return
        part, name, uid, s, count = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.lexsort((name, part))
        part, name, uid, s, count = part[order], name[order], uid[order], s[order], count[order]
        first = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (name[1:] != name[:-1]))))
        several = np.minimum.reduceat(uid, first) != np.maximum.reduceat(uid, first)
        keep = np.repeat(several, np.diff(np.concatenate((first, [len(name)]))))
        if keep.any():
            yield C.rows_of(*C.marks(C.RANGES, parts, uid[keep], s[keep], C.small(count[keep]), C.small(part[keep])))

    return run


def _candidates(parts: int, window: int):
    """The words of the windows that may repeat, back to the parts of their symbols, a run of windows at a time."""

    def run(batches):
        seen = C.Seen()
        press = zstandard.ZstdCompressor(level=3)
        for rows in C.grouped((r for r in C.streamed(batches) if r[3]), C.CHUNK_BYTES // 2):
            out = C.marks(C.WHOLE, parts, np.array([r[0] for r in rows if C.WHOLE in r[3]], np.int64))
            rows = [r for r in rows if C.WHOLE not in r[3]]
            if rows:
                plain = [b" ".join(r[2].split()) + b"\n" for r in rows]
                picked, doc, back = [], [], []
                for k, r in enumerate(rows):
                    a, n, p = r[3][C.RANGES]
                    a, n = a.astype(np.int64), n.astype(np.int64)
                    s = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    order = np.argsort(s)
                    picked.append(s[order])
                    back.append(np.repeat(p, n)[order])
                    doc.append(np.full(len(s), k))
                s, d, p = (np.concatenate(x) for x in (picked, doc, back))
                whole = b"".join(plain)
                body = np.frombuffer(whole, np.uint8)
                stop = np.flatnonzero((body == 32) | (body == 10))
                begin = np.concatenate(([0], stop[:-1] + 1))
                size = np.array([x.count(b" ") + 1 for x in plain])
                at = s + (np.cumsum(size) - size)[d]
                uid = np.array([r[0] for r in rows], np.int64)
                key = np.array([C.NO_ID if r[1] is None else r[1] for r in rows], np.int64)
                # a window that this task met often, once with a smaller doc_id, is removed without a further look
                late = key[d] > seen.least(C.RangeHash(_BYTES[body])(begin[at], stop[at + window - 1]), key[d], OFTEN)
                if late.any():
                    known = C.marks(C.RANGES, parts, *_runs(uid[d[late]], s[late]))
                    for into, more in zip(out, known, strict=True):
                        into.extend(more)
                s, d, p, at = s[~late], d[~late], p[~late], at[~late]
                if len(s):
                    new = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1))))
                    count = np.diff(np.concatenate((new, [len(s)])))
                    s, d, p, at = s[new], d[new], p[new], at[new]
                    first, last = begin[at], stop[at + count + window - 2] + 1
                    for to, sel in C.by_part(p):
                        out[0].append(to)
                        out[1].append(C.OTHER)
                        text = b"".join([whole[a:b] for a, b in zip(first[sel].tolist(), last[sel].tolist(), strict=True)])
                        out[2].append(press.compress(C.pack(uid[d[sel]], key[d[sel]], C.small(s[sel]), C.small(count[sel]), np.frombuffer(text, np.uint8))))
            yield C.rows_of(*out)

    return run


def _runs(uid: np.ndarray, s: np.ndarray):
    """(uid, first, number) of the runs of windows."""
    order = np.lexsort((s, uid))
    uid, s = uid[order], s[order]
    new = np.flatnonzero(np.concatenate(([True], (uid[1:] != uid[:-1]) | (s[1:] > s[:-1] + 1))))
    end = s[np.concatenate((new[1:], [len(s)])) - 1] + 1
    return uid[new], s[new].astype(np.uint32), C.small(end - s[new])


def _bounds(body: np.ndarray, count: np.ndarray, window: int):
    """(run, place in it, first byte, byte after the last) of each window of runs of words, of which each word ends in a blank or line break."""
    stop = np.flatnonzero((body == 32) | (body == 10))
    begin = np.concatenate(([0], stop[:-1] + 1))
    size = count + window - 1
    row = np.repeat(np.arange(len(count)), count)
    j = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    at = (np.cumsum(size) - size)[row] + j
    return row, j, begin[at], stop[at + window - 1]


def _differs(flat: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, long: int = 4096) -> np.ndarray:
    """Whether size bytes from a on are others than those from b on, eight bytes at a time. flat has eight bytes to spare at its end."""
    eight = np.ndarray((len(flat) - 7,), "<u8", flat, strides=(1,))
    out = np.zeros(len(a), bool)
    left = np.flatnonzero((size <= long) & (a != b))
    k = 0
    while len(left):
        rest = size[left] - k
        unlike = eight[a[left] + k] ^ eight[b[left] + k]
        short = rest < 8
        unlike[short] &= (U64(1) << (8 * rest[short]).astype(U64)) - U64(1)
        out[left] |= unlike != 0
        k += 8
        left = left[(rest > 8) & (unlike == 0)]
    for i in np.flatnonzero((size > long) & (a != b)).tolist():
        out[i] = not np.array_equal(flat[a[i] : a[i] + size[i]], flat[b[i] : b[i] + size[i]])
    return out


def _alike(flat: np.ndarray, name: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which windows of the same words stand together, and where each such group starts. Windows of one name (hash)
    are compared with the first of them, byte for byte."""
    order = np.argsort(name, kind="stable")
    new = np.flatnonzero(np.concatenate(([True], name[order][1:] != name[order][:-1])))
    first = np.repeat(order[new], np.diff(np.concatenate((new, [len(name)]))))
    here, there, n = start[order], start[first], size[order]
    differs = n != size[first]
    differs |= _differs(flat, here, np.where(differs, here, there), n)
    if differs.any():  # equal hashes of different words: next to never
        group = np.repeat(np.arange(len(new)), np.diff(np.concatenate((new, [len(name)]))))
        others: dict[bytes, int] = {}
        for i in np.flatnonzero(differs).tolist():
            group[i] = others.setdefault(flat[here[i] : here[i] + n[i]].tobytes(), len(name) + len(others))
        again = np.argsort(group, kind="stable")
        order, group = order[again], group[again]
        new = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    return order, new


def _judged(parts: int, window: int):
    """Windows that a smaller doc_id has -> removed ranges of words, by document."""

    def run(batches):
        got, bodies, here, runs = [], [], 0, 0
        unpress = zstandard.ZstdDecompressor()
        for b in batches:
            for p, kind, data in zip(*(b.column(c).to_pylist() for c in ("part", "kind", "data")), strict=True):
                if kind != C.OTHER:
                    yield C.rows_of([p], [kind], [data])
                    continue
                uid, key, s, count, body = C.unpack(unpress.decompress(data))
                row, j, first, stop = _bounds(body, count.astype(np.int64), window)
                got.append((C.RangeHash(_BYTES[body])(first, stop), first + here, (stop - first).astype(np.int32), (row + runs).astype(np.int32), (s.astype(np.int64)[row] + j).astype(np.uint32), uid.copy(), key.copy()))
                bodies.append(body)
                here, runs = here + len(body), runs + len(uid)
        if not got:
            return
        name, start, size, row, s, uid, key = (np.concatenate(x) for x in zip(*got, strict=True))
        got = None
        order, new = _alike(np.concatenate([*bodies, np.zeros(8, np.uint8)]), name, start, size.astype(np.int64))
        each = key[row[order]]
        late = order[each > np.repeat(np.minimum.reduceat(each, new), np.diff(np.concatenate((new, [len(each)]))))]
        if len(late):
            yield C.rows_of(*C.marks(C.RANGES, parts, *_runs(uid[row[late]], s[late].astype(np.int64))))
        C.trim()

    return run


def removed_words(n: int, marks: dict[int, list[np.ndarray]], window: int = WINDOW) -> np.ndarray:
    """True for each of the n words that a removed window covers."""
    if C.WHOLE in marks:
        return np.full(n, n >= window)
    start, count = marks[C.RANGES]
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, start, 1)
    np.add.at(change, start.astype(np.int64) + count + window - 1, -1)
    return np.cumsum(change[:n]) > 0


def _apply(window: int, with_text: bool):
    def run(batches):
        out = []
        for _, doc_id, text, marks, _ in C.streamed(batches):
            words = text.split()
            gone = removed_words(len(words), marks, window) if marks and words else np.zeros(len(words), bool)
            kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words)
            row = [doc_id, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest()]
            out.append([*row, kept.decode()] if with_text else row)
            if len(out) >= 2000:
                yield _rows(out, with_text)
                out = []
        if out:
            yield _rows(out, with_text)

    return run


def _rows(out, with_text):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=False)], names=names[: 4 + with_text])


def substring_dedup(docs: DataFrame, window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (and kept_text on request).

    docs needs doc_id and text. A word goes if a window of that many words covers it whose words, in that
    order, also start in a document with a smaller doc_id.
    """
    docs = C.carried(docs, [])
    n = C.fan_out(docs)
    found = docs.mapInArrow(_emit(n, window), C.ROUTED).repartitionById(n, F.col("part")).mapInArrow(_shared(n), C.ROUTED)
    names = C.routed(docs, found, n).mapInArrow(_candidates(n, window), C.ROUTED)
    judged = names.repartitionById(n, F.col("part")).mapInArrow(_judged(n, window), C.ROUTED)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text
    return C.routed(docs, judged, n).mapInArrow(_apply(window, keep_text), schema)
