"""Corpus operators against brute force, libraries and held-out labels, with awkward rows."""

import hashlib
import math
import random
import textwrap
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import xxhash
import zstandard

import corpus_pipeline
from fathom.llm import _common as C
from fathom.llm import decontamination, html_extraction, induced_sorting, license_scan, piece_bpe, queries, quality, simhash_dedup, toxicity
from fathom.llm import substring_dedup as substring_dedup_module
from fathom.llm.disk_queue import DiskQueue
from fathom.llm.piece_codec import encode_decode
from fathom.llm.substring_dedup import substring_dedup
from fathom.llm.suffix_dedup import suffix_dedup
from fathom.llm.token_counts import token_counts

SCHEMA = "doc_id long, text string, uid string, data binary, rest int, kind string, part double, label int"


def awkward(seed: int, n: int = 60, letters: str = "ab", longest: int = 200, gap: str = " "):
    """Rows with nulls, empty texts, repeats, ties and columns named like internal ones."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        text = rng.choice([None, "", " ", "\n"]) if rng.random() < 0.15 else gap.join(rng.choice(letters) if rng.random() < 0.7 else rng.choice("cdé") for _ in range(rng.randint(0, longest)))
        rows.append((rng.choice([None, *range(25)]), text))
    return rows + rows[:5]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "u", b"x", None, "k", 0.5, 1) for i, t in rows], SCHEMA)


def same(df, want):
    assert sorted((tuple(r) for r in df.collect()), key=str) == sorted(want, key=str)


def brute_words(rows, window=13):
    key = lambda i: C.NO_ID if i is None else i
    first, out = {}, []
    for i, t in rows:
        w = (t or "").encode().split()
        for s in range(len(w) - window + 1):
            x = tuple(w[s : s + window])
            first[x] = min(first.get(x, C.NO_ID), key(i))
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < key(i):
                gone[s : s + window] = [True] * window
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return out


def brute_bytes(rows, length):
    times, out = Counter(), []
    for _, t in rows:
        b = (t or "").encode()
        times.update(b[s : s + length] for s in range(len(b) - length + 1))
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - length + 1):
            if times[b[s : s + length]] > 1:
                gone[s : s + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup(spark, seed):
    rows = awkward(seed) + [(30, "a " * 500), (31, "a " * 300), (32, "a b " * 200), (33, "b a " * 100), (34, "x" * 50_000)]
    same(substring_dedup(frame(spark, rows)), brute_words(rows))


def test_windows_are_compared_byte_for_byte():
    rng = random.Random(0)
    runs = [[rng.choice(("a", "b", "ab", "longerword", "é", "w" * 5000)) if rng.random() < 0.98 else "x" for _ in range(rng.randint(5, 30))] for _ in range(60)]
    body = np.frombuffer("".join(" ".join(r) + "\n" for r in runs).encode(), np.uint8)
    count = np.array([len(r) - 4 for r in runs])
    row, j, first, stop = substring_dedup_module._bounds(body, count, 5)
    words = [tuple(runs[r][k : k + 5]) for r, k in zip(row.tolist(), j.tolist(), strict=True)]
    assert [bytes(body[a:b]).decode() for a, b in zip(first, stop, strict=True)] == [" ".join(w) for w in words]
    flat = np.concatenate((body, np.zeros(8, np.uint8)))
    good = C.RangeHash(body.astype(np.uint64) + np.uint64(7))(first, stop)
    for name in (good, good % np.uint64(3), np.zeros(len(good), np.uint64)):  # the others collide
        order, new = substring_dedup_module._alike(flat, name, first, stop - first)
        same = np.empty(len(words), int)
        same[order] = np.searchsorted(new, np.arange(len(words)), "right")
        groups = {}
        for w, g in zip(words, same.tolist(), strict=True):
            groups.setdefault(w, set()).add(g)
        assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == len(groups) > 10


def test_substring_dedup_on_documents(spark, sf_dir):
    docs = C.documents(spark, sf_dir)
    same(substring_dedup(docs), brute_words([(r.doc_id, r.text) for r in docs.collect()]))


@pytest.mark.parametrize(("length", "memory"), [(8, 1 << 26), (20, 3000), (40, 500)])
def test_suffix_dedup(spark, length, memory):
    rows = awkward(3, gap="") + [(30, "a" * 300), (31, "xa" * 120), (32, "y" + "a" * 90 + "z"), (33, "aé" * 60)]
    same(suffix_dedup(frame(spark, rows), length, memory=memory), brute_bytes(rows, length))


def test_suffix_dedup_on_documents(spark, sf_dir):
    docs = C.documents(spark, sf_dir).limit(80)
    same(suffix_dedup(docs), brute_bytes([(r.doc_id, r.text) for r in docs.collect()], 400))


def test_suffix_dedup_against_induced_sorting(spark, sf_dir):
    rng = random.Random(4)
    for _ in range(300):
        x = [rng.randint(0, 3) for _ in range(rng.randint(0, 30))]
        assert induced_sorting.suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])
    rows = [(r.doc_id, r.text) for r in C.documents(spark, sf_dir).limit(60).collect()]
    rows += [(k, "".join(rng.choice("ab") for _ in range(300)) + "q" * 500) for k in range(1000, 1030)]  # one crowded prefix
    gone = induced_sorting.repeated([(t or "").encode() for _, t in rows], 400)
    got = suffix_dedup(frame(spark, rows).repartition(2)).select("doc_id", "n_removed").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, sum(g)) for (i, _), g in zip(rows, gone, strict=True)), key=str)


def test_seen_counts_as_if_row_by_row():
    rng = np.random.default_rng(1)
    for bound in (10_000, 20):
        before, others, least = C.Seen(bound), C.Seen(bound), C.Seen(bound)
        count, first, other, low = Counter(), {}, Counter(), {}
        for _ in range(20):
            k, v = rng.integers(0, 60, 50).astype(np.uint64), rng.integers(0, 5, 50)
            got = before.before(k), others.others(k, v), least.least(k, v)
            want = [], [], []
            for x, y in zip(k.tolist(), v.tolist(), strict=True):
                want[0].append(count[x])
                count[x] += 1
                want[1].append(other[x])
                other[x] += first.setdefault(x, y) != y
                low[x] = min(low.get(x, 99), y)
            want[2].extend(low[x] for x in k.tolist())
            if bound > 100:
                assert [g.tolist() for g in got] == list(want)
            else:  # keys are forgotten: never more than there was
                assert (got[0] <= want[0]).all() and (got[1] <= np.array(want[0])).all() and (got[2] >= want[2]).all()
    empty = np.zeros(0, np.uint64)
    assert not len(C.Seen().before(empty)) and not len(C.Seen().others(empty, empty.view(np.int64))) and not len(C.Seen().least(empty, empty.view(np.int64)))


def test_suffix_dedup_carries_and_keeps_whole_characters(spark):
    df = spark.createDataFrame([(1, "é" * 5 + "abcdefgh", "x"), (2, "è" * 5 + "abcdefgh", None)], "doc_id long, text string, source string")
    got = {r.doc_id: (r.kept, r.source) for r in suffix_dedup(df, 4, keep="text", carry=("source",)).collect()}
    assert set(got) == {1, 2} and got[1][1] == "x" and got[2][1] is None and all(set(k) <= {"é", "è"} for k, _ in got.values())


def test_disk_queue_sorts_beyond_memory():
    rng = np.random.default_rng(0)
    kind = np.dtype([("k", np.uint64), ("v", np.int32)])
    rows = np.empty(5000, kind)
    rows["k"], rows["v"] = rng.integers(0, 300, 5000), np.arange(5000)
    q = DiskQueue(kind, ["k", "v"], memory=4000)
    for a in range(0, 5000, 100):
        q.push(rows[a : a + 100])
    blocks = list(q.pops())
    assert len(blocks) > 5 and (np.concatenate(blocks) == np.sort(rows, order=["k", "v"])).all()
    assert all(set(a["k"]).isdisjoint(b["k"]) for a, b in zip(blocks, blocks[1:])) and q.folder is None


def brute_simhash(rows):
    marks = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        hs = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        marks.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    sets, a = simhash_dedup.Union(), np.array(marks, np.uint64)
    for k in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[k + 1 :] ^ a[k]) <= 3).tolist():
            sets.join(k, k + 1 + j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[sets.root(k)] = min(least.get(sets.root(k), i), i)
    return [(i, f"{marks[k]:016x}", least.get(sets.root(k))) for k, (i, _) in enumerate(rows)]


def test_simhash(spark):
    rows = awkward(4, 150, "abcdefgh", 20)
    same(simhash_dedup.simhash_dedup(frame(spark, rows)), brute_simhash(rows))


def test_simhash_on_documents(spark, sf_dir):
    docs = C.documents(spark, sf_dir)
    same(simhash_dedup.simhash_dedup(docs), brute_simhash([(r.doc_id, r.text) for r in docs.collect()]))


def test_manhattan_is_a_lower_bound_and_cells_meet():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    b = a.copy()
    for _ in range(3):
        b ^= np.uint64(1) << rng.integers(0, 64, 2000, dtype=np.uint64)
    assert (simhash_dedup.manhattan(simhash_dedup.embed(a), simhash_dedup.embed(b)) <= np.bitwise_count(a ^ b)).all()
    for blocks in (6, 7, 8, 10):
        same_cell = np.zeros(2000, bool)
        for m in simhash_dedup.masks(blocks):
            same_cell |= (simhash_dedup.embed(a) ^ simhash_dedup.embed(b)) & np.uint64(m) == 0
        assert same_cell.all()


def test_large_cells_lose_no_link(monkeypatch):
    rng = np.random.default_rng(0)
    bits = rng.choice(64, 16, replace=False)
    m = np.unique(np.array([sum(1 << int(b) for b in bits if rng.random() < 0.2) for _ in range(3000)], np.uint64))
    monkeypatch.setattr(simhash_dedup, "LARGE", 100)
    one, two = simhash_dedup.Union(), simhash_dedup.Union()
    simhash_dedup._link(m, 3, one)
    monkeypatch.setattr(simhash_dedup, "TILE", 64)
    simhash_dedup._link(m, 3, two, False)
    three = simhash_dedup.Union()
    for k, x in enumerate(m.tolist()):
        for y in m[k + 1 :][np.bitwise_count(m[k + 1 :] ^ m[k]) <= 3].tolist():
            three.join(x, y)
    assert all(one.root(x) == two.root(x) == three.root(x) for x in m.tolist())


def test_chain_of_links_is_one_component(spark):
    n = 40
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in simhash_dedup.components(links).collect()}
    assert all(got[i] == 0 for i in range(1, n + 1)) and got[101] == 100


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_bpe.default_path())


PIECES = ["a", "e", "the ", "  ", "\n", " ", "▁", "é", "1", "23", "\t", "🙂", "in", "on", "中", "</s>", "<s>", "<0x41>", "\r\n", "____", "===="]


def test_pieces_are_the_library_s(library):
    model, rng = piece_bpe.model(piece_bpe.default_path()), random.Random(5)
    cases = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    for t in [*cases, "a" * 3000, " " * 2000 + "x" + " " * 700, "=-" * 2000, "é" * 900, "x\x00y"]:
        ids = library.encode(t)
        assert model.encode_text(t) == ids
        assert model.decode(ids) == library.decode(ids)


def test_very_long_units_are_the_library_s(library):
    model, rng = piece_bpe.model(piece_bpe.default_path()), random.Random(6)
    for letters, n in (("abcdefghijklmnopqrstuvwxyz", 200_000), ("etaoinsh", 50_000), ("aé—ß漢\U0001f600x=", 50_000), ("ab\n", 50_000), ("-=*", 30_000)):
        t = "".join(rng.choice(letters) for _ in range(n))
        ids = model.encode_text(t)
        assert ids == library.encode(t) and model.decode(ids) == t


def test_proof_is_of_its_model():
    m = piece_bpe.model(piece_bpe.default_path())
    assert m.proven(m.proof()) == m.whole and len(m.proof()) < 8192
    with pytest.raises(ValueError, match="another model"):
        m.proven(b"x" * len(m.proof()))


def test_whole_units_are_single_tokens(library):
    for u in filter(None, sorted(piece_bpe.model(piece_bpe.default_path()).whole)):
        assert len(library.encode(u.replace("▁", " "))) == 1


def test_token_counts_and_codec(spark, sf_dir, library):
    rows = [(r.doc_id, r.text) for r in C.documents(spark, sf_dir).collect()] + [(None, None), (5, ""), (5, " a  b "), (6, "word " * 5000)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = [(i, t or "", library.encode(t or "")) for i, t in rows]
    same(token_counts(frame(spark, rows)), [(i, len(t.encode()), len(x), len(x) > 4096) for i, t, x in ids])
    same(encode_decode(frame(spark, rows)), [(i, len(x), sha(",".join(map(str, x))), sha(library.decode(x))) for i, t, x in ids])
    full = encode_decode(frame(spark, rows[-2:]), full=True).collect()
    assert [r.ids for r in full] == [x for _, _, x in ids[-2:]] and full[0].decoded == " a  b "


def brute_hits(rows, items, window=10):
    found = {}
    for item, t in items:
        w = decontamination.words((t or "").encode())
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            found.setdefault(tuple(w[k : k + n]), set()).add("null" if item is None else str(item))
    out = []
    for i, t in rows:
        w = decontamination.words((t or "").encode())
        hit, got = [False] * len(w), set()
        for n in {len(x) for x in found}:
            for s in range(len(w) - n + 1):
                if own := found.get(tuple(w[s : s + n])):
                    hit[s : s + n] = [True] * n
                    got |= own
        out.append((i, len(w), sum(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), any(hit)))
    return out


def test_decontamination(spark, sf_dir):
    rows = awkward(6, letters="aB") + [(40, "x, A-a b;B c! " * 30), (41, "solo"), (42, "Ünï é")]
    items = [(1, "a A b B c x a a b b c x a"), (10, "solo"), (2, "solo"), (None, "ünï É é"), (3, None), (4, ""), (5, "a b " * 20), (5, "a b " * 20)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    same(decontamination.decontaminate(frame(spark, rows), bench), brute_hits(rows, items))
    same(decontamination.decontaminate(frame(spark, rows), bench, block_bytes=60), brute_hits(rows, items))
    same(decontamination.decontaminate(frame(spark, rows), bench.limit(0)), brute_hits(rows, []))
    cut = decontamination.decontaminate(frame(spark, [(1, "Keep this. SOLO, and that")]), bench, clean=True).first().clean_text
    assert cut == "Keep this. , and that"


def test_quality_base_counts(spark, sf_dir):
    rows = awkward(7, letters="ab") + [(50, "one # two\none # two\n\n  \nx $"), (51, "é ü " * 9)]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    want = []
    for i, t in rows:
        w = (t or "").encode().split()
        seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        hit = set().union(*[range(k, k + 5) for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1])
        lines = [x for x in (t or "").encode().split(b"\n") if x.split()]
        failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
        want.append((i, len(w), sum(len(x.decode()) for x in w), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), failed, not failed))
    same(quality.quality(frame(spark, rows), labels), want)


def test_isolation_forest_by_hand():
    """Scores against paths followed one row and one tree at a time."""
    rng = np.random.default_rng(3)
    rows = np.concatenate((rng.normal(size=(300, 4)), rng.normal(6, 1, (5, 4)), np.zeros((3, 4))))
    f = quality.Forest(rows[:300], trees=20, size=64)
    usual = lambda n: 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n
    scores = f(rows)
    for k, row in enumerate(rows):
        lengths = []
        for t in range(20):
            node = 0
            while (at := f.feature[t, node]) >= 0:
                node = 2 * node + (2 if row[at] >= f.cut[t, node] else 1)
            lengths.append(f.extra[t, node])
        assert scores[k] == pytest.approx(2 ** -(np.mean(lengths) / usual(64)))
    drawn = np.bincount(f.feature[f.feature >= 0], minlength=4)
    assert drawn.min() > 0.7 * drawn.mean()
    assert scores[300:305].min() > np.quantile(scores[:300], 0.99)


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0), (2, 0)], [(1, 1), (1, 0), (2, 1), (None, 1)]])
def test_quality_with_few_labels(spark, labels):
    rows = [(1, "one two three four five six seven eight nine ten eleven"), (2, None), (2, "a b c d e f g h i j k l"), (3, ""), (None, "x " * 50)]
    got = quality.quality(frame(spark, rows), spark.createDataFrame([(*r, "z") for r in labels], "doc_id long, quality int, row string")).collect()
    assert len(got) == 5 and all(r.kept is not None and not (r.base_failed and r.kept) for r in got)
    assert sorted(r.n_words for r in got) == [0, 0, 11, 12, 50]


def test_quality_tells_labelled_rows_apart(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    train, test = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    got = quality.quality(C.documents(spark, sf), train).join(test, "doc_id").groupBy("quality", "base_failed", "kept").count().collect()
    n = {(r.quality, r.base_failed, r.kept): r["count"] for r in got}
    assert n.get((1, False, False), 0) <= 0.01 * n[1, False, True]
    assert n.get((0, False, True), 0) <= 0.05 * n[0, False, False]


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.toxicity(C.documents(spark, sf), labels).join(labels, "doc_id").where("held_out").select("toxic", "predicted").collect()
    hit = sum(r.toxic and r.predicted for r in rows)
    assert hit >= 0.7 * sum(r.toxic for r in rows) and sum(r.predicted and not r.toxic for r in rows) <= 0.03 * len(rows)


def test_toxicity_without_labels(spark):
    rows = [(None, None), (1, ""), (2, "text " * 3000)]
    got = toxicity.toxicity(frame(spark, rows), spark.createDataFrame([(9, None)], "doc_id long, toxic int")).collect()
    assert [(r.doc_id, r.score, r.predicted) for r in got] == [(None, 0.0, 0), (1, 0.0, 0), (2, 0.0, 0)]
    assert [r.held_out for r in got] == [True, zlib.crc32(b"1") % 5 == 0, zlib.crc32(b"2") % 5 == 0]


def test_license_rules(spark):
    mit = "MIT License\n\nCopyright (c) 2020 Somebody\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software."
    rows = [(1, mit), (2, "x.\nLicensed under the Apache License, Version 2.0.\nAll rights reserved."), (3, None), (4, ""), (5, "no licence here"), (6, "Licensed under CC BY-NC 4.0")]
    got = {r.doc_id: r.licenses for r in license_scan.license_scan(frame(spark, rows)).collect()}
    assert "MIT" in got[1].split(",") and got[2] == "Apache-2.0,all-rights-reserved" and got[3] == got[4] == got[5] == "" and got[6] == "CC-BY-NC-4.0"
    import re

    assert all(re.search(license_scan.SIGNS, s) for s in license_scan.SENTENCES)


def test_license_signs_and_blank_lines(spark):
    grant, notice, bsd, source, binary, isc = (next(s for s, k in license_scan.SENTENCES.items() if k == name) for name in ("mit_grant", "mit_notice", "bsd_conditions", "bsd_source", "bsd_binary", "isc_grant"))
    wrap = lambda s, end="\n": textwrap.fill(s, 60).replace("\n", end)
    free = next(s for s, k in license_scan.SENTENCES.items() if k == "unlicense")
    rows = [
        (1, "All rights\nreserved."), (2, "x\nAll  rights-reserved"), (3, free.replace("public domain", "public\ndomain")), (4, "All rights\n\nreserved"),
        (5, f"Copyright (c) 2020 X\n\n{wrap(grant)}:\n\n{wrap(notice)}.\n"), (6, f"Copyright (c) 2020 X\r\n{wrap(grant, chr(13) + chr(10))}:\r\n\r\n{wrap(notice, chr(13) + chr(10))}."),
        (7, f"Some Heading\n \n{wrap(bsd)}:\n\n1. {wrap(source)}.\n2. {wrap(binary)}."), (8, f"# Copyright (c) 2020 X\n#\n# {wrap(isc, chr(10) + '# ')}.\n"), (9, "rights of man reserved"),
    ]
    got = {r.doc_id: set(r.licenses.split(",")) for r in license_scan.license_scan(frame(spark, rows)).collect()}
    assert all(got[k] == {"all-rights-reserved"} for k in (1, 2, 4)) and got[3] == {"Unlicense"} and got[9] == {""}
    assert "MIT" in got[5] & got[6] and "BSD-2-Clause" in got[7] and "ISC" in got[8]


NOTICES = {
    "Zlib": "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not\nclaim that you wrote it.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published\nby the Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the rest.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.",
    "GPL-3.0": "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nCopyright (C) 2007 Free Software Foundation, Inc.\nEveryone is permitted to copy and distribute verbatim copies\nof this license document, but changing it is not allowed.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "0BSD": "Copyright (c) 2021 X\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.\n(See accompanying file)",
    "CC0-1.0": "To the extent possible under law, the person who associated CC0 with\nthis work has waived all copyright and related or neighboring rights to this work.",
    "BSD-4-Clause": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright\nnotice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright\nnotice, this list of conditions and the following disclaimer in the\ndocumentation and/or other materials provided with the distribution.\n3. All advertising materials mentioning features or use of this software\nmust display the following acknowledgement:\nThis product includes x.",
    "proprietary": "Unauthorized copying of this file, via any medium is strictly prohibited.",
}


def test_license_notices_as_they_are_written(spark):
    names = list(NOTICES)
    rows = [(k, f"int x = 1;\n\n{NOTICES[n]}\n\nMore text here.") for k, n in enumerate(names)] + [(100, "plain words " * 50_000), (101, NOTICES["Zlib"]), (101, NOTICES["Zlib"])]
    got = license_scan.license_scan(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id < 100:
            assert names[r.doc_id] in r.licenses.split(","), names[r.doc_id]
            assert not {"GPL-3.0-or-later", "MIT", "BSD-3-Clause", "BSD-2-Clause"} & set(r.licenses.split(",")), names[r.doc_id]
        else:
            assert r.licenses == ("Zlib" if r.doc_id == 101 else "")


def test_license_plan_is_native(spark, sf_dir):
    plan = queries.op3_license_scan(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


PAGE = """<html><head><title>t</title><style>p{{}}</style></head><body><div id="topMenu"><a href=x>Home</a></div>
<div class="content"><h1>Title {0}</h1><script>var a="</p>";</script><p>Para {0} one &amp; t<b>w</b>o<br>three<p>Next <i>it</i>em
<ul><li>a<li>b</ul><div class="ad-box">buy</div></div><div class="side-bar">links</div><div class=cookie_notice>We use</div><form>q</form><div id="comments">first!</div><footer>&copy; f</footer></body></html>"""


def test_html_region_from_the_host_s_wrapper(spark):
    rows = [(k, "http://h.example/" + str(k), PAGE.format(k)) for k in range(4)] + [(8, None, None), (9, "http://[bad", ""), (10, "http://other.example/", "<article>x&nbsp;y <nav>m</nav><p>z &lt;tag&gt; <aside>s</aside>&am")]
    df = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, host string")
    for limit in (1 << 20, 0):
        got = {r.page_id: (r.text, r.n_chars) for r in html_extraction.html_extraction(df, limit).collect()}
        for k in range(4):
            assert got[k][0] == f"Title {k} Para {k} one & two three Next item a b"
        assert got[8] == got[9] == ("", 0) and got[10][0] == "x y z <tag> &am" and got[10][1] == len(got[10][0])
    w = html_extraction.wrapper(html_extraction.parse(PAGE.format(1)))
    html_extraction._merge(w, html_extraction.wrapper(html_extraction.parse(PAGE.format(2).replace("<form>q</form>", ""))))
    e = html_extraction.expression(w)
    assert "(<form>" in e and "</>)?" in e and "(<p>#text</>)+" in e


def test_html_scripts_and_unclosed_elements():
    text = html_extraction.main_text
    for raw in ("<script>for(i=0;i<n;i++){f(i)}</script>", "<script>var a='<!--'</SCRIPT >", "<style>a:after{content:'<b'}</style>", "<textarea>a<b</textarea>", "<svg><title/></svg>", "<select><option>x<option>y</select>", "<button>b<i>c</i></button>"):
        assert text(f"<body>{raw}<article>one{raw}<p>two</article>") == "one two", raw
    for tag in ("button", "svg", "object", "noscript", "title", "select", "template"):
        assert text(f"<article>one<{tag}><p>two</article>") == "one two", tag
    assert text("<article>one <button>two<p>three<button>x</button> four</article>") == "one two three four"
    assert text("<article>one</article><script>x<y") == "one"


def test_html_names_that_articles_use():
    text = html_extraction.main_text
    for attr in ('class="content no-sidebar"', "class=has-header", 'class="with-sidebar"', "class=sidebar-right", "id=header-wrap"):
        assert text(f"<div {attr}><article><h1>T</h1><p>one two three</article></div><nav>x</nav>") == "T one two three", attr
    assert text("<div class=article-header><h1>T</h1></div><h2 id=related-work>R</h2><h2 id=search-methods>S</h2><h3 id=banner-ads class=header>B</h3><section class=social-science>s</section>".join(("<article>", "</article>"))) == "T R S B s"
    assert text("<article>a <math><mi>x</mi></math> <audio>b</audio> <object>c</object> d<span class=notice>e</span>f</article>") == "a x b c def"
    assert text("<form id=all><article>one two</article><div class=related><a href=x>more</a></div></form>") == "one two"
    for attr in ("class=sidebar", "class=cookie_notice", "id=topMenu", "class='post-related'", "role=search", "class=ad-box"):
        assert text(f"<article>one two three<div {attr}><a href=x>m</a></div></article>") == "one two three", attr


def test_html_regions_of_a_host_with_several_shapes():
    rng = random.Random(5)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    frame_ = "<body><div class=masthead>The Daily Thing, since 1900, for all</div>{}<div class=blurb><p>Words that stand on every page of this host.</p></div></body>"
    want, pages = [], []
    for k in range(8):
        a, b = words(60), words(40)
        want.append(f"T{k} {a} {b}")
        text = f"<h1>T{k}</h1><p>{a}</p><section><p>{b}</p></section>"
        body = f"<div class=story>{text}</div>" if k else f"<article>{text}</article>"
        pages.append(frame_.format(body + (f"<div class=deck><article><a href=x>{words(4)}</a></article></div>" if k == 3 else "")))
    w = None
    for p in pages:
        one = html_extraction.wrapper(html_extraction.parse(p))
        w = one if w is None else (html_extraction._merge(w, one), w)[1]
    known = html_extraction.region(w)
    assert [html_extraction.main_text(p, known) for p in pages] == want
    other = words(50)
    assert html_extraction.main_text(frame_.format(f"<div class=odd>{other}</div>"), known) == other
    assert html_extraction.main_text(frame_.format(f"<div class=one>{other}</div><div class=two>{words(9)}</div>").replace("blurb", "x"), None).startswith("The Daily")


def test_html_deep_long_and_oddly_nested_pages():
    text = html_extraction.main_text
    deep = html_extraction.DEPTH * 20
    assert text("<div>" * deep + "a<nav>n</nav>b" + "</div>" * deep + "c") == "a b c"
    assert text("<article>" + "<div>x" * deep + "</div>y" * deep + "</article>") == " ".join(["x"] * deep + ["y"] * deep)
    assert text("<datalist><option value=a><option value=b></datalist><p>real text") == "real text"
    assert text("<article>one " + "<p>w</p><h2>v</h2>" * 20_000 + "</article>") == "one" + " w v" * 20_000
    a = html_extraction.wrapper(html_extraction.parse("<article>" + "<p>w</p><h2>v</h2>" * 3000))
    html_extraction._merge(a, html_extraction.wrapper(html_extraction.parse("<article>" + "<h2>v</h2><div>x</div><p>w</p>" * 2000)))
    assert a["n"] == 2


def test_alignment_is_a_longest_common_subsequence():
    rng = random.Random(3)
    for _ in range(500):
        x, y = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                best[i + 1][j + 1] = best[i][j] + 1 if a == b else max(best[i][j + 1], best[i + 1][j])
        got = html_extraction._aligned(x, y)
        assert len(got) == best[-1][-1] and all(x[i] == y[j] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))


@pytest.mark.parametrize("order", range(3))
def test_html_labelled_pages_of_many_templates(spark, order):
    """Pages made from templates without article elements or telling names: the wrapper alone has to find the text."""
    rng = random.Random(11)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(n))
    rows, want = [], {}
    for h in range(6):
        outer, inner, box = (f"{rng.choice('klmnop')}{rng.choice('qrstuv')}{x}" for x in "abc")
        fixed, links = words(25), [words(2) for _ in range(12)]
        for k in range(12):
            title, blocks = words(4), [words(rng.randint(20, 60)) for _ in range(rng.randint(2, 5))]
            kinds = [rng.choice(("p", "blockquote", "li", "pre")) for _ in blocks]
            body = f"<h1>{title}</h1>" + "".join(f"<{t}>{b}</{t}>" for t, b in zip(kinds, blocks, strict=True))
            top = "<div class=x1>" + "".join(f"<a href=/{i}>{x}</a> " for i, x in enumerate(links)) + "</div>"
            ad = f"<div class={box}>{words(5)}</div>" if rng.random() < 0.5 else ""
            rows.append((100 * h + k, f"http://h{h}.example/{k}", f"<body>{top}<div class={outer}>{ad}<div class={inner}>{body}</div></div><div class=x2><p>{fixed}</p></div></body>"))
            want[100 * h + k] = " ".join([title, *blocks])
    random.Random(order).shuffle(rows)
    df = spark.createDataFrame(rows + rows[:2], "page_id long, url string, html string").repartition(3)
    got = html_extraction.html_extraction(df).collect()
    assert len(got) == len(rows) + 2
    assert {r.page_id: r.text for r in got} == want


def test_empty_tables(spark):
    docs = frame(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    for df in (token_counts(docs), substring_dedup(docs), license_scan.license_scan(docs), toxicity.toxicity(docs, labels), decontamination.decontaminate(docs, bench), encode_decode(docs), simhash_dedup.simhash_dedup(docs), suffix_dedup(docs), quality.quality(docs, labels)):
        assert df.count() == 0 and "doc_id" in df.columns
    assert html_extraction.html_extraction(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_one_of_each_keeps_one_row_of_each_group(spark):
    rng = random.Random(3)
    a, b, c, d = (" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(120)) for _ in range(4))
    rows = [(5, a), (5, a), (7, a), (None, a), (5, b), (9, b), (None, c), (None, c), (8, d), (3, d + " "), (3, d), (3, d), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    near = corpus_pipeline.near_dedup(spark, docs, "")
    got = sorted(((r.doc_id, (r.text or "").strip()) for r in near.collect()), key=str)
    assert got == sorted([(5, a), (5, b), (None, c), (3, d), (None, "")], key=str)
    left = {r.text.strip() for r in corpus_pipeline.substring_removal(spark, near, "").collect()}
    assert left == {a, b, c, d, ""}  # nothing of a kept document repeats


def test_pipeline(spark, sf_dir):
    docs = C.documents(spark, sf_dir)
    texts = {}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == corpus_pipeline.COLUMNS
        rows = docs.collect()
        texts = {r.doc_id: r.text for r in rows}
        assert set(texts) <= set(before) and all(r.n_chars == len(r.text) for r in rows)
        if k == 0:
            verdicts = quality.quality(C.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()
            assert set(texts) == {r.doc_id for r in verdicts if r.kept} and all(texts[i] == before[i] for i in texts)
        if k == 1:
            want = {c for _, _, c in brute_simhash(list(before.items()))}
            assert set(texts) == want
        if k == 2:
            body = {i: (t or "").encode() for i, t in before.items()}
            gone = induced_sorting.repeated(list(body.values()), 400)
            want = {i: bytes(x for x, g in zip(b, flags, strict=True) if not g).decode("utf-8", "ignore") for (i, b), flags in zip(body.items(), gone, strict=True)}
            assert texts == want and any(map(any, gone))
        if k == 3:
            bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            hit = {i for i, *_, bad in brute_hits(list(before.items()), bench) if bad}
            assert hit and {i for i in before if before[i] != texts[i]} == hit
    model = piece_bpe.model(piece_bpe.default_path())
    want = [(i, len(ids := model.encode_text(t)), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts.items()]
    same(corpus_pipeline.run(spark, sf_dir), want)


def test_pipeline_of_awkward_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    some = [(None, None), (1, ""), (1, None), (2, "one two " * 30), (3, "wörter " + "x" * 30_000), (3, "wörter " + "x" * 30_000), (4, " ".join(f"w{k}" for k in range(4000)))]
    for name, rows in (("none", []), ("some", [(i, t, None, "s", 0) for i, t in some])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(None, 1, 0), (2, None, None), (4, 1, 0)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(None, None), (7, "")] if rows else [], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        assert [r.doc_id for r in got] == ([4] if rows else [])  # the others have fewer than ten words or repeat themselves


def test_toxicity_scores_by_hand(spark):
    """Scores by plain use of the library, window by window, from the same fitted contents; repeated and contradicting rows."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("bcdfgaeiou") for _ in range(rng.randint(3, 8)))
    rows = []
    for k in range(400):
        words = [word() for _ in range(rng.randint(0, 90))]
        if k % 4 == 0:
            words = [w for x in words for w in ((x, rng.choice(("vilewretch", "foulthing"))) if rng.random() < 0.2 else (x,))]
        rows.append((k, " ".join(words)))
    rows += [(None, rows[0][1]), (0, rows[0][1]), (4, "other text"), (500, None)]
    labels = [(k, int(k % 4 == 0)) for k in range(400)] + [(8, 0), (None, 1), (9, None)]
    docs, marks = frame(spark, rows), spark.createDataFrame([(*x, "d") for x in labels], "doc_id long, toxic int, data string")
    toxic, ordinary = toxicity.sample(docs, marks)
    toxic.sort(), ordinary.sort()
    contents, middle = toxicity.fit(toxic, ordinary, toxicity.refuted(docs, marks, toxic, ordinary))
    assert b"vilewretch" in contents[0] and b"vilewretch" not in contents[1] and len(contents[0]) == len(contents[1])

    def packed(content, window):
        p = zstandard.ZstdCompressionParameters.from_level(toxicity.LEVEL, source_size=128, dict_size=len(content), min_match=toxicity.MATCH, write_content_size=False, write_checksum=False, write_dict_id=False)
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress(window))

    got = toxicity.toxicity(docs, marks).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t in rows:
        w = (t or "").lower().encode().split()
        saved = [packed(contents[1], b" " + b" ".join(w[a : a + 16]) + b" ") - packed(contents[0], b" " + b" ".join(w[a : a + 16]) + b" ") for a in range(0, len(w), 16)]
        distance = sum(sorted((max(0, x) for x in saved), reverse=True)[: toxicity.TOP])
        want.setdefault(i, []).append(1 / (1 + math.exp(min(60.0, middle - distance))))
    for i in want:
        assert sorted(r.score for r in got if r.doc_id == i) == pytest.approx(sorted(want[i]))
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    judged = [(r.predicted, int(r.doc_id % 4 == 0)) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert sum(p == t for p, t in judged) >= 0.9 * len(judged)
