"""Toxicity by compression distance: two zstandard dictionaries, one of toxic and one of ordinary text.

Both dictionaries are trained from labelled rows and share the same common words of ordinary text. The toxic one
also holds the words whose contexts in toxic documents are many and, per context, far more than in ordinary ones;
contexts rather than occurrences are counted so that copies of one document count once. Words that a larger sample of
ordinary rows has too often are refused. The other has filler of
the same size in that place, so both give equal lengths to a window unless toxic words shorten it. Windows of
whole texts are compressed with both; a document's distance is the sum of its largest three savings in bytes.
A logistic curve turns the distance into a score. Its middle is calibrated on labelled rows that the dictionaries
used for it were not trained on (four folds, each judged by dictionaries of the other three).

The labelled sample is bounded by documented parameters; scoring reads every text once and shuffles nothing.

Null and empty texts have no windows: distance 0. With no toxic or no ordinary labelled row every score is 0.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

WORDS = 16  # in a window
TOP = 3  # savings summed
MAX_TOXIC, MAX_ORDINARY = 5000, 10_000  # labelled rows at most, those with the smallest hash of doc_id
MAX_REFUTING = 40_000  # ordinary labelled rows in which the words found are counted
CONTEXTS, RATIO = 6, 40.0  # what makes a word toxic
COMMON = 30_000  # ordinary words in both dictionaries
LEVEL, MATCH = 5, 5
SLOPE = 1.0
FOLDS = 4
MOST_FALSE = 0.01  # share of ordinary labelled rows that the calibrated middle may flag


def windows(text: bytes, words: int = WORDS) -> list[bytes]:
    w = text.lower().split()
    return [b" " + b" ".join(w[i : i + words]) + b" " for i in range(0, len(w), words)]


def _contexts(bodies: list[bytes], block: int = 1 << 20) -> dict[bytes, int]:
    """Different pairs of neighbours of each word."""
    number: dict[bytes, int] = {}
    pairs, owner = [], []
    at = 0
    while at < len(bodies):
        flat: list[int] = []
        while at < len(bodies) and len(flat) < block:  # number 0 stands between texts
            flat += [number.setdefault(w, len(number) + 1) for w in bodies[at].lower().split()]
            flat.append(0)
            at += 1
        n = np.array([0, *flat], np.int64)
        mixed = C.mix(n.astype(np.uint64) + np.uint64(1))
        mid = n[1:-1]
        key = C.mix(mixed[:-2] * np.uint64(0xA0761D6478BD642F) + mixed[2:] * np.uint64(0xE7037ED1A0B428DB) + mixed[1:-1])
        key, first = np.unique(key[mid > 0], return_index=True)
        pairs.append(key)
        owner.append(mid[mid > 0][first].astype(np.int32))
    if not number:
        return {}
    _, first = np.unique(np.concatenate(pairs), return_index=True)
    count = np.bincount(np.concatenate(owner)[first], minlength=len(number) + 1)
    return dict(zip(number, count[1:].tolist(), strict=True))


def _marked(t: dict[bytes, int], o: dict[bytes, int]) -> list[bytes]:
    """Words whose contexts in toxic documents are many and, per context, far more than in ordinary ones."""
    all_t, all_o = max(1, sum(t.values())), max(1, sum(o.values()))
    return sorted((w for w, n in t.items() if n >= CONTEXTS and n / all_t > RATIO * (o.get(w, 0) + 0.5) / all_o), key=lambda w: (t[w], w))


def train(toxic: list[bytes], ordinary: list[bytes], refused: frozenset[bytes] = frozenset()) -> tuple[bytes, bytes]:
    """Contents of the two dictionaries; refused words are not toxic."""
    t, o = _contexts(toxic), _contexts(ordinary)
    marked = [w for w in _marked(t, o) if w not in refused]
    own = b" " + b" ".join(marked) + b" "
    chosen = set(marked)
    common = sorted((w for w in o if w not in chosen), key=lambda w: (-o[w], w))[:COMMON]
    base = b" " + b" ".join(reversed(common)) + b" "
    return own + base, b"\0" * len(own) + base


class Distance:
    """Savings of the toxic dictionary over the ordinary one."""

    def __init__(self, contents: tuple[bytes, bytes]):
        self.press = []
        for content in contents:
            p = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=128, dict_size=len(content), min_match=MATCH, write_content_size=False, write_checksum=False, write_dict_id=False)
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=p)
            self.press.append(zstandard.ZstdCompressor(dict_data=d, compression_params=p))

    def __call__(self, text: bytes) -> int:
        toxic, ordinary = (p.compress for p in self.press)
        top = [0] * TOP
        for w in windows(text):
            saved = len(ordinary(w)) - len(toxic(w))
            if saved > top[0]:
                top[0] = saved
                top.sort()
        return sum(top)


def calibrate(distance: np.ndarray, toxic: np.ndarray) -> float:
    """The distance that divides labelled rows with the best F1 among those that flag at most MOST_FALSE of the ordinary
    ones (or the largest), halfway to the next lower one."""
    values = np.unique(distance)
    best, at = -1.0, max(1.0, float(values[-1]))
    for low, v in zip([0, *values.tolist()], values.tolist(), strict=False):
        hit = distance >= v
        right = int((hit & toxic).sum())
        f1 = 2 * right / max(1, int(hit.sum()) + int(toxic.sum()))
        if v > 0 and f1 > best and int(hit.sum()) - right <= MOST_FALSE * int((~toxic).sum()):
            best, at = f1, (low + v) / 2
    return at


def fit(toxic: list[bytes], ordinary: list[bytes], refused: frozenset[bytes] = frozenset()) -> tuple[tuple[bytes, bytes], float] | None:
    """(dictionary contents, middle of the logistic curve); None if there is nothing to learn from."""
    if not toxic or not ordinary:
        return None
    got, truth = [], []
    for fold in range(FOLDS):
        inside = lambda x, k=fold: xxhash.xxh3_64_intdigest(x[:64]) % FOLDS == k
        judge = [[x for x in docs if inside(x)] for docs in (toxic, ordinary)]
        d = Distance(train(*([x for x in docs if not inside(x)] for docs in (toxic, ordinary)), refused))
        for label, docs in zip((True, False), judge, strict=True):
            got += [d(x) for x in docs]
            truth += [label] * len(docs)
    return train(toxic, ordinary, refused), calibrate(np.array(got), np.array(truth))


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 5 == 0


def _labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of labelled rows that are not held out."""
    key = F.col("doc_id").cast("string")
    rows = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(F.crc32(key.cast("binary")) % 5 != 0)
    return rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def _first(rows: DataFrame, label: int, most: int) -> DataFrame:
    return rows.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[bytes], list[bytes]]:
    """Texts of at most MAX_TOXIC toxic and MAX_ORDINARY other labelled rows that are not held out."""
    rows = _labelled(labels)
    picked = _first(rows, 1, MAX_TOXIC).unionByName(_first(rows, 0, MAX_ORDINARY))
    # at most MAX_TOXIC + MAX_ORDINARY rows of two numbers
    got = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id").select("toxic", "text").toArrow()
    body = got.column("text").cast(pa.large_binary())
    toxic, ordinary = (body.filter(pc.equal(got.column("toxic"), label)).to_pylist() for label in (1, 0))
    return toxic, ordinary


def _found(candidates):
    def run(batches):
        words, count, docs = candidates.value, {}, 0
        for b in C.pieces(batches):
            for t in C.texts(b):
                docs += 1
                for w in words.intersection(t.lower().split()):
                    count[w] = count.get(w, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([b"", *count], pa.binary()), pa.array([docs, *count.values()], pa.int64())], names=["word", "n"])

    return run


def refuted(docs: DataFrame, labels: DataFrame, toxic: list[bytes], ordinary: list[bytes]) -> frozenset[bytes]:
    """Words that look toxic in the sample but not in a larger one: of MAX_REFUTING ordinary rows, only those words are counted."""
    marked = set(_marked(_contexts(toxic), _contexts(ordinary)))
    if not marked:
        return frozenset()
    had: dict[bytes, int] = {}
    for t in toxic:
        for w in marked.intersection(t.lower().split()):
            had[w] = had.get(w, 0) + 1
    rows = docs.select("doc_id", "text").join(F.broadcast(_first(_labelled(labels), 0, MAX_REFUTING).select("doc_id")), "doc_id")
    counts = rows.select("text").mapInArrow(_found(docs.sparkSession.sparkContext.broadcast(marked)), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    n = {bytes(r.word): r.n for r in counts.collect()}  # one row for each marked word
    total = max(1, n.get(b"", 0))
    return frozenset(w for w in marked if had.get(w, 0) / max(1, len(toxic)) <= RATIO * (n.get(w, 0) + 0.5) / total)


def _score(model):
    def run(batches):
        found = model.value
        distance = Distance(found[0]) if found else None
        for b in C.pieces(batches):
            score = [1 / (1 + math.exp(min(60.0, -SLOPE * (distance(t) - found[1])))) if found else 0.0 for t in C.texts(b)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), pa.array([held_out(i) for i in C.ids(b)], pa.bool_()), pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return run


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    docs needs doc_id and text; labels needs doc_id and toxic. Only labels of rows that are not held out
    (crc32 of doc_id as text, modulo 5, not 0) are read for learning; a doc_id with both labels is toxic.
    A null doc_id is held out.
    """
    C.small_batches(docs.sparkSession)
    toxic, ordinary = sample(docs, labels)
    toxic.sort(), ordinary.sort()
    refused = refuted(docs, labels, toxic, ordinary)
    model = docs.sparkSession.sparkContext.broadcast(fit(toxic, ordinary, refused))
    return docs.select("doc_id", "text").mapInArrow(_score(model), "doc_id long, held_out boolean, score double, predicted int")
