"""Quality rules: an isolation forest on rule statistics, calibrated on labelled rows.

Every document gets the statistics that quality rules look at. Random trees are grown on the statistics of a
bounded sample of rows labelled good; a document that such trees isolate in few splits is unlike them. The
anomaly score above which a document is rejected is calibrated on labelled rows of both kinds.

The sample is bounded by a documented parameter; judging reads every text once and shuffles nothing.

A null text has no words. Documents that fail the base rules are rejected before the forest is asked.
With no labelled good row only the base rules decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

U64 = np.uint64
MAX_LABELLED = 20_000  # labelled rows at most, those with the smallest hash of doc_id
TREES, ROWS, SEED = 200, 512, 42
MARGIN = 3.0  # in robust units, see Verdict
LOSS = 0.002  # share of good labelled rows that the threshold may reject
MIN_WORDS, REPEAT_PERCENT, SPAN = 10, 20, 5
_SPACE = b" \t\n\x0b\x0c\r"
_CONTINUED = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
_UPPER, _DIGITS, _STOPS, _OTHER = bytes(range(65, 91)), b"0123456789", b".,;:", b"!?@/=_-+"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "mean_word", "symbols", "dup_lines", "repeats", "upper", "digits", "stops", "other", "distinct", "longest", "words_a_line", "wide"]


def repeat_words(words: list[list[bytes]], names: C.Names, span: int = SPAN) -> np.ndarray:
    """For each document, its words inside a window of ``span`` words that it has twice or more."""
    size = np.array([len(w) for w in words], np.int64)
    out = np.zeros(len(words), np.int64)
    count = np.maximum(size - span + 1, 0)
    if not count.sum():
        return out
    sym = names.of([x for w in words for x in w])
    begin = np.cumsum(size) - size
    doc = np.repeat(np.arange(len(size)), count)
    start = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count - begin, count)
    key = C.mix(C.RangeHash(sym)(start, start + span) + C.mix(doc.astype(U64) + U64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    change = np.zeros(len(sym) + 1, np.int32)
    at = start[again]
    np.add.at(change, at, 1)
    np.add.at(change, at + span, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(change[:-1]) > 0)))
    return covered[begin + size] - covered[begin]


def statistics(bodies: list[bytes], names: C.Names) -> tuple[np.ndarray, np.ndarray]:
    """(the base counts, the features) of each text."""
    words = [t.split() for t in bodies]
    again = repeat_words(words, names)
    base, rest = np.zeros((len(bodies), len(BASE)), np.int64), np.zeros((len(bodies), 9))
    for k, (t, w) in enumerate(zip(bodies, words, strict=True)):
        n = len(t)
        lines = [x for x in t.split(b"\n") if x.strip()]
        chars = len(t.translate(None, _SPACE + _CONTINUED))
        base[k] = len(w), chars, n - len(t.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), again[k]
        rest[k] = (
            n - len(t.translate(None, _UPPER)), n - len(t.translate(None, _DIGITS)), n - len(t.translate(None, _STOPS)), n - len(t.translate(None, _OTHER)),
            len(set(w)), max(map(len, w), default=0), len(lines), n, chars,
        )
    n_words, chars = np.maximum(base[:, 0], 1), np.maximum(base[:, 1], 1)
    features = np.column_stack((
        np.log1p(base[:, 0]), base[:, 1] / n_words, base[:, 2] / chars, base[:, 3] / np.maximum(rest[:, 6], 1), base[:, 4] / n_words, rest[:, 0] / chars, rest[:, 1] / chars,
        rest[:, 2] / n_words, rest[:, 3] / chars, rest[:, 4] / n_words ** 0.9, np.log1p(rest[:, 5]), np.log1p(base[:, 0] / np.maximum(rest[:, 6], 1)), rest[:, 7] / chars,
    ))
    return base, features


def base_failed(base: np.ndarray) -> np.ndarray:
    return (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > REPEAT_PERCENT * base[:, 0])


def _usual(n: np.ndarray | float):
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class Forest:
    """Isolation trees as flat arrays; scores are 2 ** -(mean path / usual path).

    Every split draws its statistic with equal chances. Cuts are drawn from the range of a node's rows and MARGIN
    beyond it on both sides, so that a row unlike any of them, even in a statistic in which they do not differ,
    leaves them at such a cut.
    """

    def __init__(self, rows: np.ndarray, trees: int = TREES, size: int = ROWS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        size = min(size, len(rows))
        self.depth = max(1, int(np.ceil(np.log2(max(size, 2)))))
        nodes = 2 ** (self.depth + 1) - 1
        self.feature = np.full((trees, nodes), -1, np.int32)
        self.cut = np.zeros((trees, nodes))
        self.extra = np.zeros((trees, nodes))
        for t in range(trees):
            self._grow(t, 0, rows[rng.choice(len(rows), size, replace=False)], 0, rng)
        self.usual = max(float(_usual(size)), 1e-9)

    def _grow(self, t: int, node: int, rows: np.ndarray, depth: int, rng) -> None:
        if depth == self.depth or len(rows) < 2:
            self.extra[t, node] = depth + float(_usual(len(rows)))
            return
        f = int(rng.integers(rows.shape[1]))
        cut = rng.uniform(rows[:, f].min() - MARGIN, rows[:, f].max() + MARGIN)
        self.feature[t, node], self.cut[t, node] = f, cut
        right = rows[:, f] >= cut
        self._grow(t, 2 * node + 1, rows[~right], depth + 1, rng)
        self._grow(t, 2 * node + 2, rows[right], depth + 1, rng)

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        each = np.arange(len(rows))
        for t in range(len(self.feature)):
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                f = self.feature[t, node]
                go = rows[each, np.maximum(f, 0)] >= self.cut[t, node]
                node = np.where(f >= 0, 2 * node + 1 + go, node)
            total += self.extra[t, node]
        return 2.0 ** -(total / len(self.feature) / self.usual)


def _between(good: np.ndarray, bad: np.ndarray) -> float:
    """The threshold above which most bad scores lie and at most LOSS of the good ones, in the middle of its gap."""
    floors = [float(good.max()), float(np.quantile(good, 1 - LOSS))]
    above = [np.sort(bad[bad > f]) for f in floors]
    if not len(above[1]):
        return max(floors[0], float(bad.max(initial=0)))
    k = int(len(above[0]) < 0.99 * len(above[1]))
    return (floors[k] + float(above[k][0])) / 2


class Verdict:
    """Keeps what the forest finds usual. Statistics are scaled by those of good rows, in robust units."""

    def __init__(self, good: np.ndarray, bad: np.ndarray):
        self.middle = np.median(good, 0)
        low, high = np.quantile(good, [0.01, 0.99], axis=0)
        self.scale = np.maximum(high - low, 1e-3)
        far_good, far_bad = self._far(good), self._far(bad)
        self.forest = Forest(far_good)
        self.threshold = _between(self.forest(far_good), self.forest(far_bad))

    def _far(self, rows: np.ndarray) -> np.ndarray:
        x = (rows - self.middle) / self.scale
        return np.sign(x) * np.log1p(np.abs(x))

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        return self.forest(self._far(rows)) <= self.threshold


def _features(batches):
    names = C.Names()
    for b in C.pieces(batches):
        names.fresh()
        base, rows = statistics(C.texts(b), names)
        yield pa.RecordBatch.from_arrays([b.column("quality"), pa.array(base_failed(base)), pa.array(list(rows), pa.list_(pa.float64()))], names=["quality", "failed", "row"])


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Verdict | None:
    """A verdict learnt from at most ``most`` labelled documents; a doc_id with both labels is bad."""
    rows = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    rows = rows.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # at most ``most`` rows of two numbers
    got = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").select("quality", "text").mapInArrow(_features, "quality int, failed boolean, row array<double>").collect()
    good, bad = ([r.row for r in got if r.quality == q and not r.failed] for q in (1, 0))
    if not good:
        return None
    good, bad = (np.array(sorted(x)).reshape(-1, len(FEATURES)) for x in (good, bad))
    return Verdict(good, bad)


def _judge(model):
    def run(batches):
        verdict: Verdict | None = model.value
        names = C.Names()
        for b in C.pieces(batches):
            names.fresh()
            base, rows = statistics(C.texts(b), names)
            failed = base_failed(base)
            kept = ~failed & (verdict(rows) if verdict else True)
            cols = [b.column("doc_id").cast(pa.int64()), *(pa.array(base[:, k]) for k in range(len(BASE))), pa.array(failed), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *BASE, "base_failed", "kept"])

    return run


def _keep(model):
    def run(batches):
        verdict: Verdict | None = model.value
        names = C.Names()
        for b in C.pieces(batches):
            names.fresh()
            base, rows = statistics(C.texts(b), names)
            yield b.filter(pa.array(~base_failed(base) & (verdict(rows) if verdict else True)))

    return run


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    docs needs doc_id and text; labels needs doc_id and quality (1 good, 0 bad).
    """
    C.small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    schema = "doc_id long, " + ", ".join(f"{x} long" for x in BASE) + ", base_failed boolean, kept boolean"
    return docs.select("doc_id", "text").mapInArrow(_judge(model), schema)


def quality_filter(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that quality() keeps, with all their columns."""
    C.small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    return docs.mapInArrow(_keep(model), docs.schema)
