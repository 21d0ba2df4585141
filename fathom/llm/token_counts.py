"""Token counts by the whole-token shortcut.

Which units of text encode alone as one token is proven offline, by encoding every candidate of the vocabulary
(`PieceModel.whole`): once, on the driver, before any text is read. Tasks get the proof as a bit for each piece, tied to the
model file by its digest. Proven units count one each without merging. Only the rest is merged, each distinct unit
once per chunk and process. The text is read once and nothing is shuffled.

Null texts are empty: 0 bytes, 0 tokens. Special strings inside texts are ordinary text, as the library has it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _common as C
from . import piece_bpe

BOUND = 200_000  # units remembered between chunks, as memory allows
LIMIT = 4096


class UnitCounts(dict):
    """Tokens of each unit: those proven to be one token from the start, others as they are met."""

    def __init__(self, path: str, proof: bytes):
        self.model = piece_bpe.model(path)
        self.whole = self.model.proven(proof)
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.update(dict.fromkeys(self.whole, 1))

    def learn(self, units: set[str]) -> None:
        new = list(units.difference(self))
        if len(self) + len(new) > BOUND + len(self.whole):
            self.reset()
            new = list(units.difference(self))
        _, end = self.model.encode([self.model.written(u) for u in new])
        self.update(zip(new, np.diff(np.concatenate(([0], end))).tolist(), strict=True))


_counts: dict[tuple[str, bytes], UnitCounts] = {}


def _counter(path: str, proof: bytes) -> UnitCounts:
    if (path, proof) not in _counts:
        _counts[path, proof] = UnitCounts(path, proof)
    return _counts[path, proof]


def _count(path: str, proof: bytes, limit: int):
    def run(batches):
        from fathom.llm import token_counts  # by reference, so that the process keeps its counts

        known = token_counts._counter(path, proof)
        for b in C.pieces(batches):
            body = [x or "" for x in b.column("text").to_pylist()]
            units = [known.model.units(t) for t in body]
            known.learn(set().union(*units))
            tokens = [sum(map(known.__getitem__, u)) for u in units]
            size = [len(t.encode()) for t in body]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return run


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens)."""
    C.small_batches(docs.sparkSession)
    path = path or piece_bpe.default_path()
    return docs.select("doc_id", "text").mapInArrow(_count(path, piece_bpe.model(path).proof(), limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
