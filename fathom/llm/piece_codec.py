"""SentencePiece encoding and decoding of whole texts by vectorised merge rounds (see piece_bpe).

Each distinct unit of a chunk is encoded and decoded once; a text's ids and decoded text are put together
from its units. The text is read once and nothing is shuffled. Null texts are empty: no ids, empty text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _common as C
from . import piece_bpe

BOUND = 100_000


class UnitCodes(dict):
    """unit -> (number of ids, the ids in decimal with commas, decoded bytes)."""

    def __init__(self, path: str):
        self.model = piece_bpe.model(path)
        self.decimal = [b"%d" % i for i in range(len(self.model.pieces))]

    def learn(self, units: set[str]) -> None:
        new = list(units.difference(self))
        if len(self) + len(new) > BOUND:
            self.clear()
            new = list(units)
        ids, end = self.model.encode([self.model.written(u) for u in new])
        ids, start = ids.tolist(), 0
        for u, e in zip(new, end.tolist(), strict=True):
            own = ids[start:e]
            self[u] = (e - start, b",".join([self.decimal[i] for i in own]), b"".join([self.model.surface[i] for i in own]))
            start = e


_codes: dict[str, UnitCodes] = {}


def _codec(path: str) -> UnitCodes:
    if path not in _codes:
        _codes[path] = UnitCodes(path)
    return _codes[path]


def _run(path: str, full: bool):
    def run(batches):
        from fathom.llm import piece_codec  # by reference, so that the process keeps its units

        known = piece_codec._codec(path)
        for b in C.pieces(batches):
            units = [known.model.units(x or "") for x in b.column("text").to_pylist()]
            known.learn(set().union(*units))
            n, hashes, decoded, ids, plain = [], [], [], [], []
            for u in units:
                got = [known[x] for x in u]
                n.append(sum([g[0] for g in got]))
                line = b",".join([g[1] for g in got])
                text = b"".join([g[2] for g in got])
                text = text[1:] if text[:1] == b" " else text
                hashes.append(hashlib.sha256(line).hexdigest())
                decoded.append(hashlib.sha256(text).hexdigest())
                if full:
                    ids.append(np.array(line.split(b","), np.int32) if line else np.zeros(0, np.int32))
                    plain.append(text.decode())
            cols = [b.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if full:
                cols += [pa.array(ids, pa.list_(pa.int32())), pa.array(plain, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def encode_decode(docs: DataFrame, path: str | None = None, full: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256; with full, also ids and decoded."""
    C.small_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * full
    return docs.select("doc_id", "text").mapInArrow(_run(path or piece_bpe.default_path(), full), schema)
