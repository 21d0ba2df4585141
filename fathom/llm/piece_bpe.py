"""Byte-pair encoding of a SentencePiece model in vectorised merge rounds.

A text is cut where the vocabulary proves that nothing merges across: before a space that follows another
character, and before a line break that no longer piece contains. The cuts are units. Units not met before
are encoded together: one flat numpy array of symbols, in each round the least pair rank of every unit
(a segmented minimum), all its leftmost non-overlapping pairs merged at once, the array compacted, until no
unit has a pair left. Where a merge could make a pair of no higher rank, only the leftmost is merged, so the
result is always that of one merge at a time.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
from array import array

import numpy as np

SPACE = "▁"
_NONE = np.iinfo(np.int32).max
LONG = 600  # symbols of a unit beyond which a linked list with a heap is used: rounds would be as many


class PieceModel:
    """Vocabulary and merges of a model file.

    Only what the library does for BPE models with the identity normaliser, a dummy prefix, escaped and
    unfolded white space and no user-defined pieces is covered; other models raise ValueError.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            data = f.read()
        proto.ParseFromString(data)
        self.digest = hashlib.sha256(data).digest()
        n, t = proto.normalizer_spec, proto.trainer_spec
        kinds = {p.type for p in proto.pieces}
        if t.model_type != t.BPE or n.precompiled_charsmap or not n.add_dummy_prefix or n.remove_extra_whitespaces or not n.escape_whitespaces or t.treat_whitespace_as_suffix or kinds & {4, 5}:
            raise ValueError(f"{path}: a BPE model with identity normaliser and dummy prefix is needed")
        self.pieces = [p.piece for p in proto.pieces]
        self.byte_fallback = t.byte_fallback
        self.unk = next(i for i, p in enumerate(proto.pieces) if p.type == 2)
        self.bytes = {int(p.piece[3:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        if any(SPACE in p[1:] and p.strip(SPACE) for p in normal):
            raise ValueError(f"{path}: pieces that hold a space after another character")
        self.breaks = not any("\n" in p and len(p) > 1 for p in normal)
        self.surface = [b"" for _ in self.pieces]
        for p, i in normal.items():
            self.surface[i] = p.replace(SPACE, " ").encode()
        for b, i in self.bytes.items():
            self.surface[i] = bytes([b])
        self.surface[self.unk] = t.unk_surface.encode()
        # characters of pieces that are no pieces themselves get ids beyond the vocabulary
        chars = sorted({c for p in normal for c in p})
        extra = {c: len(self.pieces) + k for k, c in enumerate(c for c in chars if c not in normal)}
        self.char = {ord(c): normal.get(c, extra.get(c)) for c in chars}
        self.points = np.array(sorted(self.char), np.uint32)
        self.point_ids = np.array([self.char[p] for p in self.points.tolist()], np.int32)
        self.width = len(self.pieces) + len(extra) + 1
        scores = sorted({-proto.pieces[i].score for i in normal.values()})
        rank = {s: k for k, s in enumerate(scores)}
        ranks = np.full(self.width, _NONE, np.int32)
        for i in normal.values():
            ranks[i] = rank[-proto.pieces[i].score]
        both = normal | extra
        keys, made = [], []
        careful = np.zeros(len(scores) + 1, bool)
        for p, i in normal.items():
            for k in range(1, len(p)):
                a, b = both.get(p[:k]), both.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a * self.width + b)
                    made.append(i)
                    for part in (a, b):
                        if ranks[part] != _NONE and ranks[i] <= ranks[part]:
                            careful[ranks[part]] = True
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max)
        self.made = np.append(np.array(made, np.int32)[order], -1).astype(np.int32)
        self.ranks, self.careful = ranks, careful
        self.split = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*" if self.breaks else f"{SPACE}+[^{SPACE}]*")

    # --- units ---------------------------------------------------------------------------------------------

    def units(self, text: str) -> list[str]:
        """The units of a text. One that starts with a space is written without that; a line break shows the others."""
        if not text:
            return []
        if SPACE in text or "  " in text or text[0] == " ":
            return [u[1:] if u[0] == SPACE else u for u in self.split.findall(SPACE + text.replace(" ", SPACE))]
        return (text.replace("\n", " \n") if self.breaks else text).split(" ")

    def written(self, unit: str) -> str:
        return unit if self.breaks and unit[:1] == "\n" else SPACE + unit

    # --- merging -------------------------------------------------------------------------------------------

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.width + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.made[at], -1)

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units, one behind the other, and where each unit ends. The units are as written()."""
        if not units:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        out: list[np.ndarray | None] = [None] * len(units)
        short = []
        for k, u in enumerate(units):
            if len(u) > LONG:
                out[k] = self._by_heap(u)
            else:
                short.append(k)
        if short:
            sym, begin = self._rounds([units[k] for k in short])
            for k, a, b in zip(short, begin.tolist(), [*begin[1:].tolist(), len(sym)], strict=True):
                out[k] = sym[a:b]
        size = np.array([len(x) for x in out], np.int64)
        flat = self._spelt(np.concatenate(out), size)
        return flat

    def _symbols(self, text: str) -> np.ndarray:
        """A piece for each character; one that is in no piece is -1 less its code point."""
        point = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.points, point), len(self.points) - 1)
        return np.where(self.points[at] == point, self.point_ids[at], -1 - point.astype(np.int64)).astype(np.int32)

    def _rounds(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sym = self._symbols("".join(units))
        size = np.array([len(u) for u in units], np.int64)
        begin = np.cumsum(size) - size
        n = len(units)
        unit = np.repeat(np.arange(n), size)
        done_sym, done_unit = [], []
        made = np.full(len(sym), -1, np.int32)
        inside = np.flatnonzero(unit[:-1] == unit[1:])
        inside = inside[(sym[inside] >= 0) & (sym[inside + 1] >= 0)]
        made[inside] = self._pairs(sym[inside], sym[inside + 1])
        while len(sym):
            rank = np.where(made >= 0, self.ranks[made], _NONE)
            start = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
            length = np.diff(np.concatenate((start, [len(sym)])))
            least = np.minimum.reduceat(rank, start)
            over = np.repeat(least == _NONE, length)
            if over.any():  # units without a pair leave the array
                done_sym.append(sym[over])
                done_unit.append(unit[over])
                sym, unit, made, rank = sym[~over], unit[~over], made[~over], rank[~over]
                alive = least != _NONE
                length, least = length[alive], least[alive]
                if not len(sym):
                    break
            here = np.flatnonzero(rank == np.repeat(least, length))
            new_run = np.concatenate(([True], here[1:] != here[:-1] + 1))
            run = here[new_run][np.cumsum(new_run) - 1]
            pick = here[(here - run) % 2 == 0]
            if self.careful[least].any():
                u = unit[pick]
                first = np.concatenate(([True], u[1:] != u[:-1]))
                pick = pick[first | ~self.careful[rank[pick]]]
            sym[pick] = made[pick]
            keep = np.ones(len(sym), bool)
            keep[pick + 1] = False
            changed = np.zeros(len(sym), bool)
            changed[pick] = True
            sym, unit, made, changed = sym[keep], unit[keep], made[keep], changed[keep]
            again = changed.copy()
            again[:-1] |= changed[1:]
            at = np.flatnonzero(again)
            made[at] = -1
            at = at[at + 1 < len(sym)]
            at = at[(unit[at] == unit[at + 1]) & (sym[at] >= 0) & (sym[at + 1] >= 0)]
            made[at] = self._pairs(sym[at], sym[at + 1])
        sym, unit = np.concatenate(done_sym), np.concatenate(done_unit)
        order = np.argsort(unit, kind="stable")
        sym, unit = sym[order], unit[order]
        return sym, np.searchsorted(unit, np.arange(n))

    def _by_heap(self, text: str) -> np.ndarray:
        """One unit by a linked list and a heap of rank and place in one number: some 120 bytes a character."""
        start = self._symbols(text)
        n = len(start)
        ok = (start[:-1] >= 0) & (start[1:] >= 0)
        made = np.full(n, -1, np.int32)
        made[:-1][ok] = self._pairs(start[:-1][ok], start[1:][ok])
        at = np.flatnonzero(made >= 0)
        heap = (self.ranks[made[at]].astype(np.int64) << 32 | at).tolist()
        heapq.heapify(heap)
        sym, after, before, now = (array("i", x.astype(np.int32).tobytes()) for x in (start, np.arange(1, n + 1), np.arange(-1, n - 1), made))
        gone, pair, ranks, width, low = bytearray(n), self._pair_table(), self._rank_list(), self.width, (1 << 32) - 1
        while heap:
            top = heapq.heappop(heap)
            i = top & low
            k = now[i]
            if k < 0 or ranks[k] != top >> 32:  # the pair that stood here has changed since
                continue
            j = after[i]
            sym[i], gone[j], now[j] = k, 1, -1
            after[i] = end = after[j]
            if end < n:
                before[end] = i
            for x, y in ((before[i], i), (i, end)):
                if x < 0:
                    continue
                m = pair.get(sym[x] * width + sym[y], -1) if y < n and sym[x] >= 0 and sym[y] >= 0 else -1
                now[x] = m
                if m >= 0:
                    heapq.heappush(heap, ranks[m] << 32 | x)
        return np.frombuffer(sym, np.int32)[np.frombuffer(gone, np.uint8) == 0].copy()

    @functools.cache  # noqa: B019 - one model for each process
    def _rank_list(self) -> list[int]:
        return self.ranks.tolist()

    @functools.cache  # noqa: B019 - one model for each process
    def _pair_table(self) -> dict[int, int]:
        return dict(zip(self.keys[:-1].tolist(), self.made[:-1].tolist(), strict=True))

    def _spelt(self, sym: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters that are no pieces become byte pieces, or the unknown piece."""
        odd = np.flatnonzero((sym < 0) | (sym >= len(self.pieces)))
        end = np.cumsum(size)
        if not len(odd):
            return sym, end
        back = {v: k for k, v in self.char.items()}
        spelt, times = [], np.ones(len(sym), np.int64)
        for i in odd.tolist():
            s = int(sym[i])
            raw = chr(-1 - s if s < 0 else back[s]).encode("utf-8", "surrogatepass")
            ids = [self.bytes[b] for b in raw] if self.byte_fallback else [self.unk]
            times[i] = len(ids)
            spelt.append(ids)
        flat = np.repeat(sym, times)
        to = np.cumsum(times) - times
        for i, ids in zip(odd.tolist(), spelt, strict=True):
            flat[to[i] : to[i] + len(ids)] = ids
        return flat, np.concatenate(([0], np.cumsum(times)))[end]

    # --- whole texts ---------------------------------------------------------------------------------------

    def encode_text(self, text: str) -> list[int]:
        return self.encode([self.written(u) for u in self.units(text)])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids that encode() gave; broken byte runs of other ids become U+FFFD."""
        raw = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return raw[1:] if raw[:1] == " " else raw

    @functools.cached_property
    def whole(self) -> frozenset[str]:
        """The units that are a piece and encode alone as that one token, proven by encoding each of them."""
        found = [p for p in self.pieces if p[:1] == SPACE and self.units_of(p) == [p]]
        _, end = self.encode(found)
        n = np.diff(np.concatenate(([0], end)))
        return frozenset(p[1:] for p, k in zip(found, n.tolist(), strict=True) if k == 1)

    def proof(self) -> bytes:
        """whole as a bit for each piece of the vocabulary, after a digest of the model file: made once, sent to all."""
        return self.digest + np.packbits([p[:1] == SPACE and p[1:] in self.whole for p in self.pieces]).tobytes()

    def proven(self, proof: bytes) -> frozenset[str]:
        """whole from a proof, which has to be of this model file."""
        if proof[: len(self.digest)] != self.digest:
            raise ValueError("the proof is of another model file")
        bits = np.unpackbits(np.frombuffer(proof, np.uint8, offset=len(self.digest)), count=len(self.pieces))
        return frozenset(self.pieces[i][1:] for i in np.flatnonzero(bits).tolist())

    def units_of(self, written: str) -> list[str]:
        return self.split.findall(written)


@functools.lru_cache(maxsize=4)
def model(path: str) -> PieceModel:
    """The model of a file, loaded once in each process."""
    return PieceModel(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
