"""A priority queue of fixed-size records that lives on disk beyond a stated amount of memory."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np


class DiskQueue:
    """Push blocks of records in any order, pop them in ascending order of the given keys.

    Pushed records gather in memory; each time ``memory`` bytes are reached they are sorted and written as one
    run. pops() then walks the runs together, a range of the first key at a time, so that at any moment only
    about ``memory`` bytes are held, and records with equal first keys come in the same block. The runs are in
    the task's own temporary folder and go with the queue: a lost executor's task simply starts again.
    """

    def __init__(self, kind: np.dtype, keys: list[str], memory: int = 64 << 20):
        self.kind, self.keys, self.memory = np.dtype(kind), keys, memory
        self.held: list[np.ndarray] = []
        self.size, self.runs, self.folder, self.count = 0, [], None, 0

    def push(self, block: np.ndarray) -> None:
        self.held.append(block)
        self.size += block.nbytes
        self.count += len(block)
        if self.size >= self.memory:
            self._spill()

    def _sorted(self, blocks: list[np.ndarray]) -> np.ndarray:
        all_ = np.concatenate(blocks) if len(blocks) != 1 else blocks[0]
        return all_[np.lexsort([all_[k] for k in reversed(self.keys)])]

    def _spill(self) -> None:
        if self.held:
            self.folder = self.folder or tempfile.mkdtemp(prefix="queue-")
            path = os.path.join(self.folder, f"{len(self.runs)}.npy")
            np.save(path, self._sorted(self.held))
            self.runs.append(path)
            self.held, self.size = [], 0

    def pops(self) -> Iterator[np.ndarray]:
        try:
            if not self.runs:
                if self.held:
                    yield self._sorted(self.held)
                return
            self._spill()
            runs = [np.load(p, mmap_mode="r") for p in self.runs]
            first = self.keys[0]
            total = sum(r.nbytes for r in runs)
            pieces = max(1, 2 * total // self.memory)
            sample = np.sort(np.concatenate([np.asarray(r[first][:: max(1, len(r) // (8 * pieces))]) for r in runs]))
            bounds = np.unique(sample[np.linspace(0, len(sample) - 1, pieces + 1).astype(int)[1:-1]])
            at = [0] * len(runs)
            for bound in [*bounds, None]:
                to = [len(r) if bound is None else int(np.searchsorted(r[first], bound, "right")) for r in runs]
                block = [np.array(r[a:b]) for r, a, b in zip(runs, at, to, strict=True) if b > a]
                at = to
                if block:
                    yield self._sorted(block)
        finally:
            self.close()

    def close(self) -> None:
        self.held = []
        if self.folder:
            shutil.rmtree(self.folder, ignore_errors=True)
            self.folder = None
