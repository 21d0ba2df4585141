"""MRC images and stacks: a 1024-byte header, an extended header, and pixels."""

from __future__ import annotations

import bz2
import lzma
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import ship

# Pixel types by mode.
MODES = {0: "i1", 1: "i2", 2: "f4", 6: "u2", 12: "f2"}


def decode(data: bytes) -> np.ndarray:
    """Pixels as (section, row, column); four-bit pixels (mode 101) low half first."""
    order = ">" if data[212:213] == b"\x11" else "<"
    nx, ny, nz, mode = struct.unpack(order + "4i", data[:16])
    at = 1024 + struct.unpack(order + "i", data[92:96])[0]
    if mode == 101:
        row = (nx + 1) // 2
        raw = np.frombuffer(data, "u1", nz * ny * row, at).reshape(nz, ny, row)
        return np.stack((raw & 15, raw >> 4), -1).reshape(nz, ny, 2 * row)[:, :, :nx].astype("f4")
    if mode not in MODES:
        raise ValueError(f"mode {mode}")
    return np.frombuffer(data, order + MODES[mode], nx * ny * nz, at).reshape(nz, ny, nx).astype("f4")


def encode(stack: np.ndarray, pixel: float = 1.0) -> bytes:
    """A stack of 32-bit pixels as a file."""
    a = np.ascontiguousarray(stack, "<f4").reshape((-1, *stack.shape[-2:]))
    nz, ny, nx = a.shape
    head = struct.pack("<10i6f3i3f2i", nx, ny, nz, 2, 0, 0, 0, nx, ny, nz, nx * pixel, ny * pixel, nz * pixel, 90, 90, 90, 1, 2, 3, a.min(initial=0), a.max(initial=0), a.mean() if a.size else 0, 0, 0)
    head += bytes(208 - len(head)) + b"MAP " + b"\x44\x44\0\0"
    return head + bytes(1024 - len(head)) + a.tobytes()


def read_images(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, section from 1, ny, nx, pixels) of all images of MRC files, also of bz2 and xz ones."""
    ship(spark)

    def run(batches):
        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                data = bz2.decompress(data) if path.endswith(".bz2") else lzma.decompress(data) if path.endswith(".xz") else data
                a = decode(data)
                n = len(a)
                cols = [pa.array([path] * n), pa.array(range(1, n + 1), pa.int64()), pa.array([a.shape[1]] * n, pa.int32()), pa.array([a.shape[2]] * n, pa.int32()), pa.array(list(a.reshape(n, -1)), pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays(cols, names=["path", "section", "ny", "nx", "pixels"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, "path string, section long, ny int, nx int, pixels array<float>")
