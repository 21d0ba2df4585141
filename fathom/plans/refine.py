"""Refinement of images against references over classes, in-plane rotations and shifts: a coarse pass over all samples, a
fine pass over the children of significant ones, weighted sums and halves.

References are a model on the driver, a few images that are sent to the tasks; images stay where they are and are
compared a batch at a time. Samples are rows (image, class, rotation, shift) with their squared difference, so that
weights, cuts and sums are the relational operators of operators.sequences.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import images as I
from ..operators import sequences as W
from ..session import ship

SAMPLE = "class int, psi double, dy double, dx double, diff2 double"


def rotated(a: np.ndarray, degrees: float) -> np.ndarray:
    """An image turned about n // 2, bilinear, 0 beyond the edge; quarter turns of square images move pixels exactly."""
    ny, nx = a.shape
    t = np.radians(degrees)
    c, s = np.cos(t), np.sin(t)
    y, x = np.mgrid[:ny, :nx].astype(float)
    y, x = y - ny // 2, x - nx // 2
    sy, sx = np.round(c * y - s * x + ny // 2, 9), np.round(s * y + c * x + nx // 2, 9)
    y0, x0 = np.floor(sy).astype(int), np.floor(sx).astype(int)
    out = np.zeros_like(a, float)
    for p in (0, 1):
        for q in (0, 1):
            w = (sy - y0 if p else 1 - (sy - y0)) * (sx - x0 if q else 1 - (sx - x0))
            ok = (y0 + p >= 0) & (y0 + p < ny) & (x0 + q >= 0) & (x0 + q < nx)
            out += np.where(ok, w, 0) * a[np.clip(y0 + p, 0, ny - 1), np.clip(x0 + q, 0, nx - 1)]
    return out


def differences(df: DataFrame, key: str, pixels: str, refs: np.ndarray, psis: list[float], shifts: list[tuple[float, float]], sigma2: float = 1.0, samples: str | None = None) -> DataFrame:
    """(key, class, psi, dy, dx, diff2): squared differences over 2 sigma2 of each image, moved by (dy, dx), to each reference turned by psi.

    With ``samples``, an array column of (class, psi, dy, dx), only those of each image are compared.
    """
    ship(df.sparkSession)
    k, ny, nx = refs.shape
    turned: dict[tuple[int, float], np.ndarray] = {}
    kind = df.schema[key].dataType

    def reference(c: int, psi: float) -> np.ndarray:
        if (c, psi) not in turned:
            if len(turned) > 4096:
                turned.clear()
            turned[c, psi] = rotated(refs[c], psi).ravel()
        return turned[c, psi]

    def run(batches):
        every = [(c, float(p), float(dy), float(dx)) for c in range(k) for p in psis for dy, dx in shifts]
        for b in batches:
            for part in range(0, b.num_rows, 64):
                rows = b.slice(part, 64)
                own = rows.column(samples).to_pylist() if samples else None
                index, columns = [], [[] for _ in range(5)]
                for i, data in enumerate(rows.column(pixels).to_pylist()):
                    if data is None:
                        continue
                    image, moved = np.array(data, float).reshape(ny, nx), {}
                    todo = every if own is None else [(s["class"], s["psi"], s["dy"], s["dx"]) for s in own[i] or []]
                    for c, p, dy, dx in todo:
                        if (dy, dx) not in moved:
                            moved[dy, dx] = I.shift(image, dy, dx).ravel()
                        d = moved[dy, dx] - reference(c, p)
                        index.append(i)
                        for col, v in zip(columns, (c, p, dy, dx, float(d @ d) / (2 * sigma2)), strict=True):
                            col.append(v)
                arrays = [rows.column(key).take(pa.array(index, pa.int64())), pa.array(columns[0], pa.int32()), *[pa.array(c, pa.float64()) for c in columns[1:]]]
                yield pa.RecordBatch.from_arrays(arrays, names=[key, "class", "psi", "dy", "dx", "diff2"])

    return df.select(key, pixels, *([samples] if samples else [])).mapInArrow(run, f"`{key}` {kind.simpleString()}, {SAMPLE}")


def offset_log_prior(dy: Column, dx: Column, sigma2: float, pixel: float = 1.0) -> Column:
    """Gaussian prior of a shift; with next to no variance only no shift is allowed."""
    d2 = (dy * dy + dx * dx) * pixel * pixel
    return F.when(d2 == 0, 0.0).otherwise(float("-inf")) if sigma2 < 1e-4 else -d2 / (2 * sigma2)


def weights(samples: DataFrame, key: str, share: list[float] | None = None, offset_sigma2: float | None = None, best_only: bool = False) -> DataFrame:
    """Samples with their weight: softmax with priors, or, in a first iteration, all of it on the best sample."""
    if best_only:
        best = samples.groupBy(key).agg(F.min_by(F.struct("class", "psi", "dy", "dx", "diff2"), F.struct("diff2", "class", "psi", "dy", "dx")).alias("b"))
        return best.select(key, "b.*", F.lit(1.0).alias("weight"))
    prior = F.lit(0.0)
    if share is not None:
        prior = prior + F.log(F.element_at(F.array(*[F.lit(float(x)) for x in share]), F.col("class") + 1))
    if offset_sigma2 is not None:
        prior = prior + offset_log_prior(F.col("dy"), F.col("dx"), offset_sigma2)
    return W.softmax_weights(samples, key, "diff2", prior)


def children(samples: DataFrame, key: str, psi_step: float, shift_step: float) -> DataFrame:
    """(key, samples): for each image the finer samples around its significant ones, half a step to either side, each once."""
    near = [(p, y, x) for p in (-0.25, 0.25) for y in (-0.25, 0.25) for x in (-0.25, 0.25)]
    grid = F.array(*[F.struct(F.lit(p * psi_step).alias("p"), F.lit(y * shift_step).alias("y"), F.lit(x * shift_step).alias("x")) for p, y, x in near])
    s = samples.where("significant").withColumn("__c", F.explode(grid))
    s = s.select(key, "class", (F.col("psi") + F.col("__c.p")).alias("psi"), (F.col("dy") + F.col("__c.y")).alias("dy"), (F.col("dx") + F.col("__c.x")).alias("dx")).distinct()
    return s.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("class", "psi", "dy", "dx"))).alias("samples"))  # bounded by the significant samples of one image


def class_sums(df: DataFrame, key: str, pixels: str, weighted: DataFrame, ny: int, nx: int, *halves: str) -> DataFrame:
    """(half…, class, i, sum, weight) of images put in place by their samples, weighted: partial sums meet by place of the mean."""
    ship(df.sparkSession)
    fields = [f"`{h}` {df.schema[h].dataType.simpleString()}" for h in halves]
    grouped = weighted.where("weight > 0").groupBy(key).agg(F.collect_list(F.struct("class", "psi", "dy", "dx", "weight")).alias("__s"))  # samples of one image

    def run(batches):
        total: dict[tuple, np.ndarray] = {}
        for b in batches:
            groups = list(zip(*(b.column(h).to_pylist() for h in halves), strict=True)) if halves else [()] * b.num_rows
            for data, samples, h in zip(b.column(pixels).to_pylist(), b.column("__s").to_pylist(), groups, strict=True):
                image, moved = np.array(data, float).reshape(ny, nx), {}
                for s in samples:
                    at = s["dy"], s["dx"]
                    if at not in moved:
                        moved[at] = I.shift(image, *at)
                    t = total.setdefault((*h, s["class"]), np.zeros(ny * nx + 1))
                    t[:-1] += s["weight"] * rotated(moved[at], -s["psi"]).ravel()
                    t[-1] += s["weight"]
        for (*h, c), t in total.items():
            n = ny * nx
            cols = [pa.array([v] * n) for v in h] + [pa.array([c] * n, pa.int32()), pa.array(np.arange(n), pa.int32()), pa.array(t[:-1]), pa.array(np.full(n, t[-1]))]
            yield pa.RecordBatch.from_arrays(cols, names=[*halves, "class", "i", "sum", "weight"])

    parts = df.select(key, pixels, *halves).join(grouped, key).mapInArrow(run, ", ".join([*fields, "class int, i int, sum double, weight double"]))
    return parts.groupBy(*halves, "class", "i").agg(F.sum("sum").alias("sum"), F.sum("weight").alias("weight"))


def maximised(sums: DataFrame, *halves: str) -> DataFrame:
    """Class means from sums; a class without weight is 0."""
    return sums.select(*halves, "class", "i", F.when(F.col("weight") > 0, F.col("sum") / F.col("weight")).otherwise(0.0).alias("v"), "weight")


def converged(history: list[dict], patience: int = 2, change: float = 0.01) -> bool:
    """Whether neither resolution (shells) nor, by more than ``change``, assignments have moved for so many iterations."""
    if len(history) <= patience:
        return False
    last = history[-1 - patience :]
    return all(b["shell"] <= last[0]["shell"] and abs(b["assigned"] - a["assigned"]) <= change for a, b in zip(last, last[1:], strict=False))


def refine(df: DataFrame, key: str, pixels: str, refs: np.ndarray, psis: list[float], shifts: list[tuple[float, float]], iterations: int, fraction: float = 0.999, sigma2: float = 1.0) -> tuple[np.ndarray, list[float]]:
    """(references, mean best weight after each iteration): all samples, their weights, the significant ones' sums."""
    history = []
    for n in range(iterations):
        w = weights(differences(df, key, pixels, refs, psis, shifts, sigma2), key, best_only=n == 0)
        if n:
            w = W.significant_samples(w, key, "weight", fraction).where("significant")
            total = w.groupBy(key).agg(F.sum("weight").alias("__t"), F.max("weight").alias("__m"))
            w = w.join(total, key).withColumn("weight", F.col("weight") / F.col("__t"))
            history.append(float(total.agg(F.avg(F.col("__m") / F.col("__t"))).first()[0]))
        k, ny, nx = refs.shape
        new = np.zeros((k, ny * nx))
        for r in maximised(class_sums(df, key, pixels, w, ny, nx)).toLocalIterator():  # as many rows as the model has pixels
            new[r["class"], r.i] = r.v
        used = np.abs(new).sum(1) > 0
        refs = np.where(used[:, None, None], new.reshape(k, ny, nx), refs)
    return refs, history
