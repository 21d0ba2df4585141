"""Distributions and special functions: closed forms as Columns, the others as Arrow-backed functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def gaussian(x: Column, sigma: float, mu: float = 0.0) -> Column:
    return F.exp(-F.pow((x - mu) / sigma, F.lit(2.0)) / 2) / (sigma * math.sqrt(2 * math.pi))


def gaussian_2d(x: Column, y: Column, sx: float, sy: float, angle: float = 0.0, mx: float = 0.0, my: float = 0.0) -> Column:
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    u, v = (x - mx) * c + (y - my) * s, -(x - mx) * s + (y - my) * c
    return F.exp(-F.pow(u / sx, F.lit(2.0)) / 2 - F.pow(v / sy, F.lit(2.0)) / 2) / (2 * math.pi * sx * sy)


def student(x: Column, df: float, sigma: float = 1.0, mu: float = 0.0) -> Column:
    """Density of Student's distribution with a width."""
    front = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / (sigma * math.sqrt(math.pi * df))
    return front * F.pow(1 + F.pow((x - mu) / sigma, F.lit(2.0)) / df, F.lit(-(df + 1) / 2))


def within(x: Column, sigma: float, mu: float = 0.0) -> Column:
    """Probability of a normal value within x of the mean."""
    return _erf(F.abs(x - mu) / (sigma * math.sqrt(2)))


def normal_cdf(x: Column) -> Column:
    return (1 + _erf(x / math.sqrt(2))) / 2


def _vectorised(f):
    @F.pandas_udf(T.DoubleType())
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if v is None or np.isnan(v) else f(v) for v in s.to_numpy(float)], dtype=float)

    return run


_erf = _vectorised(math.erf)
log_gamma = _vectorised(math.lgamma)


def _series(k: int, sign: int, x: float) -> float:
    """J_k (sign -1) or I_k (sign 1), by Simpson's rule on the integral form."""
    t = np.linspace(0, math.pi, 4001)
    y = np.cos(k * t - x * np.sin(t)) if sign < 0 else np.exp(x * np.cos(t)) * np.cos(k * t)
    w = np.ones(4001)
    w[1:-1:2], w[2:-1:2] = 4, 2
    return float((w * y).sum() * (t[1] - t[0]) / 3 / math.pi)


def bessel_j(k: int):
    return _vectorised(lambda x: _series(k, -1, x))


def bessel_i(k: int):
    return _vectorised(lambda x: _series(k, 1, x))


def zernike(n: int, m: int, rho: Column, phi: Column) -> Column:
    """Zernike polynomial Z(n, m), sines for negative m."""
    k = abs(m)
    if n < k or (n - k) % 2:
        return F.lit(0.0)
    terms = [(-1) ** s * math.factorial(n - s) // (math.factorial(s) * math.factorial((n + k) // 2 - s) * math.factorial((n - k) // 2 - s)) * F.pow(rho, F.lit(float(n - 2 * s))) for s in range((n - k) // 2 + 1)]
    return sum(terms[1:], terms[0]) * (F.cos(k * phi) if m >= 0 else F.sin(k * phi))


def uniform_draw(key: Column, seed: int, low: float = 0.0, high: float = 1.0) -> Column:
    """A number in (low, high) that only the key and the seed decide, so that any engine with md5 draws the same."""
    from ..operators.table import random_key

    return low + (high - low) * (random_key(key, seed) + 0.5) / 2.0**32


def gaussian_draw(key: Column, seed: int, sigma: float = 1.0, mu: float = 0.0) -> Column:
    """A normal value by the polar form of two uniform ones."""
    return mu + sigma * F.sqrt(-2 * F.log(uniform_draw(key, seed))) * F.cos(2 * math.pi * uniform_draw(key, seed + 1))


def log_draw(key: Column, seed: int, low: float, high: float) -> Column:
    """A number whose logarithm is uniform."""
    return F.exp(uniform_draw(key, seed, math.log(low), math.log(high)))


def kaiser_blob(r: Column, a: float, alpha: float, m: int) -> Column:
    """Kaiser-Bessel blob of radius a: 0 beyond it."""
    s = F.sqrt(F.greatest(F.lit(0.0), 1 - F.pow(r / a, F.lit(2.0))))
    return F.when(r > a, 0.0).otherwise(F.pow(s, F.lit(float(m))) * bessel_i(m)(alpha * s) / _series(m, 1, alpha))
