"""Contrast transfer function of an electron microscope as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def wavelength(kilovolts: Column) -> Column:
    """Electron wavelength in Angstrom."""
    v = kilovolts * 1e3
    return 12.2643247 / F.sqrt(v * (1.0 + v * 0.978466e-6))


def phase(x: Column, y: Column, u: Column, v: Column, angle: Column, kilovolts: Column, cs: Column, amplitude: Column, shift: Column) -> Column:
    """The argument of the sine, in radians; u, v in Angstrom, angle and shift in degrees, cs in mm."""
    lam = wavelength(kilovolts)
    c, s = F.cos(F.radians(angle)), F.sin(F.radians(angle))
    axx, axy, ayy = -(u * c * c + v * s * s), -(u - v) * c * s, -(u * s * s + v * c * c)
    r2 = x * x + y * y
    k3 = F.atan(amplitude / F.sqrt(1 - amplitude * amplitude))
    return math.pi * lam * (axx * x * x + 2 * axy * x * y + ayy * y * y) + (math.pi / 2) * cs * 1e7 * F.pow(lam, F.lit(3.0)) * r2 * r2 - F.radians(shift) - k3


def ctf(x, y, u, v, angle, kilovolts, cs, amplitude, b_factor: Column | None = None, scale: Column | None = None, shift: Column | None = None, dose: Column | None = None) -> Column:
    """Value at spatial frequency (x, y) in 1/Angstrom. Damping is by dose where it is given and not negative, else by B-factor."""
    b_factor, scale, shift, dose = (F.lit(d) if c is None else c for c, d in ((b_factor, 0.0), (scale, 1.0), (shift, 0.0), (dose, -1.0)))
    r2 = x * x + y * y
    out = -F.sin(phase(x, y, u, v, angle, kilovolts, cs, amplitude, shift))
    critical = 0.245 * F.pow(F.sqrt(r2), F.lit(-1.665)) + 2.81
    out = out * F.when(dose >= 0, F.exp(-0.5 * dose / critical)).otherwise(F.exp(-b_factor / 4 * r2)) * scale
    return F.when(F.abs(out) < 1e-8, F.signum(out) * 1e-8).otherwise(out)


def dose_weight(k: Column, dose: Column) -> Column:
    """Weight of a frame at frequency k before normalisation over frames."""
    return F.exp(-dose / (2 * (0.245 * F.pow(k, F.lit(-1.665)) + 2.81)))


def ctf_complex(x, y, u, v, angle, kilovolts, cs, amplitude, shift: Column | None = None, positive: bool = True) -> tuple[Column, Column]:
    """(re, im) of the transfer function for one side of the Ewald sphere."""
    g = phase(x, y, u, v, angle, kilovolts, cs, amplitude, F.lit(0.0) if shift is None else shift)
    return -F.sin(g), F.cos(g) if positive else -F.cos(g)


def phase_gradient(x, y, u, v, angle, kilovolts, cs) -> tuple[Column, Column]:
    """Slope of the phase in x and y."""
    lam = wavelength(kilovolts)
    c, s = F.cos(F.radians(angle)), F.sin(F.radians(angle))
    axx, axy, ayy = -(u * c * c + v * s * s), -(u - v) * c * s, -(u * s * s + v * c * c)
    k1, k2 = math.pi * lam, (math.pi / 2) * cs * 1e7 * F.pow(lam, F.lit(3.0))
    r2 = x * x + y * y
    return 2 * k1 * (axx * x + axy * y) + 4 * k2 * r2 * x, 2 * k1 * (ayy * y + axy * x) + 4 * k2 * r2 * y


def frame_weights(df, frame_keys: list[str], k: str, dose: str, name: str = "weight"):
    """Weight of each frame at frequency k, normalised so that the squares of a frequency's frames add up to 1."""
    from pyspark.sql import Window

    w = dose_weight(F.col(k), F.col(dose))
    out = df.withColumn(name, w)
    return out.withColumn(name, F.col(name) / F.sqrt(F.sum(F.col(name) * F.col(name)).over(Window.partitionBy(*frame_keys, k))))


def in_pixels(length: Column, size: Column, pixel: Column) -> Column:
    """A resolution as a shell of a box, and the other way round: the same formula."""
    return size * pixel / length
