"""ZYZ Euler angles in degrees as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def euler_matrix(rot: Column, tilt: Column, psi: Column) -> list[list[Column]]:
    """Rows of the rotation matrix of the three angles."""
    ca, sa, cb, sb, cg, sg = (f(F.radians(a)) for a in (rot, tilt, psi) for f in (F.cos, F.sin))
    return [
        [cg * cb * ca - sg * sa, cg * cb * sa + sg * ca, -cg * sb],
        [-sg * cb * ca - cg * sa, -sg * cb * sa + cg * ca, sg * sb],
        [sb * ca, sb * sa, cb],
    ]


def direction(rot: Column, tilt: Column) -> list[Column]:
    return [F.sin(F.radians(tilt)) * F.cos(F.radians(rot)), F.sin(F.radians(tilt)) * F.sin(F.radians(rot)), F.cos(F.radians(tilt))]


def direction_angles(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """(rot, tilt) of a direction; tilt within 0..180."""
    return F.degrees(F.atan2(y, x)), F.degrees(F.atan2(F.sqrt(x * x + y * y), z))


def wrapped(a: Column) -> Column:
    """The angle within [-180, 180)."""
    return F.pmod(a + 180.0, F.lit(360.0)) - 180.0


def angular_distance(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """Mean of the angles between the three axes of two orientations, in degrees."""
    p, q = euler_matrix(*a), euler_matrix(*b)
    each = [F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sum((x * y for x, y in zip(r, s, strict=True)), F.lit(0.0)))))) for r, s in zip(p, q, strict=True)]
    return (each[0] + each[1] + each[2]) / 3


def flipped(rot: Column, tilt: Column, psi: Column) -> tuple[Column, Column, Column]:
    """The other set of angles of the same orientation."""
    return rot + 180.0, -tilt, psi - 180.0


def matrix_angles(m: list[list[Column]]) -> tuple[Column, Column, Column]:
    """(rot, tilt, psi) in degrees of a rotation matrix; where the tilt is 0 or 180 the turn is all in psi."""
    s = F.sqrt(m[0][2] * m[0][2] + m[1][2] * m[1][2])
    flat = s < 1e-8
    tilt = F.degrees(F.atan2(s, m[2][2]))
    rot = F.when(flat, 0.0).otherwise(F.degrees(F.atan2(m[2][1], m[2][0])))
    psi = F.when(flat & (m[2][2] > 0), F.degrees(F.atan2(-m[1][0], m[0][0]))).when(flat, F.degrees(F.atan2(m[1][0], -m[0][0]))).otherwise(F.degrees(F.atan2(m[1][2], -m[0][2])))
    return rot, tilt, psi


def mirrored(rot: Column, tilt: Column, psi: Column, axis: str) -> tuple[Column, Column, Column]:
    """Angles of the image mirrored in x, in y, or in both."""
    return {"x": (rot, tilt + 180.0, -psi), "y": (rot, tilt + 180.0, 180.0 - psi), "xy": (rot, tilt, psi + 180.0)}[axis]


def applied(left: list[list[float]], m: list[list[Column]], right: list[list[float]]) -> list[list[Column]]:
    """left * m * right for constant matrices beside one of columns."""

    def product(a, b):
        return [[sum((a[i][k] * b[k][j] for k in range(1, 3)), a[i][0] * b[0][j]) for j in range(3)] for i in range(3)]

    return product(product([[F.lit(float(x)) for x in r] for r in left], m), [[F.lit(float(x)) for x in r] for r in right])
