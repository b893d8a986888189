"""Vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def bound(value: Column, use) -> Column:
    """``use(value)``, with value evaluated once and not copied into the expression wherever it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalize(a: Column) -> Column:
    """The unit vector; a zero vector stays as it is."""

    def unit(v):
        return bound(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))))

    return bound(a, unit)


def cross(a: Column, b: Column) -> Column:
    at = lambda v, i: F.get(v, F.lit(i)).cast("double")
    return F.array(*(at(a, i) * at(b, j) - at(a, j) * at(b, i) for i, j in ((1, 2), (2, 0), (0, 1))))


def camera_basis(direction: Column, up: Column) -> tuple[Column, Column]:
    """Right and true-up unit vectors of a camera; an up vector along the direction is replaced by the y axis."""
    y = F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0))
    right = bound(cross(direction, up), lambda r: normalize(F.when(norm(r) < 1e-12, cross(direction, y)).otherwise(r)))
    return right, bound(right, lambda r: normalize(cross(r, direction)))
