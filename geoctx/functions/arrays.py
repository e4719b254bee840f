"""Array expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with ``value`` computed once.

    An expression named inside a lambda is evaluated for every element; bound through a
    one-element array it is evaluated once per row.
    """
    return F.transform(F.array(value), fn)[0]


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def l2_unit(values: Column, eps: float = 0.0) -> Column:
    """Array scaled to length 1; an all-zero array stays as it is."""
    def scale(v):
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x) + eps)
        return let(F.struct(v.alias("v"), norm.alias("n")),
                   lambda s: F.transform(s["v"], lambda x: F.when(s["n"] > 0, x / s["n"]).otherwise(x)))

    return let(values, scale)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def explode_once(values) -> Column:
    """``explode`` of an array that is costly to compute.

    The optimizer puts a filter on the size of a generator's plain input, pushes it down to the scan and
    so computes the array twice; it leaves the output of a lambda function alone.
    """
    return F.explode(F.transform(values, lambda v: v))
