"""Column functions on dense vectors (arrays of numbers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product, accumulated in double."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """Unit-length vector of doubles; a zero vector stays as it is.

    The norm is zipped in as an array, so it is worked out once per row and
    not once per element.
    """
    norms = F.array_repeat(l2_norm(v), F.size(v))
    return F.zip_with(v, norms, lambda x, n: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))
