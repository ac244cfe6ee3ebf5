"""Column functions on vectors held as arrays."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorequarry.functions.text import col


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a).cast("array<double>"), col(b).cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """0 if the lengths differ or a vector is empty, null or zero."""
    a, b = col(a), col(b)
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (n > 0), dot(a, b) / n).otherwise(F.lit(0.0))
