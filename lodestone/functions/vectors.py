"""Vector arithmetic as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def checked_query(vector: Sequence[float]) -> Column:
    """A query vector as a literal; it must be finite and have a norm."""
    if not vector or not all(map(math.isfinite, vector)) or not any(vector):
        raise ValueError("invalid query vector")
    return F.array(*[F.lit(float(x)) for x in vector])
