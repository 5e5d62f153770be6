"""Column expressions over dense vectors stored as ``array<float|double>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def as_double(v) -> Column:
    return F.transform(_c(v), lambda x: x.cast("double"))


def dot(a, b) -> Column:
    prods = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda t, v: t + v)


def sq_norm(a) -> Column:
    return dot(a, a)


def l2_normalize(a) -> Column:
    """The norm is a one-element array's element, so it is computed once per
    vector and not for each of its elements."""
    norm = F.array(F.sqrt(sq_norm(a)))
    return F.transform(norm, lambda n: F.transform(_c(a), lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n)))[0]


def cosine(a, b) -> Column:
    return dot(a, b) / (F.sqrt(sq_norm(a)) * F.sqrt(sq_norm(b)))


def sq_distance(a, b) -> Column:
    d = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(d, F.lit(0.0).cast("double"), lambda t, v: t + v * v)
