"""Vector arithmetic as column expressions; elements are widened to double before they are multiplied."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-12


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over a value that is computed once a row, however often body uses it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def l2_normalize(a: Column, eps: float = EPSILON) -> Column:
    """Unit-norm vector; a zero vector stays zero. The norm is bound once, not computed for each element."""
    return bound(F.greatest(norm(a), F.lit(eps)), lambda n: F.transform(a, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 where either vector is zero."""
    return F.coalesce(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


def neg_l2(a: Column, b: Column) -> Column:
    """Negative Euclidean distance: higher is closer."""
    return F.lit(0.0) - F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def fuse(*modalities: Column) -> Column:
    """Concatenation of unit-norm modalities; the result has norm sqrt(number of non-zero modalities)."""
    return F.concat(*[l2_normalize(m) for m in modalities])


METRICS = {"cosine": cosine, "l2": neg_l2, "dot": dot}


def metric(name: str):
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}; one of {sorted(METRICS)}")
    return METRICS[name]
