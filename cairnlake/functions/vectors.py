"""Vector expressions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return F.transform(v, lambda e: e.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, e: s + e)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, e: s + e * e))


def unit(a: Column, dims: int | None = None) -> Column:
    """The first ``dims`` numbers, scaled to length one; the zero vector stays."""
    v = as_double(F.slice(a, 1, dims) if dims else a)
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda e: e / n)).otherwise(v)


def usable(v: Column, dims: int) -> Column:
    """``dims`` finite numbers, not all zero."""
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return F.coalesce((F.size(v) == dims) & finite & F.exists(v, lambda e: e != 0), F.lit(False))
