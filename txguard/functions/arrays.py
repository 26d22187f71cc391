"""Array statistics with higher-order functions (bounded arrays only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def array_median(arr) -> Column:
    """Median of a numeric array; empty array -> 0, average of middles when even."""
    s = F.array_sort(F.filter(_c(arr), lambda v: v.isNotNull()))
    n = F.size(s)
    mid = F.floor(n / 2).cast("int")
    odd = F.element_at(s, mid + 1)
    even = (F.element_at(s, mid) + F.element_at(s, mid + 1)) / 2
    return (F.when(n == 0, F.lit(0.0))
             .when(n % 2 == 1, odd.cast("double"))
             .otherwise(even.cast("double")))


def array_mean(arr) -> Column:
    a = _c(arr)
    total = F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(a) > 0, total / F.size(a)).otherwise(F.lit(0.0))


def array_stddev(arr, mean=None) -> Column:
    """Sample standard deviation; 0 for fewer than two elements."""
    a = _c(arr)
    m = array_mean(a) if mean is None else _c(mean)
    ss = F.aggregate(a, F.lit(0.0), lambda acc, v: acc + F.pow(v - m, 2))
    return F.when(F.size(a) <= 1, F.lit(0.0)).otherwise(F.sqrt(ss / (F.size(a) - 1)))
