"""Text helpers for reasons and prompts (JVM expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_fixed(x, digits: int) -> Column:
    """Fixed-point text of a non-negative number, half-up on the scaled double.

    Built from integers (floor(x*10^d + 0.5)) so the text does not depend on a
    formatter's tie rule; NULL in -> NULL out.
    """
    x = _c(x)
    p = 10 ** digits
    n = F.floor(x * float(p) + 0.5)
    if digits == 0:
        return n.cast("string")
    whole = F.floor(n / p).cast("bigint").cast("string")
    frac = F.lpad((n % p).cast("bigint").cast("string"), digits, "0")
    return F.concat(whole, F.lit("."), frac)
