"""Optimizer fence for expensive derived columns.

Catalyst pushes a filter below projections by substituting each alias with
its defining expression.  When that expression is costly (JSON parsing, a
neural network) and is referenced many times, the pushed-down predicate
re-evaluates it per reference - or, for a DAG of shared sub-expressions,
grows exponentially.  Re-emitting the columns through a one-element
``inline`` generator stops the substitution: generator outputs cannot be
inlined below the generator.  The generator is codegen'd and costs one
struct per row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fence(df: DataFrame, cols: list[str]) -> DataFrame:
    others = [c for c in df.columns if c not in cols]
    return df.select(*others, F.inline(F.array(F.struct(*[F.col(c) for c in cols]))))
