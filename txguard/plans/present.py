"""Canonical result projection shared by Spark results and oracle SQL.

A spec lists output columns with a kind: ``d`` double, snapped to a 1e-4 grid
by floor(x*1e4 + OFFSET)/1e4 with the same IEEE steps in both engines (-0.0
removed).  OFFSET is not 0.5: windowed means of cent amounts are fractions
j/(100n) whose scaled value sits exactly on .5 boundaries, where one ulp of
summation-order noise would flip the result; 0.4567891 keeps every fraction
with denominator <= 50 at least 2.7e-4 away from a boundary.
``i`` bigint, ``s`` string, ``t`` timestamp rendered as text, ``b`` boolean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 10000.0
OFFSET = 0.4567891


def parse_spec(spec: str) -> list[tuple[str, str]]:
    out = []
    for item in spec.split(","):
        item = item.strip()
        if not item:
            continue
        name, kind = item.rsplit(":", 1)
        out.append((name.strip(), kind.strip()))
    return out


def _spark_col(name: str, kind: str) -> Column:
    c = F.col(f"`{name}`")
    if kind == "d":
        c = c.cast("double")
        return (F.when(F.isnan(c), c).otherwise(F.floor(c * SCALE + OFFSET) / SCALE) + 0.0).alias(name)
    if kind == "i":
        return c.cast("bigint").alias(name)
    if kind == "s":
        return c.cast("string").alias(name)
    if kind == "t":
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name)
    if kind == "b":
        return c.cast("boolean").alias(name)
    raise ValueError(kind)


def present(df: DataFrame, spec: str) -> DataFrame:
    return df.select(*[_spark_col(n, k) for n, k in parse_spec(spec)])


def _sql_col(name: str, kind: str) -> str:
    q = f'"{name}"'
    if kind == "d":
        return f"(floor(CAST({q} AS DOUBLE) * {SCALE} + {OFFSET}) / {SCALE} + 0.0) AS {q}"
    if kind == "i":
        return f"CAST({q} AS BIGINT) AS {q}"
    if kind == "s":
        return f"CAST({q} AS VARCHAR) AS {q}"
    if kind == "t":
        return f"strftime({q}, '%Y-%m-%d %H:%M:%S.%f') AS {q}"
    if kind == "b":
        return f"CAST({q} AS BOOLEAN) AS {q}"
    raise ValueError(kind)


def sql_wrap(body: str, spec: str, ctes: str = "") -> str:
    cols = ", ".join(_sql_col(n, k) for n, k in parse_spec(spec))
    return f"{ctes}SELECT {cols} FROM (\n{body}\n) AS q"
