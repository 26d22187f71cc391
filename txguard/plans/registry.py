"""Registry of named queries: Spark plan + DuckDB oracle text + output spec."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from txguard.plans import oracle_fixtures
from txguard.plans.present import present, sql_wrap


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    spec: str
    sql: str | None          # DuckDB body over fixture CTEs; None = no SQL oracle
    extra_ctes: list | None = None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return present(self.build(spark, sf_dir), self.spec)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        return sql_wrap(self.sql, self.spec, oracle_fixtures.ctes(self.extra_ctes))


REGISTRY: dict[str, Query] = {}


def register(name: str, spec: str, sql: str | None, extra_ctes=None):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, spec, sql, extra_ctes)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # importing the modules fills REGISTRY
    from txguard.plans import (q_features, q_online, q_api, q_scoring, q_eval,  # noqa: F401
                               q_mutations, q_stream)
    return REGISTRY
