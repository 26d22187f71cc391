"""Pipeline counters and latency histogram (one aggregation pass each)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txguard.schemas import LATENCY_BUCKETS


def scored_counts(duration: Column | None = None, buckets=LATENCY_BUCKETS) -> list[Column]:
    """Aggregates over scored rows: processed, flagged, model_errors; with a duration its cumulative buckets and sum."""
    out = [F.count(F.lit(1)).alias("processed"), F.count(F.when(F.col("status") == "FLAGGED", 1)).alias("flagged"),
           F.count(F.when(F.col("model_failed"), 1)).alias("model_errors")]
    return out if duration is None else out + bucket_counts(duration, buckets)


def bucket_counts(duration: Column, buckets=LATENCY_BUCKETS) -> list[Column]:
    return [*[F.count(F.when(duration <= F.lit(float(b)), 1)).alias(f"c{i}") for i, b in enumerate(buckets)],
            F.count(F.lit(1)).alias("cinf"), F.coalesce(F.sum(duration), F.lit(0.0)).alias("total_sum")]


def histogram_rows(counts: DataFrame, buckets=LATENCY_BUCKETS) -> DataFrame:
    """One row of bucket counts -> rows ``le`` (upper bound, '+Inf' last), ``cnt``, with the sum and count."""
    rows = [F.struct(F.lit(str(b)).alias("le"), F.col(f"c{i}").alias("cnt")) for i, b in enumerate(buckets)]
    rows.append(F.struct(F.lit("+Inf").alias("le"), F.col("cinf").alias("cnt")))
    return counts.select(F.inline(F.array(*rows)), "total_sum", F.col("cinf").alias("total_count"))


def pipeline_counters(scored: DataFrame, dead: DataFrame) -> DataFrame:
    """processed, flagged, model_errors from scored rows; dlq from dead letters."""
    d = dead.agg(F.count(F.lit(1)).alias("dlq"))
    return scored.agg(*scored_counts()).crossJoin(d).select("processed", "flagged", "dlq", "model_errors")


def latency_histogram(df: DataFrame, duration: str = "duration", buckets=LATENCY_BUCKETS) -> DataFrame:
    """Cumulative bucket counts (le = upper bound, '+Inf' last) plus sum and count."""
    return histogram_rows(df.agg(*bucket_counts(F.col(duration), buckets)), buckets)
