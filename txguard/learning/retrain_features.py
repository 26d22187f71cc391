"""Reduced feature set used when retraining from reviewed (CLEARED) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txguard.operators.features import temporal_features
from txguard.schemas import FEATURE_COLS, MIN_RETRAIN_ROWS


def retrain_source(tx: DataFrame) -> DataFrame:
    return tx.filter(F.col("status") == "CLEARED")


def retrain_features(tx: DataFrame) -> DataFrame:
    """Temporal cycles (Monday = 0), amt_log, is_weekend; z-scores 0; every
    other model column that the table lacks becomes 0.0."""
    df = temporal_features(tx, time="timestamp", amount="amount")
    df = df.withColumns({"amt_zscore_10": F.lit(0.0), "amt_zscore_50": F.lit(0.0)})
    missing = {c: F.lit(0.0) for c in FEATURE_COLS if c not in df.columns}
    return df.withColumns(missing)


def retrain_guard(cleared: DataFrame, min_rows: int = MIN_RETRAIN_ROWS) -> DataFrame:
    """One row: enough rows to retrain?  Reads at most ``min_rows`` rows."""
    n = cleared.limit(min_rows).agg(F.count(F.lit(1)).alias("n_seen"))
    return n.select("n_seen", (F.col("n_seen") >= min_rows).alias("proceed"))
