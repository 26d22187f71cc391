"""Online (consumer-side) features, replayed over a transaction table.

The stream keeps, per user, the newest HISTORY_CAP {amount, lat, lon}
records.  Over a table the same values come from bounded row frames on a
per-user window ordered by (event time, id):

* median of current + up to 50 previous amounts  -> rows(-50, 0)
* rolling mean/std of current + 9 / + 49 previous -> rows(-9, 0), rows(-49, 0)
* distance to the previous transaction point      -> lag(lat/lon)

All frames are bounded, so the Window operator streams each user's rows
with a fixed-size buffer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txguard.functions.geo import haversine_km_atan2
from txguard.operators.features import TWO_PI, cap_ratio, flag
from txguard.plans import sequence as sq
from txguard.schemas import (HIGH_DISTANCE_KM, HIGH_RATIO, HISTORY_CAP, PLACEHOLDER_FEATURE,
                             ZSCORE_EPS)

USER, TS, ID = "userId", "timestamp", "_id"


def user_window(user: str = USER, ts: str = TS, order_id: str = ID):
    return Window.partitionBy(user).orderBy(ts, order_id)


def _history_window(df: DataFrame, names: tuple[str, ...], history: int, hot_rows: int | None = None,
                    block_rows: int | None = None) -> DataFrame:
    """Some of the history columns; users too large for one task are cut into blocks."""
    def build(w):
        every = online_history_columns(history)(w)
        return {c: every[c] for c in names}
    return sq.sequence_window(df, USER, [TS, ID], build, max(history, 49), hot_rows or sq.HOT_ROWS,
                              block_rows or sq.BLOCK_ROWS)


def _distance_last(df: DataFrame) -> DataFrame:
    d = haversine_km_atan2("lat", "lon", "_prev_lat", "_prev_lon")
    return (df.withColumn("distance_from_last_transaction", F.when(F.col("_has_prev"), d).otherwise(F.lit(0.0)))
            .drop("_prev_lat", "_prev_lon", "_has_prev"))


def online_distance_last(df: DataFrame, history: int = HISTORY_CAP) -> DataFrame:
    return _distance_last(_history_window(df, ("_prev_lat", "_prev_lon", "_has_prev"), history))


def online_median(df: DataFrame, history: int = HISTORY_CAP) -> DataFrame:
    return _history_window(df, ("median_purchase_price",), history)


def online_rolling(df: DataFrame, sizes=(10, 50)) -> DataFrame:
    return _history_window(df, tuple(f"rolling_ratio_{k}_{n}" for n in sizes for k in ("mean", "std")), HISTORY_CAP)


def online_ratio(df: DataFrame) -> DataFrame:
    m, a = F.col("median_purchase_price"), F.col("amount")
    r = cap_ratio(F.when(m > 0, a / m).when(a > 0, a).otherwise(F.lit(1.0)))
    return df.withColumn("ratio_to_median_purchase_price", r)


def online_scalar_features(df: DataFrame) -> DataFrame:
    """Everything that needs only the row plus its history statistics.

    Day of week is Sunday = 0 here (the batch path uses Monday = 0).
    """
    r = F.col("ratio_to_median_purchase_price")
    hour = F.hour(TS)
    dow = F.dayofweek(TS) - 1
    dlast = F.col("distance_from_last_transaction")
    return df.withColumns({
        "ratio_zscore": F.lit(PLACEHOLDER_FEATURE),
        "ratio_log": F.log(r + 1.0),
        "ratio_squared": r * r,
        "ratio_sqrt": F.sqrt(r),
        "distance_ratio": F.lit(PLACEHOLDER_FEATURE),
        "distance_sum": F.col("distance_from_home") + dlast,
        "chip_and_pin": flag((F.col("used_chip") == 1) & (F.col("used_pin_number") == 1)),
        "online_and_repeat": flag((F.col("online_order") == 1) & (F.col("repeat_retailer") == 1)),
        "high_ratio_flag": flag(r > HIGH_RATIO),
        "high_distance_flag": flag(dlast > HIGH_DISTANCE_KM),
        "time_of_day_sin": F.sin(hour * (TWO_PI / 24)),
        "time_of_day_cos": F.cos(hour * (TWO_PI / 24)),
        "day_of_week_sin": F.sin(dow * (TWO_PI / 7)),
        "day_of_week_cos": F.cos(dow * (TWO_PI / 7)),
        "amt_log": F.log(F.col("amount") + 1.0),
        "is_weekend": flag(dow.isin(0, 6)),
        "amt_zscore_10": (F.col("amount") - F.col("rolling_ratio_mean_10"))
        / (F.col("rolling_ratio_std_10") + ZSCORE_EPS),
        "amt_zscore_50": (F.col("amount") - F.col("rolling_ratio_mean_50"))
        / (F.col("rolling_ratio_std_50") + ZSCORE_EPS),
    })


def online_history_columns(history: int = HISTORY_CAP):
    """Window columns of the online path; all look back at most ``history`` rows."""
    def build(w):
        cols = {
            "_prev_lat": F.lag("lat", 1).over(w),
            "_prev_lon": F.lag("lon", 1).over(w),
            "_has_prev": F.lag(F.lit(1), 1).over(w).isNotNull(),
            "median_purchase_price": F.percentile("amount", 0.5).over(w.rowsBetween(-history, Window.currentRow)),
        }
        for n in (10, 50):
            f = w.rowsBetween(-(n - 1), Window.currentRow)
            cols[f"rolling_ratio_mean_{n}"] = F.avg("amount").over(f)
            cols[f"rolling_ratio_std_{n}"] = F.coalesce(F.stddev_samp("amount").over(f), F.lit(0.0))
        return cols
    return build


def online_features(tx: DataFrame, history: int = HISTORY_CAP, hot_rows: int | None = None,
                    block_rows: int | None = None) -> DataFrame:
    """29 online features for every row of a transaction table (replay).

    Missing event times fall back to processing time, as the consumer does.
    All per-user frames are bounded (<= 50 rows back), so users with very
    many rows are split into blocks (plans.sequence) instead of one task.
    """
    tx = tx.withColumn(TS, F.coalesce(F.col(TS), F.current_timestamp().cast(tx.schema[TS].dataType)))
    names = tuple(online_history_columns(history)(user_window()))
    return features_from_history(_history_window(tx, names, history, hot_rows, block_rows))


def features_from_history(df: DataFrame) -> DataFrame:
    """The 29 features of rows that carry their history columns (replay or stream state)."""
    return online_scalar_features(online_ratio(_distance_last(df)))


def recent_amounts(df: DataFrame, n: int, name: str = "history") -> DataFrame:
    """Array of the current and up to n-1 previous amounts of the user, newest first."""
    def build(w):
        return {name: F.reverse(F.collect_list("amount").over(w.rowsBetween(-(n - 1), Window.currentRow)))}
    return sq.sequence_window(df, USER, [TS, ID], build, n - 1)
