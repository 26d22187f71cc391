"""Batch feature engineering: 29 model features from per-card history.

One hash exchange on the card key serves every per-card window: the card
window (lag, expanding median, rolling 10/50) and the (card, merchant)
window for repeat retailers are both satisfied by ``hashpartitioning(card)``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txguard.functions.geo import haversine_km
from txguard.plans import sequence as sq
from txguard.plans.expanding import expanding_median_hot, expanding_median_light
from txguard.schemas import (FEATURE_COLS, HIGH_DISTANCE_KM, HIGH_RATIO, PLACEHOLDER_FEATURE,
                             RATIO_CAP, ZSCORE_EPS)

CARD, TIME, MERCHANT, CATEGORY, AMT = "cc_num", "trans_date_trans_time", "merchant", "category", "amt"
TWO_PI = 2.0 * math.pi


def card_window(card: str = CARD, time: str = TIME, order_id: str = "event_id"):
    return Window.partitionBy(card).orderBy(time, order_id)


def cap_ratio(r: Column) -> Column:
    """Clip above RATIO_CAP; NaN/NULL pass through (Spark orders NaN above all numbers)."""
    return F.when((r > RATIO_CAP) & ~F.isnan(r), F.lit(RATIO_CAP)).otherwise(r)


def flag(c: Column) -> Column:
    return F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))


def distance_from_home(df: DataFrame) -> DataFrame:
    return df.withColumn("distance_from_home", haversine_km("lat", "long", "merch_lat", "merch_long"))


def _card_window_columns(df: DataFrame, cols: tuple[str, ...], lookback: int, order_id: str) -> DataFrame:
    """Some of the bounded card columns; cards too large for one task are cut into blocks."""
    def build(w):
        every = bounded_card_columns(order_id)(w)
        return {c: every[c] for c in cols}
    return sq.sequence_window(df, CARD, [TIME, order_id], build, lookback)


def prev_location(df: DataFrame, order_id: str = "event_id") -> DataFrame:
    return _card_window_columns(df, ("prev_merch_lat", "prev_merch_long"), 1, order_id)


def distance_from_last(df: DataFrame, order_id: str = "event_id") -> DataFrame:
    if "prev_merch_lat" not in df.columns:
        df = prev_location(df, order_id)
    d = haversine_km("merch_lat", "merch_long", "prev_merch_lat", "prev_merch_long")
    return df.withColumn("distance_from_last_transaction", F.coalesce(F.nanvl(d, F.lit(0.0)), F.lit(0.0)))


def expanding_median(df: DataFrame, order_id: str = "event_id", hot_rows: int | None = None,
                     block_rows: int | None = None) -> DataFrame:
    """Median of the card's amounts so far, current row included (exact); missing amounts are skipped."""
    light, hot = sq.split_hot(df, CARD, hot_rows or sq.HOT_ROWS)
    out = expanding_median_light(light.repartition(CARD), CARD, [TIME, order_id], AMT, "median_purchase_price")
    if hot is None:
        return out
    counted = sq.positions(hot, CARD, [TIME, order_id], counted=_known_amount())
    return out.unionByName(_with_hot_median(counted, counted, block_rows or sq.BLOCK_ROWS).drop("_g"))


def _known_amount() -> Column:
    return F.col(AMT).isNotNull() & ~F.isnan(AMT)


def _with_hot_median(df: DataFrame, counted: DataFrame, block_rows: int) -> DataFrame:
    med = expanding_median_hot(counted, CARD, AMT, block_rows)
    return (df.join(med.withColumnRenamed("_c", "_mc"),
                    F.col(CARD).eqNullSafe(F.col("_k")) & (F.col("_c") == F.col("_mc")), "left")
            .withColumnRenamed("_med", "median_purchase_price").drop("_k", "_c", "_mc"))


def ratio_features(df: DataFrame) -> DataFrame:
    m = F.col("median_purchase_price")
    r = cap_ratio(F.when(m > 0, F.col(AMT) / m).otherwise(F.col(AMT)))
    df = df.withColumn("ratio_to_median_purchase_price", r)
    r = F.col("ratio_to_median_purchase_price")
    return df.withColumns({
        "ratio_log": F.log(r + 1.0),
        "ratio_squared": r * r,
        "ratio_sqrt": F.sqrt(r),
    })


def repeat_retailer(df: DataFrame, order_id: str = "event_id") -> DataFrame:
    """1.0 from the card's second purchase at a merchant on; 0.0 without a merchant.

    The first purchase is a partially aggregated min joined back, so no
    (card, merchant) pair is one window in one task.
    """
    here = F.struct(F.col(TIME).alias("t"), F.col(order_id).alias("i"))
    first = df.groupBy(CARD, MERCHANT).agg(F.min(here).alias("_first"))
    return (df.join(first, [CARD, MERCHANT], "left")
            .withColumn("repeat_retailer", flag(here > F.col("_first"))).drop("_first"))


def _flag_columns() -> dict[str, Column]:
    def has(c: str, pattern: str) -> Column:
        return flag(F.coalesce(F.col(c).rlike(pattern), F.lit(False)))
    return {"used_chip": has(MERCHANT, "(?i)chip"), "used_pin_number": has(CATEGORY, "(?i)pos"),
            "online_order": has(CATEGORY, "(?i)net|online")}


def flag_features(df: DataFrame) -> DataFrame:
    return df.withColumns(_flag_columns())


def rolling_features(df: DataFrame, sizes=(10, 50), order_id: str = "event_id") -> DataFrame:
    cols = tuple(f"rolling_ratio_{k}_{n}" for n in sizes for k in ("mean", "std"))
    return _card_window_columns(df, cols, max(sizes) - 1, order_id)


def _temporal_columns(time: str = TIME, amount: str = AMT) -> dict[str, Column]:
    hour, dow = F.hour(time), F.weekday(time)
    return {
        "time_of_day_sin": F.sin(hour * (TWO_PI / 24)),
        "time_of_day_cos": F.cos(hour * (TWO_PI / 24)),
        "day_of_week_sin": F.sin(dow * (TWO_PI / 7)),
        "day_of_week_cos": F.cos(dow * (TWO_PI / 7)),
        "amt_log": F.log(F.col(amount) + 1.0),
        "is_weekend": flag(dow >= 5),
    }


def temporal_features(df: DataFrame, time: str = TIME, amount: str = AMT) -> DataFrame:
    """Hour/day cycles; batch day-of-week is Monday = 0 (``weekday``)."""
    return df.withColumns(_temporal_columns(time, amount))


def _interaction_columns() -> dict[str, Column]:
    dlast = F.col("distance_from_last_transaction")
    return {
        "ratio_zscore": F.lit(PLACEHOLDER_FEATURE),
        "distance_ratio": F.lit(PLACEHOLDER_FEATURE),
        "distance_sum": F.col("distance_from_home") + dlast,
        "chip_and_pin": flag((F.col("used_chip") == 1) & (F.col("used_pin_number") == 1)),
        "online_and_repeat": flag((F.col("online_order") == 1) & (F.col("repeat_retailer") == 1)),
        "high_ratio_flag": flag(F.col("ratio_to_median_purchase_price") > HIGH_RATIO),
        "high_distance_flag": flag(dlast > HIGH_DISTANCE_KM),
    }


def _zscore_columns() -> dict[str, Column]:
    return {
        f"amt_zscore_{n}": (F.col(AMT) - F.col(f"rolling_ratio_mean_{n}"))
        / (F.col(f"rolling_ratio_std_{n}") + ZSCORE_EPS)
        for n in (10, 50)
    }


def zscore_features(df: DataFrame) -> DataFrame:
    return df.withColumns(_zscore_columns())


def bounded_card_columns(order_id: str = "event_id"):
    """lag and rolling 10/50 columns: at most 49 rows back."""
    def build(w):
        cols = {"prev_merch_lat": F.lag("merch_lat", 1).over(w),
                "prev_merch_long": F.lag("merch_long", 1).over(w)}
        for n in (10, 50):
            f = w.rowsBetween(-(n - 1), Window.currentRow)
            cols[f"rolling_ratio_mean_{n}"] = F.avg(AMT).over(f)
            cols[f"rolling_ratio_std_{n}"] = F.coalesce(F.stddev_samp(AMT).over(f), F.lit(0.0))
        return cols
    return build


def _features_plain(df: DataFrame, order_id: str) -> DataFrame:
    # one exchange for the window specs (card) and (card, merchant) and the median
    df = df.repartition(CARD)
    w = card_window(order_id=order_id)
    df = df.withColumns(bounded_card_columns(order_id)(w))
    again = F.row_number().over(Window.partitionBy(CARD, MERCHANT).orderBy(TIME, order_id)) > 1
    df = df.withColumn("repeat_retailer", flag(again & F.col(MERCHANT).isNotNull()))
    df = expanding_median_light(df, CARD, [TIME, order_id], AMT, "median_purchase_price")
    df = distance_from_home(df)
    df = distance_from_last(df, order_id)
    return ratio_features(df)


def _features_hot(hot: DataFrame, order_id: str, block_rows: int) -> DataFrame:
    """Per-card features for cards too large for one task (see plans.sequence/expanding)."""
    counted = sq.positions(hot, CARD, [TIME, order_id], counted=_known_amount())
    hb = sq.blocked(counted, 49, block_rows)
    w = Window.partitionBy(CARD, "_blk").orderBy("_g")
    df = (hb.withColumns(bounded_card_columns(order_id)(w))
            .filter(F.col("_own") == F.col("_blk")).drop("_own", "_blk", "_g"))
    df = _with_hot_median(df, counted, block_rows)
    df = repeat_retailer(df, order_id)
    df = distance_from_home(df)
    df = distance_from_last(df, order_id)
    return ratio_features(df)


def row_features(df: DataFrame) -> DataFrame:
    """Flags, interactions, cycles and z-scores: row-local, two projections."""
    return df.withColumns(_flag_columns()).withColumns(
        {**_interaction_columns(), **_temporal_columns(), **_zscore_columns()})


def engineer_features(df: DataFrame, order_id: str = "event_id",
                      skew_safe: bool = True, hot_rows: int | None = None,
                      block_rows: int | None = None) -> DataFrame:
    """All 29 features on raw card transactions.

    Expects cc_num, trans_date_trans_time, amt, lat, long, merch_lat,
    merch_long, merchant, category (+ optional is_fraud) and a unique
    ``order_id`` used as the tie-breaker after time.  Rows without a card are
    dropped, as the grouping in the reference drops them.

    ``skew_safe``: cards above ``hot_rows`` rows are computed in blocks of
    ``block_rows`` (exact; plans.sequence and plans.expanding) so no card is
    ever processed by a single task; other cards use plain per-card windows.
    """
    df = df.filter(F.col(CARD).isNotNull())
    if skew_safe:
        light, hot = sq.split_hot(df, CARD, hot_rows or sq.HOT_ROWS)
    else:
        light, hot = df, None
    out = _features_plain(light, order_id)
    if hot is not None:
        out = out.unionByName(_features_hot(hot, order_id, block_rows or sq.BLOCK_ROWS),
                              allowMissingColumns=True)
    return row_features(out)


def feature_vector(df: DataFrame, name: str = "features") -> DataFrame:
    """Ordered array<double> of the 29 model inputs."""
    return df.withColumn(name, F.array(*[F.col(c).cast("double") for c in FEATURE_COLS]))
