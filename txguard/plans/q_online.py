"""Online-path queries (W9-W11, X2-X5, features_online) over the transaction fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from txguard.functions.arrays import array_median, array_mean, array_stddev
from txguard.operators import online as on
from txguard.plans.registry import register
from txguard.plans.sqlfrag import TWO_PI, feature_spec, flag, hav_atan2, rows, win
from txguard.sources import fixtures
from txguard.sources.tables import read_table


def tx(spark, sf):
    return fixtures.transactions(fixtures.card_tx(read_table(spark, sf, "events")))


def uw(frame=""):
    return win(part="userId", order="timestamp, _id", frame=frame)


KEYS = "_id:s, userId:s"

ONLINE_SQL = f"""
SELECT *, 0.1e0 AS ratio_zscore, ln(ratio_to_median_purchase_price + 1) AS ratio_log,
       ratio_to_median_purchase_price * ratio_to_median_purchase_price AS ratio_squared,
       sqrt(ratio_to_median_purchase_price) AS ratio_sqrt, 0.1e0 AS distance_ratio,
       distance_from_home + distance_from_last_transaction AS distance_sum,
       {flag("used_chip = 1 AND used_pin_number = 1")} AS chip_and_pin,
       {flag("online_order = 1 AND repeat_retailer = 1")} AS online_and_repeat,
       {flag("ratio_to_median_purchase_price > 5")} AS high_ratio_flag,
       {flag("distance_from_last_transaction > 1000")} AS high_distance_flag,
       sin(hour(timestamp) * ({TWO_PI} / 24)) AS time_of_day_sin,
       cos(hour(timestamp) * ({TWO_PI} / 24)) AS time_of_day_cos,
       sin(dayofweek(timestamp) * ({TWO_PI} / 7)) AS day_of_week_sin,
       cos(dayofweek(timestamp) * ({TWO_PI} / 7)) AS day_of_week_cos,
       ln(amount + 1) AS amt_log,
       {flag("dayofweek(timestamp) IN (0, 6)")} AS is_weekend,
       (amount - rolling_ratio_mean_10) / (rolling_ratio_std_10 + 1e-6) AS amt_zscore_10,
       (amount - rolling_ratio_mean_50) / (rolling_ratio_std_50 + 1e-6) AS amt_zscore_50
FROM (
  SELECT *, CASE WHEN r > 100 THEN 100.0e0 ELSE r END AS ratio_to_median_purchase_price
  FROM (
    SELECT *, CASE WHEN median_purchase_price > 0 THEN amount / median_purchase_price
                   WHEN amount > 0 THEN amount ELSE 1.0e0 END AS r
    FROM (
      SELECT *,
        CASE WHEN lag(lat) {uw()} IS NULL AND row_number() {uw()} = 1 THEN 0.0e0
             ELSE {hav_atan2("lat", "lon", f"lag(lat) {uw()}", f"lag(lon) {uw()}")} END
          AS distance_from_last_transaction,
        median(amount) {uw(rows(50))} AS median_purchase_price,
        avg(amount) {uw(rows(9))} AS rolling_ratio_mean_10,
        coalesce(stddev_samp(amount) {uw(rows(9))}, 0.0e0) AS rolling_ratio_std_10,
        avg(amount) {uw(rows(49))} AS rolling_ratio_mean_50,
        coalesce(stddev_samp(amount) {uw(rows(49))}, 0.0e0) AS rolling_ratio_std_50
      FROM transactions
    ) o0
  ) o1
) o2
"""


@register("online_distance_last", KEYS + ", distance_from_last_transaction:d", ONLINE_SQL)
def q_online_dist(spark, sf):
    return on.online_distance_last(tx(spark, sf))


@register("online_median", KEYS + ", amount:d, median_purchase_price:d", ONLINE_SQL)
def q_online_median(spark, sf):
    return on.online_median(tx(spark, sf))


@register("online_rolling", KEYS + ", rolling_ratio_mean_10:d, rolling_ratio_std_10:d, "
          "rolling_ratio_mean_50:d, rolling_ratio_std_50:d", ONLINE_SQL)
def q_online_rolling(spark, sf):
    return on.online_rolling(tx(spark, sf))


@register("features_online", feature_spec(KEYS), ONLINE_SQL)
def q_features_online(spark, sf):
    return on.online_features(tx(spark, sf))


@register("array_median", KEYS + ", n:i, med:d",
          f"SELECT _id, userId, count(*) {uw(rows(9))} AS n, median(amount) {uw(rows(9))} AS med "
          "FROM transactions")
def q_array_median(spark, sf):
    d = on.recent_amounts(tx(spark, sf), 10)
    return d.select("_id", "userId", F.size("history").alias("n"), array_median("history").alias("med"))


@register("array_stddev", KEYS + ", mean:d, std:d",
          f"SELECT _id, userId, avg(amount) {uw(rows(9))} AS mean, "
          f"coalesce(stddev_samp(amount) {uw(rows(9))}, 0.0e0) AS std FROM transactions")
def q_array_std(spark, sf):
    d = on.recent_amounts(tx(spark, sf), 10)
    return d.select("_id", "userId", array_mean("history").alias("mean"), array_stddev("history").alias("std"))


# The hot-user path on the real tables (users above 40 rows, blocks of 64 rows).
@register("features_online_blocked", feature_spec(KEYS), ONLINE_SQL)
def q_features_online_blocked(spark, sf):
    return on.online_features(tx(spark, sf), hot_rows=40, block_rows=64)
