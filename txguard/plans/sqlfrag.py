"""Reusable DuckDB SQL fragments for oracle text."""

from __future__ import annotations

import math

from txguard.schemas import FEATURE_COLS

TWO_PI = repr(2.0 * math.pi)


def hav_a(lat1, lon1, lat2, lon2):
    return (f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) "
            f"* pow(sin(radians({lon2} - {lon1}) / 2), 2))")


def hav_asin(lat1, lon1, lat2, lon2):
    return f"(2.0e0 * 6371 * asin(sqrt(least(1.0e0, {hav_a(lat1, lon1, lat2, lon2)}))))"


def hav_atan2(lat1, lon1, lat2, lon2):
    a = hav_a(lat1, lon1, lat2, lon2)
    return f"(6371.0e0 * 2 * atan2(sqrt({a}), sqrt(1.0e0 - {a})))"


def win(part="cc_num", order="trans_date_trans_time, event_id", frame=""):
    return f"OVER (PARTITION BY {part} ORDER BY {order} {frame})"


def rows(n):
    return f"ROWS BETWEEN {n} PRECEDING AND CURRENT ROW"


UNB = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def flag(cond):
    return f"(CASE WHEN {cond} THEN 1.0e0 ELSE 0.0e0 END)"


def feature_spec(keys: str) -> str:
    return keys + ", " + ", ".join(f"{c}:d" for c in FEATURE_COLS)


# Batch features on card_tx, SQL form (independent re-statement of the rules).
def features_batch_sql(src: str = "card_tx") -> str:
    return FEATURES_BATCH.replace("FROM card_tx WHERE cc_num IS NOT NULL", f"FROM {src} cx WHERE cc_num IS NOT NULL")


FEATURES_BATCH = f"""
SELECT *, 0.1e0 AS ratio_zscore, ln(ratio_to_median_purchase_price + 1) AS ratio_log,
       ratio_to_median_purchase_price * ratio_to_median_purchase_price AS ratio_squared,
       sqrt(ratio_to_median_purchase_price) AS ratio_sqrt, 0.1e0 AS distance_ratio,
       distance_from_home + distance_from_last_transaction AS distance_sum,
       {flag("used_chip = 1 AND used_pin_number = 1")} AS chip_and_pin,
       {flag("online_order = 1 AND repeat_retailer = 1")} AS online_and_repeat,
       {flag("ratio_to_median_purchase_price > 5")} AS high_ratio_flag,
       {flag("distance_from_last_transaction > 1000")} AS high_distance_flag,
       sin(hour(trans_date_trans_time) * ({TWO_PI} / 24)) AS time_of_day_sin,
       cos(hour(trans_date_trans_time) * ({TWO_PI} / 24)) AS time_of_day_cos,
       sin((isodow(trans_date_trans_time) - 1) * ({TWO_PI} / 7)) AS day_of_week_sin,
       cos((isodow(trans_date_trans_time) - 1) * ({TWO_PI} / 7)) AS day_of_week_cos,
       ln(amt + 1) AS amt_log,
       {flag("isodow(trans_date_trans_time) - 1 >= 5")} AS is_weekend,
       (amt - rolling_ratio_mean_10) / (rolling_ratio_std_10 + 1e-6) AS amt_zscore_10,
       (amt - rolling_ratio_mean_50) / (rolling_ratio_std_50 + 1e-6) AS amt_zscore_50
FROM (
  SELECT *, CASE WHEN r > 100 THEN 100.0e0 ELSE r END AS ratio_to_median_purchase_price
  FROM (
    SELECT *, CASE WHEN median_purchase_price > 0 THEN amt / median_purchase_price ELSE amt END AS r
    FROM (
      SELECT *,
        {hav_asin("lat", "long", "merch_lat", "merch_long")} AS distance_from_home,
        lag(merch_lat) {win()} AS prev_merch_lat,
        lag(merch_long) {win()} AS prev_merch_long,
        coalesce({hav_asin("merch_lat", "merch_long",
                           f"lag(merch_lat) {win()}", f"lag(merch_long) {win()}")}, 0.0e0)
          AS distance_from_last_transaction,
        median(amt) {win(frame=UNB)} AS median_purchase_price,
        avg(amt) {win(frame=rows(9))} AS rolling_ratio_mean_10,
        coalesce(stddev_samp(amt) {win(frame=rows(9))}, 0.0e0) AS rolling_ratio_std_10,
        avg(amt) {win(frame=rows(49))} AS rolling_ratio_mean_50,
        coalesce(stddev_samp(amt) {win(frame=rows(49))}, 0.0e0) AS rolling_ratio_std_50,
        {flag(f"merchant IS NOT NULL AND row_number() {win(part='cc_num, merchant')} > 1")} AS repeat_retailer,
        {flag("coalesce(regexp_matches(merchant, 'chip', 'i'), false)")} AS used_chip,
        {flag("coalesce(regexp_matches(category, 'pos', 'i'), false)")} AS used_pin_number,
        {flag("coalesce(regexp_matches(category, 'net|online', 'i'), false)")} AS online_order
      FROM card_tx WHERE cc_num IS NOT NULL
    ) b0
  ) b1
) b2
"""
