"""Batch feature queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from txguard.operators import features as feat
from txguard.plans.registry import register
from txguard.plans.sqlfrag import FEATURES_BATCH, feature_spec, features_batch_sql, hav_asin, win, UNB, rows, flag
from txguard.schemas import FEATURE_COLS, RAW_TRANSACTION_SCHEMA
from txguard.session import ensure_checkpoint_dir
from txguard.sources import fixtures
from txguard.sources.tables import normal_rows, read_raw_csv, read_raw_csv_strict, read_table, union_sources


def cards(spark, sf):
    return fixtures.card_tx(read_table(spark, sf, "events"))


KEYS = "event_id:i, cc_num:i"


@register("src_raw_transactions",
          "event_id:i, cc_num:i, trans_date_trans_time:t, amt:d, lat:d, long:d, merch_lat:d, "
          "merch_long:d, merchant:s, category:s, is_fraud:i",
          "SELECT * FROM card_tx")
def q_src(spark, sf):
    return cards(spark, sf)


@register("union_sources", KEYS + ", amt:d, is_fraud:d, part:s",
          "SELECT event_id, cc_num, amt, is_fraud, 'a' AS part FROM card_tx WHERE is_fraud = 0 "
          "UNION ALL SELECT event_id, cc_num, amt, NULL AS is_fraud, 'b' AS part FROM card_tx WHERE is_fraud = 1")
def q_union(spark, sf):
    c = cards(spark, sf)
    a = c.filter("is_fraud = 0").select("event_id", "cc_num", "amt", "is_fraud", F.lit("a").alias("part"))
    # second source lacks the label column entirely
    b = c.filter("is_fraud = 1").select("event_id", "cc_num", "amt", F.lit("b").alias("part"))
    return union_sources(a, b)


@register("filter_normal", KEYS + ", amt:d",
          "SELECT event_id, cc_num, amt FROM card_tx WHERE is_fraud = 0")
def q_normal(spark, sf):
    return normal_rows(cards(spark, sf)).select("event_id", "cc_num", "amt")


@register("feat_distance_home", KEYS + ", distance_from_home:d",
          f"SELECT event_id, cc_num, {hav_asin('lat', 'long', 'merch_lat', 'merch_long')} AS distance_from_home "
          "FROM card_tx")
def q_dist_home(spark, sf):
    return feat.distance_from_home(cards(spark, sf))


@register("feat_prev_location", KEYS + ", prev_merch_lat:d, prev_merch_long:d",
          f"SELECT event_id, cc_num, lag(merch_lat) {win()} AS prev_merch_lat, "
          f"lag(merch_long) {win()} AS prev_merch_long FROM card_tx")
def q_prev_loc(spark, sf):
    return feat.prev_location(cards(spark, sf))


@register("feat_distance_last", KEYS + ", distance_from_last_transaction:d",
          f"SELECT event_id, cc_num, coalesce("
          f"{hav_asin('merch_lat', 'merch_long', f'lag(merch_lat) {win()}', f'lag(merch_long) {win()}')}, 0.0e0)"
          f" AS distance_from_last_transaction FROM card_tx")
def q_dist_last(spark, sf):
    return feat.distance_from_last(cards(spark, sf))


@register("feat_expanding_median", KEYS + ", amt:d, median_purchase_price:d",
          f"SELECT event_id, cc_num, amt, median(amt) {win(frame=UNB)} AS median_purchase_price FROM card_tx")
def q_median(spark, sf):
    return feat.expanding_median(cards(spark, sf))


@register("feat_repeat_retailer", KEYS + ", merchant:s, repeat_retailer:d",
          f"SELECT event_id, cc_num, merchant, {flag(f'merchant IS NOT NULL AND row_number() {win(part='cc_num, merchant')} > 1')}"
          " AS repeat_retailer FROM card_tx")
def q_repeat(spark, sf):
    return feat.repeat_retailer(cards(spark, sf))


@register("feat_rolling_10", KEYS + ", rolling_ratio_mean_10:d, rolling_ratio_std_10:d",
          f"SELECT event_id, cc_num, avg(amt) {win(frame=rows(9))} AS rolling_ratio_mean_10, "
          f"coalesce(stddev_samp(amt) {win(frame=rows(9))}, 0.0e0) AS rolling_ratio_std_10 FROM card_tx")
def q_roll10(spark, sf):
    return feat.rolling_features(cards(spark, sf), sizes=(10,))


@register("feat_rolling_50", KEYS + ", rolling_ratio_mean_50:d, rolling_ratio_std_50:d",
          f"SELECT event_id, cc_num, avg(amt) {win(frame=rows(49))} AS rolling_ratio_mean_50, "
          f"coalesce(stddev_samp(amt) {win(frame=rows(49))}, 0.0e0) AS rolling_ratio_std_50 FROM card_tx")
def q_roll50(spark, sf):
    return feat.rolling_features(cards(spark, sf), sizes=(50,))


_CHIP = flag("coalesce(regexp_matches(merchant, 'chip', 'i'), false)")
_POS = flag("coalesce(regexp_matches(category, 'pos', 'i'), false)")
_NET = flag("coalesce(regexp_matches(category, 'net|online', 'i'), false)")


@register("feat_flags", KEYS + ", used_chip:d, used_pin_number:d, online_order:d",
          f"SELECT event_id, cc_num, {_CHIP} AS used_chip, {_POS} AS used_pin_number, "
          f"{_NET} AS online_order FROM card_tx")
def q_flags(spark, sf):
    return feat.flag_features(cards(spark, sf))


def _batch(spark, sf):
    return feat.engineer_features(cards(spark, sf))


@register("feat_ratio", KEYS + ", ratio_to_median_purchase_price:d, ratio_log:d, ratio_squared:d, ratio_sqrt:d",
          FEATURES_BATCH)
def q_ratio(spark, sf):
    return feat.ratio_features(feat.expanding_median(cards(spark, sf)))


@register("feat_interactions", KEYS + ", distance_sum:d, chip_and_pin:d, online_and_repeat:d, "
          "high_ratio_flag:d, high_distance_flag:d", FEATURES_BATCH)
def q_inter(spark, sf):
    return _batch(spark, sf)


@register("feat_temporal", KEYS + ", time_of_day_sin:d, time_of_day_cos:d, day_of_week_sin:d, "
          "day_of_week_cos:d, amt_log:d, is_weekend:d", FEATURES_BATCH)
def q_temporal(spark, sf):
    return feat.temporal_features(cards(spark, sf))


@register("feat_zscores", KEYS + ", amt_zscore_10:d, amt_zscore_50:d", FEATURES_BATCH)
def q_z(spark, sf):
    return feat.zscore_features(feat.rolling_features(cards(spark, sf)))


@register("features_batch", feature_spec(KEYS + ", is_fraud:i"), FEATURES_BATCH)
def q_features_batch(spark, sf):
    return _batch(spark, sf)


@register("feature_vector", KEYS + ", " + ", ".join(f"f{i}:d" for i in range(len(FEATURE_COLS))),
          "SELECT event_id, cc_num, " + ", ".join(f"{c} AS f{i}" for i, c in enumerate(FEATURE_COLS))
          + f" FROM ({FEATURES_BATCH}) fv")
def q_vector(spark, sf):
    v = feat.feature_vector(_batch(spark, sf))
    return v.select("event_id", "cc_num", *[F.col("features")[i].alias(f"f{i}") for i in range(len(FEATURE_COLS))])


# The hot-card path on the real tables: every card above 40 rows is computed in
# blocks of 60 rows (exact positions, halo windows, blocked expanding median).
# Same oracle as features_batch.
@register("features_batch_blocked", feature_spec(KEYS + ", is_fraud:i"), FEATURES_BATCH)
def q_features_blocked(spark, sf):
    return feat.engineer_features(cards(spark, sf), skew_safe=True, hot_rows=40, block_rows=60)


@register("features_from_csv", feature_spec("cc_num:i"), FEATURES_BATCH)
def q_features_csv(spark, sf):
    """CSV files with foreign columns, in another order, written to scratch and read back."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    raw = cards(spark, sf)
    (raw.select("category", "k", "amt", F.col("trans_date_trans_time").cast("string").alias("trans_date_trans_time"),
                "merchant", "merch_long", "merch_lat", "long", "lat", "cc_num", F.lit("x").alias("note")).write.option("header", True).csv(path))
    return feat.engineer_features(read_raw_csv(spark, path))


@register("features_from_csv_sets", feature_spec("cc_num:i"), FEATURES_BATCH)
def q_features_csv_sets(spark, sf):
    """Two sets of CSV files, the second with its columns in another order and one more, read together."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    raw = cards(spark, sf).withColumn("trans_date_trans_time", F.col("trans_date_trans_time").cast("string"))
    names = RAW_TRANSACTION_SCHEMA.names
    raw.filter("event_id % 3 <> 0").select(*names).write.option("header", True).csv(f"{path}/one")
    raw.filter("event_id % 3 = 0").select(F.lit("x").alias("note"), *names[::-1]).write.option("header", True).csv(f"{path}/two")
    rows, rejected = read_raw_csv_strict(spark, f"{path}/one", f"{path}/two")
    return feat.engineer_features(rows.join(rejected, "event_id", "left_anti"))


CARD_GAPS = [("card_gaps", "SELECT * REPLACE (CASE WHEN event_id % 5 <> 0 THEN amt END AS amt, "
              "CASE WHEN event_id % 3 <> 0 THEN merchant END AS merchant, "
              "date_trunc('day', trans_date_trans_time) AS trans_date_trans_time) FROM card_tx")]
GAP_SPEC = feature_spec(KEYS)


@register("features_batch_gaps", GAP_SPEC, features_batch_sql("card_gaps"), CARD_GAPS)
def q_features_gaps(spark, sf):
    """Missing amounts and merchants and ties of time, cards in one task each."""
    return feat.engineer_features(fixtures.card_gaps(cards(spark, sf)))


@register("features_batch_gaps_blocked", GAP_SPEC, features_batch_sql("card_gaps"), CARD_GAPS)
def q_features_gaps_blocked(spark, sf):
    """The same rows with every card above 40 rows cut into blocks."""
    return feat.engineer_features(fixtures.card_gaps(cards(spark, sf)), hot_rows=40, block_rows=60)


@register("feat_expanding_median_blocked", KEYS + ", median_purchase_price:d",
          f"SELECT event_id, cc_num, median(amt) {win(frame=UNB)} AS median_purchase_price FROM card_gaps", CARD_GAPS)
def q_median_blocked(spark, sf):
    return feat.expanding_median(fixtures.card_gaps(cards(spark, sf)), hot_rows=40, block_rows=60)
