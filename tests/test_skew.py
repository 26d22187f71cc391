"""The blocked (hot-key) window path gives exactly the plain window results."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001, SF01
from txguard.operators import features as feat
from txguard.operators import online as on
from txguard.plans import expanding
from txguard.schemas import FEATURE_COLS
from txguard.sources import fixtures
from txguard.sources.tables import read_table


def rows(df, key):
    return {r[key]: tuple(r[c] for c in FEATURE_COLS) for r in df.select(key, *FEATURE_COLS).collect()}


def close(a, b):
    assert a.keys() == b.keys()
    for k in a:
        for x, y in zip(a[k], b[k]):
            assert (x is None and y is None) or abs(x - y) <= 1e-9 * max(1.0, abs(y)), (k, x, y)


@pytest.mark.parametrize("sf", [SF001, SF01])
def test_online_blocked_equals_plain(spark, sf):
    tx = fixtures.transactions(fixtures.card_tx(read_table(spark, sf, "events")))
    plain = on.online_features(tx, hot_rows=10**9)
    # every user above 20 rows is hot; blocks of 64 rows with a 50-row halo
    blocked = on.online_features(tx, hot_rows=20, block_rows=64)
    close(rows(blocked, "_id"), rows(plain, "_id"))


@pytest.mark.parametrize("sf", [SF001, SF01])
def test_batch_blocked_equals_plain(spark, sf):
    cards = fixtures.card_tx(read_table(spark, sf, "events"))
    plain = feat.engineer_features(cards, skew_safe=False)
    # cards above 40 rows are hot; blocks of 60 rows (halo 49)
    blocked = feat.engineer_features(cards, skew_safe=True, hot_rows=40, block_rows=60)
    close(rows(blocked, "event_id"), rows(plain, "event_id"))


def test_positions_are_exact(spark):
    from pyspark.sql import functions as F
    from txguard.plans.sequence import positions
    cards = fixtures.card_tx(read_table(spark, SF01, "events"))
    pos = positions(cards, "cc_num", ["trans_date_trans_time", "event_id"], partitions=7)
    from pyspark.sql import Window
    ref = cards.withColumn("_rn", F.row_number().over(
        Window.partitionBy("cc_num").orderBy("trans_date_trans_time", "event_id")))
    a = {r["event_id"]: r["_g"] for r in pos.select("event_id", "_g").collect()}
    b = {r["event_id"]: r["_rn"] for r in ref.select("event_id", "_rn").collect()}
    assert a == b


@pytest.mark.parametrize("block", [7, 16])
def test_expanding_median_blocked_equals_plain(spark, block):
    cards = fixtures.card_gaps(fixtures.card_tx(read_table(spark, SF001, "events")))
    ref = feat.expanding_median(cards)
    got = feat.expanding_median(cards, hot_rows=20, block_rows=block)
    a, b = ({r["event_id"]: r["median_purchase_price"] for r in x.select("event_id", "median_purchase_price").collect()}
            for x in (got, ref))
    assert a == b and None in a.values()


def test_one_large_card(spark):
    """16,000 rows of one card: near-linear in the light path, the same in blocks."""
    import time
    from pyspark.sql import functions as F
    one = spark.range(16_000).select(
        F.col("id").alias("event_id"), F.lit(1).alias("cc_num"), F.col("id").alias("trans_date_trans_time"),
        F.when(F.col("id") % 7 != 0, F.col("id") * 7919 % 10007).cast("double").alias("amt")).cache()
    one.count()
    t = time.time()
    light = {r[0]: r[1] for r in feat.expanding_median(one).select("event_id", "median_purchase_price").collect()}
    assert time.time() - t < 30       # a quadratic window takes minutes here
    hot = feat.expanding_median(one, hot_rows=1000, block_rows=3000)
    assert light == {r[0]: r[1] for r in hot.select("event_id", "median_purchase_price").collect()}


def test_null_key_is_split_too(spark):
    from pyspark.sql import functions as F
    from txguard.plans.sequence import sequence_window
    df = spark.range(300).select(F.when(F.col("id") % 3 == 0, F.lit("u")).alias("k"), F.col("id"))
    build = lambda w: {"p": F.lag("id").over(w)}
    plain, cut = (sequence_window(df, "k", ["id"], build, 1, hot_rows=h, block_rows=20) for h in (1000, 50))
    assert {r["id"]: r["p"] for r in plain.collect()} == {r["id"]: r["p"] for r in cut.collect()}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_with_positions_are_not_shuffled_again(spark, monkeypatch):
    """Offsets of the few keys that go on in another partition are sent to the rows, and blocks are no calls of their own."""
    from txguard.plans.sequence import positions
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(3000).selectExpr("if(id % 3 = 0, null, id % 2) k", "id", "id % 5 = 0 x")
        pos = positions(df, "k", ["id"], partitions=7, counted=F.col("x"))
        assert "BroadcastHashJoin" in plan(pos) and "SortMergeJoin" not in plan(pos)
        seen = {}
        for r in sorted(pos.collect(), key=lambda r: r["id"]):
            place, known = seen.get(r["k"], (0, 0))
            seen[r["k"]] = place + 1, known + r["x"]
            assert (r["_g"], r["_c"]) == seen[r["k"]]
        hot = feat.expanding_median(fixtures.card_tx(read_table(spark, SF001, "events")), hot_rows=20, block_rows=16)
        assert "FlatMapGroupsInPandas" not in plan(hot)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


@pytest.mark.parametrize("listed", [1, 10**6])
def test_block_medians_over_batches(monkeypatch, listed):
    """Both ways of reading medians, blocks that go on in the next batch included."""
    monkeypatch.setattr(expanding, "LISTED_ROWS", listed)
    rng = np.random.default_rng(1)
    x = rng.integers(0, 30, 200).astype(float)
    rows, exp = [], {}
    for k, b, lo, hi in (("a", 0, 0, 60), ("a", 1, 60, 110), (None, 0, 110, 200)):
        before = np.sort(x[:lo]) if b else x[:0]
        rows += [(k, b, 0, 0, i, float(y)) for i, y in enumerate(before)]
        for i in range(lo, hi):
            g = i + 1 - (0 if k else lo)
            rows.append((k, b, 0, g, 1000 + i, x[i]))
            exp[k, g] = np.median(x[i + 1 - g:i + 1])
    names = ["_k", "_b", "_off", "_g", "_v", "_x"]
    # places by value, ties by time
    order = sorted(range(len(rows)), key=lambda i: (rows[i][5], rows[i][4]))
    place = {i: p for p, i in enumerate(order)}
    rows = [(*r[:4], place[i], r[5]) for i, r in enumerate(rows)]
    table = pa.table({n: [r[j] for r in rows] for j, n in enumerate(names)})
    got = {}
    for out in expanding.block_medians(iter(table.to_batches(max_chunksize=37)), pa.string()):
        got |= {(r["_k"], r["_c"]): r["_med"] for r in out.to_pylist()}
    assert got == exp
