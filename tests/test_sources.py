"""CSV sets with different headers, pages by place, thresholds by time."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from txguard.operators import queries as qy
from txguard.operators import scoring as sc
from txguard.plans.asof import as_of
from txguard.schemas import RAW_TRANSACTION_SCHEMA
from txguard.sources.tables import read_raw_csv, read_raw_csv_strict

NAMES = RAW_TRANSACTION_SCHEMA.names


def csv_line(names, **values):
    row = {"cc_num": "10", "trans_date_trans_time": "2020-01-01 10:00:00", "amt": "1.5", "lat": "40", "long": "50", "merch_lat": "41",
           "merch_long": "51", "merchant": "shop", "category": "net", "is_fraud": "0", **values}
    return ",".join(row.get(n, "?") for n in names)


def test_files_are_read_by_their_own_header(spark, tmp_path):
    back = ["note", *NAMES[::-1]]
    some = NAMES[:-1]
    (tmp_path / "b two.csv").write_text("\n".join([",".join(back), csv_line(back, cc_num="20"), csv_line(back, cc_num="21")]) + "\n")
    (tmp_path / "a.csv").write_text("\n".join([",".join(NAMES), csv_line(NAMES, merchant='"a, b"'), csv_line(NAMES, cc_num="11")]) + "\n")
    (tmp_path / "c.csv").write_text("\n".join([",".join(some), csv_line(some, cc_num="30")]) + "\n")
    (tmp_path / "d.csv").write_text("")
    (tmp_path / "e.csv").write_text(",".join(NAMES) + "\n")
    rows = read_raw_csv(spark, str(tmp_path)).orderBy("event_id").collect()
    assert [r["event_id"] for r in rows] == [0, 1, 2, 3, 4]               # files by path, lines in order
    assert [r["cc_num"] for r in rows] == [10, 11, 20, 21, 30]
    assert [r["merchant"] for r in rows] == ["a, b", "shop", "shop", "shop", "shop"]
    assert all(r["amt"] == 1.5 and r["lat"] == 40.0 and r["merch_long"] == 51.0 and r["category"] == "net" for r in rows)
    assert [r["is_fraud"] for r in rows] == [0, 0, 0, 0, None]
    (tmp_path / "none").mkdir()
    assert read_raw_csv(spark, str(tmp_path / "d.csv")).count() == 0


def test_numbering_over_many_splits(spark, tmp_path):
    """Large files come first in Spark's own order; the numbers follow path and line."""
    sizes = {"a": 300, "b": 5000, "c": 40}
    for name, n in sizes.items():
        (tmp_path / f"{name}.csv").write_text("\n".join([",".join(NAMES), *[csv_line(NAMES, amt=str(k), merchant=name) for k in range(n)]]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = read_raw_csv(spark, str(tmp_path)).select("event_id", "merchant", "amt").orderBy("event_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r["merchant"], r["amt"]) for r in got] == [(f, float(k)) for f in sizes for k in range(sizes[f])]
    assert [r["event_id"] for r in got] == list(range(sum(sizes.values())))


def test_rejected_rows_are_kept_apart(spark, tmp_path):
    lines = [",".join(NAMES), csv_line(NAMES), csv_line(NAMES, amt="x", lat="north"), "1,2,3", csv_line(NAMES) + ",more",
             csv_line(NAMES, amt=""), csv_line(NAMES, cc_num="12")]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    good, bad = read_raw_csv_strict(spark, str(tmp_path))
    assert sorted((r["event_id"], r["cc_num"], r["amt"]) for r in good.collect()) == [(0, 10, 1.5), (4, 10, None), (5, 12, 1.5)]
    bad = {r["event_id"]: r for r in bad.collect()}
    assert sorted(bad) == [1, 2, 3]
    assert bad[1]["reason"] == "no value of amt, lat" and bad[2]["reason"] == bad[3]["reason"] == "number of values"
    assert bad[2]["record"] == "1,2,3" and bad[1]["file"].endswith("a.csv")
    lax = read_raw_csv(spark, str(tmp_path)).orderBy("event_id").collect()
    assert len(lax) == 6 and lax[1]["amt"] is None and lax[1]["cc_num"] == 10


def stored(spark, tmp_path, n=3000):
    rng = random.Random(1)
    day = dt.datetime(2024, 1, 1)
    rows = [(f"t{k:05d}", None if k % 97 == 0 else day + dt.timedelta(minutes=rng.choice([k, 700])), k) for k in range(n)]
    path = str(tmp_path / "tx")
    spark.createDataFrame(rows, "_id string, createdAt timestamp, v int").repartition(5).sortWithinPartitions("createdAt").write.parquet(path)
    return spark.read.parquet(path)


def test_pages_by_place(spark, tmp_path):
    """Half of the rows share one time and some have none; every page is that of an offset."""
    tx = stored(spark, tmp_path)
    want = [r["_id"] for r in tx.orderBy(*qy.newest_first()).collect()]
    qy.page_index(tx, 20).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    assert index.agg(F.sum("n")).first()[0] == len(want) and index.agg(F.max("n")).first()[0] < 600
    for page in (1, 2, 40, 77, 120, 150, 151):
        got = [r["_id"] for r in qy.page_at(tx, index, page, 20).collect()]
        assert got == want[20 * (page - 1):20 * page], page
    plan = qy.page_at(tx, index, 40, 20)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(createdAt" in plan
    got, last = [], (None, None)
    for _ in range(6):
        rows = qy.page_after(tx, *last, 100).collect()
        got += [r["_id"] for r in rows]
        last = (rows[-1]["createdAt"], rows[-1]["_id"])
    assert got == want[:600]
    tail = next(i for i, r in enumerate(tx.orderBy(*qy.newest_first()).collect()) if r["createdAt"] is None)
    assert [r["_id"] for r in qy.page_after(tx, None, want[tail], 5).collect()] == want[tail + 1:tail + 6]


@pytest.mark.parametrize("rows_per_piece", [10, 200, 10**6])
def test_as_of_against_brute_force(spark, rows_per_piece):
    """One interval holds most rows, some times are equal or missing on either side."""
    rng = random.Random(rows_per_piece)
    day = dt.datetime(2024, 1, 1)

    def at(minute):
        return None if minute is None else day + dt.timedelta(minutes=minute)

    left = [(k, rng.choice([None, 50, 50, 50, rng.randrange(40, 60), rng.randrange(200)])) for k in range(800)]
    right = [(rng.choice([0.1, 0.5, None, 0.9]), m) for m in [None, 5, 39, 50, 50, 61, 150, 150, 199]]
    got = as_of(spark.createDataFrame([(k, at(m)) for k, m in left], "k int, t timestamp"),
                spark.createDataFrame([(v, at(m)) for v, m in right], "v double, s timestamp"), "t", "s", "v", "found", rows_per_piece=rows_per_piece)

    def brute(m):
        if m is None:
            return None
        seen = [(s, v is not None, v or 0, v) for v, s in right if s is not None and s <= m]
        return max(seen)[3] if seen else None
    assert sorted((r["k"], r["found"]) for r in got.collect()) == sorted((k, brute(m)) for k, m in left)


def test_threshold_of_a_records_own_time(spark):
    day = dt.datetime(2024, 1, 1)
    scored = spark.createDataFrame([(h, day + dt.timedelta(hours=h), 0.5, "old") for h in range(6)] + [(9, None, 0.7, "old")],
                                   "h int, timestamp timestamp, fraud_score double, status string")
    history = spark.createDataFrame([(0.4, day + dt.timedelta(hours=1)), (0.5, day + dt.timedelta(hours=3)), (0.2, day + dt.timedelta(hours=5))],
                                    "threshold double, updatedAt timestamp")
    got = {r["h"]: (r["threshold"], r["status"]) for r in sc.decide_as_of(scored, history).collect()}
    assert got == {0: (0.6, "CLEARED"), 1: (0.4, "FLAGGED"), 2: (0.4, "FLAGGED"), 3: (0.5, "CLEARED"), 4: (0.5, "CLEARED"),
                   5: (0.2, "FLAGGED"), 9: (0.6, "FLAGGED")}
    none = spark.createDataFrame([], history.schema)
    assert {r["threshold"] for r in sc.decide_as_of(scored, none).collect()} == {0.6}
