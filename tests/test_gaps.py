"""Inputs with gaps: NULL and NaN scores, unreadable event times, CSV files with foreign columns."""

import json

from txguard.operators import evaluate as ev
from txguard.operators.features import engineer_features
from txguard.operators.validate import validate_messages
from txguard.sources.tables import read_raw_csv

MESSAGE = dict(_id="a", userId="u", amount=1, lat=1, lon=1, distance_from_home=1, repeat_retailer=0, used_chip=0,
               used_pin_number=0, online_order=0)


def test_counts_add_up_to_the_rows(spark):
    df = spark.createDataFrame([(1, 2.0), (0, 1.0), (1, None), (0, float("nan")), (None, 9.0)], "y_true int, mse double")
    row = ev.confusion(df, 1.5).first()
    assert (row["tn"], row["fp"], row["fn"], row["tp"]) == (2, 1, 1, 1)
    assert [r["y_pred"] for r in ev.predict(df, 1.5).collect()] == [1, 0, 0, 0, 1]
    assert ev.auc(df, score="mse").first()["roc_auc"] is None
    assert ev.report(df).filter("label = 'accuracy'").first()["support"] == 5


def test_event_times(spark):
    times = ["not-a-date", 1700000000000, "2020-01-01T00:00:00Z", None, 1e300, True]
    rows = [(k, json.dumps({**MESSAGE, "timestamp": t})) for k, t in enumerate(times)] + [(9, json.dumps(MESSAGE))]
    got = {r["k"]: r for r in validate_messages(spark.createDataFrame(rows, "k int, value string")).collect()}
    assert all(r["valid"] for r in got.values())
    assert str(got[1]["timestamp"]).startswith("2023-11-14 22:13:20") and got[2]["timestamp"].year == 2020
    assert all(got[k]["timestamp"] is None for k in (0, 3, 4, 5, 9))


def test_csv_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "extra,amt,cc_num,trans_date_trans_time,lat,long,merch_lat,merch_long,merchant,category\n"
        "x,1.5,77,2020-01-01 10:00:00,1,2,3,4,m,net\n" "y,?,77,2020-01-01 10:00:00,1,2,3,4,m,pos\n" * 2)
    df = read_raw_csv(spark, str(tmp_path))
    out = engineer_features(df).orderBy("event_id").collect()
    assert len(out) >= 3 and len({r["event_id"] for r in out}) == len(out)
    assert out[0]["online_order"] == 1.0 and out[0]["is_fraud"] is None and out[1]["amt"] is None
