"""Operator semantics on small hand-made frames."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from txguard.operators import evaluate as ev
from txguard.operators import mutations as mu
from txguard.operators import queries as qy
from txguard.operators import validate as va


def test_auc_matches_brute_force(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice([0, 1]), float(rnd.randint(0, 30))) for _ in range(400)]   # many ties
    df = spark.createDataFrame(rows, "y_true int, score double")
    got = ev.auc(df, rows_per_bucket=60).first()["roc_auc"]   # 7 buckets
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    wins = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
    assert abs(got - wins / (len(pos) * len(neg))) < 1e-12


def test_auc_single_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.3), (1, 0.5)], "y_true int, score double")
    assert ev.auc(df).first()["roc_auc"] is None


def test_sweep_na_when_nothing_predicted(spark):
    df = spark.createDataFrame([(1, 0.1), (0, 0.2)], "y_true int, mse double")
    rows = {r["threshold"]: r for r in ev.sweep(df).collect()}
    assert rows[5.0]["precision"] is None and rows[5.0]["f1"] is None


def test_page_params_clamp():
    assert qy.page_params(None, None) == (1, 20)
    assert qy.page_params("0", "0") == (1, 20)        # parseInt(...) || default
    assert qy.page_params("-3", "500") == (1, 100)
    assert qy.page_params("2", "-5") == (2, 1)
    with pytest.raises(ValueError):
        qy.alerts_limit("-4")
    assert qy.alerts_limit("500") == 100


def test_stats_null_status_counts_zero(spark):
    tx = spark.createDataFrame([("a", "FLAGGED"), ("b", None), ("c", "PENDING"), ("d", "WEIRD")],
                               "_id string, status string")
    r = qy.stats(tx).first()
    assert (r["total"], r["flagged"], r["pending"], r["cleared"]) == (3, 1, 1, 0)


def test_upsert_latest_version_wins(spark):
    t = spark.createDataFrame([("a", "PENDING", 1.0), ("b", "PENDING", 2.0)], "_id string, status string, createdAt double")
    u = spark.createDataFrame([("a", "CLEARED", 1), ("a", "FLAGGED", 2), ("c", "CLEARED", 1)],
                              "_id string, status string, _version int")
    got = {r["_id"]: (r["status"], r["createdAt"]) for r in mu.upsert(t, u).collect()}
    assert got == {"a": ("FLAGGED", 1.0), "b": ("PENDING", 2.0), "c": ("CLEARED", None)}


def test_review_bulk_audits_every_requested_id(spark):
    tx = spark.createDataFrame([("a", "FLAGGED"), ("b", "FLAGGED")], "_id string, status string")
    req = spark.createDataFrame([("a", "BLOCKED"), ("zz", "BLOCKED"), ("a", "BLOCKED")], "_id string, new_status string")
    upd, audit = mu.review(tx, req, "analyst")
    assert {r["_id"]: r["status"] for r in upd.collect()} == {"a": "BLOCKED", "b": "FLAGGED"}
    assert audit.count() == 3
    _, single = mu.review(tx, req.limit(2), "analyst", bulk=False)
    assert [r["transactionId"] for r in single.collect()] == ["a"]


def test_message_validation_is_strict(spark):
    good = '{"_id":"x","userId":"u","amount":1,"lat":1.5,"lon":2,"distance_from_home":3,' \
           '"repeat_retailer":0,"used_chip":1,"used_pin_number":0,"online_order":1,"extra":"kept"}'
    num_user = good.replace('"userId":"u"', '"userId":5')
    str_amt = good.replace('"amount":1', '"amount":"1"')
    df = spark.createDataFrame([(good,), (num_user,), (str_amt,), ("{bad",), ("[1]",)], "value string")
    r = [(x["valid"], x["error_message"], x["retry_count"]) for x in va.validate_messages(df).collect()]
    assert r[0] == (True, None, 0)
    assert r[1][0] is False and r[2][0] is False and r[4][0] is False
    assert r[3] == (False, "Malformed JSON", 3)


def test_ingress_validation_messages(spark):
    df = spark.createDataFrame([("", -1.0, 95.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0)],
                               "userId string, amount double, lat double, lon double, distance_from_home double, "
                               "repeat_retailer double, used_chip double, used_pin_number double, online_order double")
    valid, bad = va.validate_ingress(df)
    assert valid.count() == 0
    fields = [e["field"] for e in bad.first()["errors"]]
    assert fields == ["userId", "amount", "lat"]


def test_bounded_broadcast_falls_back(spark):
    small = spark.range(10)
    assert mu.bounded_broadcast(small, max_rows=5) is small
