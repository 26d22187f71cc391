"""Stream = replay: the stateful consumer over file micro-batches gives the same
scores as the batch replay of online features; DLQ gets exactly the faulty
records; re-running from the checkpoint adds nothing."""

import os
import tempfile
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import SF001
from txguard.operators import online as on
from txguard.operators import scoring as sc
from txguard.operators.validate import NUMBER_FIELDS, STRING_FIELDS, validate_messages
from txguard.sources import fixtures
from txguard.sources.message_log import publish, read_log
from txguard.sources.sinks import StoredTable
from txguard.streaming.scoring_stream import Tables, dead_letter_rows, start_scoring, stream_counters, stream_latency


def write_message_files(spark, src_dir, n_files=4):
    msgs = fixtures.load(spark, SF001)["messages"].orderBy("createdAt", "event_id").toPandas()
    rows = msgs["value"].tolist()
    per = (len(rows) + n_files - 1) // n_files
    for i in range(n_files):
        path = os.path.join(src_dir, f"part-{i:03d}.json")
        with open(path, "w") as fh:
            fh.write("\n".join(rows[i * per:(i + 1) * per]) + "\n")
        # the file source takes files in modification-time order
        os.utime(path, (1_700_000_000 + i * 10, 1_700_000_000 + i * 10))
    return msgs


def test_stream_equals_replay(spark):
    root = tempfile.mkdtemp(prefix="txg-stream-")
    src = os.path.join(root, "in")
    os.makedirs(src)
    msgs = write_message_files(spark, src)
    tables = Tables(*(os.path.join(root, n) for n in ("tx", "alerts", "counters", "dlq")))
    job = start_scoring(spark, src, tables, os.path.join(root, "ckpt"), available_now=True, max_files=1,
                         **fixtures.fixture_model())
    job.scoring.awaitTermination(300)
    job.dead_letters.awaitTermination(300)

    cur = StoredTable(spark, tables.transactions).current()
    # replay: validate the same messages, online features over the valid rows, score
    m = validate_messages(fixtures.load(spark, SF001)["messages"])
    valid = m.filter("valid").select(*STRING_FIELDS, *NUMBER_FIELDS, "timestamp")
    rep = sc.score_rows(on.online_features(valid), **fixtures.fixture_model())
    a = {r["_id"]: (r["fraud_score"], r["status"]) for r in cur.select("_id", "fraud_score", "status").collect()}
    b = {r["_id"]: (r["fraud_score"], r["status"]) for r in rep.select("_id", "fraud_score", "status").collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert abs(a[k][0] - b[k][0]) < 1e-9, k
        assert a[k][1] == b[k][1], k

    faults = int(((msgs.event_id % 97 == 0) | (msgs.event_id % 89 == 0) | (msgs.event_id % 83 == 0)).sum())
    c = stream_counters(spark, tables).first()
    assert c["dlq"] == faults
    assert c["processed"] == len(msgs) - faults
    assert c["flagged"] == sum(1 for v in a.values() if v[1] == "FLAGGED")
    # every message read is processed or a dead letter, and the histogram has one duration per processed record
    for _ in range(100):
        if job.messages.read == len(msgs):
            break
        time.sleep(0.1)
    assert job.messages.read == c["processed"] + c["dlq"] and job.messages.valid == c["processed"]
    le = {r["le"]: r["cnt"] for r in stream_latency(spark, tables).collect()}
    assert le["+Inf"] == c["processed"] and list(le.values()) == sorted(le.values())

    # restart from the checkpoint: nothing new, nothing duplicated
    job2 = start_scoring(spark, src, tables, os.path.join(root, "ckpt"), available_now=True, max_files=1,
                         **fixtures.fixture_model())
    job2.scoring.awaitTermination(300)
    job2.dead_letters.awaitTermination(300)
    assert dead_letter_rows(spark, tables).count() == faults
    assert StoredTable(spark, tables.transactions).log().count() == len(msgs) - faults


def test_batch_replay_is_idempotent(spark):
    root = tempfile.mkdtemp(prefix="txg-idem-")
    t = StoredTable(spark, os.path.join(root, "t"))
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "_id string, v double")
    t.write_batch(df, 7)
    t.write_batch(df, 7)          # the same micro-batch delivered again
    assert t.log().count() == 2
    t.write_batch(spark.createDataFrame([("a", 5.0)], "_id string, v double"), 8)
    cur = {r["_id"]: r["v"] for r in t.current().collect()}
    assert cur == {"a": 5.0, "b": 2.0}


def test_ingress_stream(spark):
    import json
    from txguard.streaming.ingress_stream import start_ingress
    root = tempfile.mkdtemp(prefix="txg-ingress-")
    src = os.path.join(root, "in")
    os.makedirs(src)
    good = {"userId": "u1", "amount": 10.5, "lat": 10.0, "lon": 20.0, "distance_from_home": 3.0,
            "repeat_retailer": 1, "used_chip": 0, "used_pin_number": 1, "online_order": 0, "category": "dropped"}
    bad = dict(good, amount=-1, lat=95.0)
    with open(os.path.join(src, "a.json"), "w") as fh:
        fh.write("\n".join(json.dumps(x) for x in [good, dict(good, userId="u2"), bad, good, dict(good, userId=7)]) + "\n")
    paths = {n: os.path.join(root, n) for n in ("tx", "rejects", "topic", "ckpt")}
    q = start_ingress(spark, src, paths["tx"], paths["rejects"], paths["topic"], paths["ckpt"], available_now=True)
    q.awaitTermination(300)
    stored = StoredTable(spark, paths["tx"]).current().collect()
    assert sorted(r["userId"] for r in stored) == ["u1", "u1", "u2"]      # equal requests are two
    assert all(r["timestamp"] is not None for r in stored)
    assert all(r["status"] == "PENDING" and r["fraud_score"] == -1.0 for r in stored)
    assert "category" not in stored[0].asDict()
    published = read_log(spark, paths["topic"]).collect()
    assert len(published) == 3 and all(json.loads(r["value"])["status"] == "PENDING" for r in published)
    rejects = {tuple((e["field"], e["message"]) for e in r["errors"]) for r in spark.read.parquet(paths["rejects"]).collect()}
    assert rejects == {(("amount", "Amount must be positive"), ("lat", "Number must be less than or equal to 90")),
                       (("userId", "Expected string, received number"),)}


def test_two_writers_and_published_rows(spark, tmp_path):
    t = StoredTable(spark, str(tmp_path / "t"))
    row = "_id string, status string, v int, createdAt timestamp, updatedAt timestamp"

    def batch(*rows):
        return spark.createDataFrame([(i, s, v, *(spark.sql(f"SELECT timestamp'2024-01-01 {h:02d}:00:00'").first()[0]
                                                  for h in (a, b))) for i, s, v, a, b in rows], row)

    assert t.write_batch(batch(("a", "PENDING", 1, 1, 1), ("b", "PENDING", 2, 1, 1)), 0, "ingress")
    assert t.write_batch(batch(("a", "FLAGGED", 3, 5, 5)), 0, "scoring")
    assert not t.write_batch(batch(("a", "REPLAYED", 9, 9, 9)), 0, "scoring")
    assert {r["_id"]: r["v"] for r in t.current().collect()} == {"a": 3, "b": 2}
    assert t.current().filter("_id = 'a'").first()["createdAt"].hour == 1
    first = t.publish(str(tmp_path / "p1"))
    t.write_batch(batch(("c", "FLAGGED", 9, 7, 7), ("b", "CLEARED", 4, 7, 7)), 1, "scoring")
    second = t.publish(str(tmp_path / "p2"))
    assert {r["_id"]: (r["v"], r["status"]) for r in first.collect()} == {"a": (3, "FLAGGED"), "b": (2, "PENDING")}
    assert {r["_id"]: (r["v"], r["status"]) for r in second.collect()} == {"a": (3, "FLAGGED"), "b": (4, "CLEARED"), "c": (9, "FLAGGED")}
    flagged = second.filter("status = 'FLAGGED'")
    assert sorted(r["_id"] for r in flagged.collect()) == ["a", "c"]
    plan = flagged._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "PartitionFilters: [isnotnull(status" in plan


def test_state_orders_all_batches_of_a_user(spark):
    import pandas as pd
    from txguard.streaming.state import make_state_fn
    rng = __import__("random").Random(3)
    n = 260
    rows = pd.DataFrame({"_id": [f"t{i:04d}" for i in range(n)], "userId": "u", "amount": [rng.random() * 90 for _ in range(n)],
                         "lat": 1.0, "lon": [float(i) for i in range(n)], "distance_from_home": 1.0, "repeat_retailer": 0.0,
                         "used_chip": 0.0, "used_pin_number": 0.0, "online_order": 0.0,
                         "timestamp": pd.date_range("2024-01-01", periods=n, freq="min")})

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    one, two = State(), State()
    whole = pd.concat(make_state_fn()(("u",), iter([rows]), one))
    late_first = pd.concat(make_state_fn()(("u",), iter([rows[100:], rows[:100]]), two))
    pd.testing.assert_frame_equal(whole.reset_index(drop=True), late_first.reset_index(drop=True))
    assert one.get == two.get and len(one.get[0]) == 50
    three = State()
    fn = make_state_fn()
    parts = pd.concat([*fn(("u",), iter([rows[:70]]), three), *fn(("u",), iter([rows[70:]]), three)])
    pd.testing.assert_frame_equal(whole.reset_index(drop=True), parts.reset_index(drop=True))
    replay = on.online_median(spark.createDataFrame(rows)).toPandas().sort_values("_id")
    assert abs(whole["median_purchase_price"].to_numpy() - replay["median_purchase_price"].to_numpy()).max() < 1e-12


def test_a_batch_that_no_sink_takes_becomes_dead_letters(spark, tmp_path):
    from txguard.streaming.scoring_stream import make_batch_writer
    tables = Tables(*(str(tmp_path / n) for n in ("tx", "alerts", "counters", "dlq")))
    (tmp_path / "tx").write_text("a file where the table's folder should be")
    valid = fixtures.load(spark, SF001)["messages"].limit(20)
    feats = on.online_features(validate_messages(valid).filter("valid").select(*STRING_FIELDS, *NUMBER_FIELDS, "timestamp"))
    make_batch_writer(tables, None, retry_delay=0.01, **fixtures.fixture_model())(feats, 3)
    dead = dead_letter_rows(spark, tables).collect()
    assert len(dead) == feats.count() and {r["envelope"]["metadata"]["retryCount"] for r in dead} == {3}


def many_features(spark, n, tmp_path):
    """Features of n records."""
    tx = fixtures.load(spark, SF001)["transactions"].drop("status", "fraud_score")
    one = on.online_features(tx.limit(50)).drop("event_id", "createdAt")
    many = spark.range(n).select((F.col("id") % 50).alias("k"), F.concat(F.lit("p"), "id").alias("_id"))
    base = one.drop("_id").withColumn("k", F.row_number().over(Window.orderBy("userId", "timestamp")) - 1)
    path = str(tmp_path / f"features-{n}")
    many.join(F.broadcast(base), "k").drop("k").withColumns(
        {"partition": F.lit(2), "offset": F.substring("_id", 2, 9)}).write.parquet(path)
    return spark.read.parquet(path)


def test_one_bad_record_in_ten_thousand(spark, tmp_path, monkeypatch):
    """Only the bad record becomes a dead letter, also when the stream dies while it looks for it."""
    from txguard.streaming import scoring_stream as ss
    tables = Tables(*(str(tmp_path / n) for n in ("tx", "alerts", "counters", "dlq")))
    feats = many_features(spark, 10_000, tmp_path)
    score = sc.score_rows

    def fails_on_one(batch, *args):
        bad = F.when(F.col("_id") == "p4321", F.raise_error(F.concat(F.lit("bad record "), "_id")).cast("double"))
        return score(batch.withColumn("amount", F.coalesce(bad, "amount")), *args)
    monkeypatch.setattr(ss.sc, "score_rows", fails_on_one)
    # a network that copies its input: few terms, so that the many small plans are made fast
    same = [([[float(i == j) for j in range(29)] for i in range(29)], [0.0] * 29)]
    writer = ss.make_batch_writer(tables, None, same, fixtures.fixture_model()["supervised"], retry_delay=0.0)
    stored, store = [], writer.store

    def dies_in_the_middle(batch, batch_id, part="all"):
        store(batch, batch_id, part)
        stored.append(part)
        if len(stored) == 5:
            raise KeyboardInterrupt
    writer.store = dies_in_the_middle
    with pytest.raises(KeyboardInterrupt):
        writer(feats, 7)
    assert StoredTable(spark, tables.transactions).log().count() < 9_999
    writer.store = store
    writer(feats, 7)
    log = StoredTable(spark, tables.transactions).log()
    assert log.count() == log.select("_id").distinct().count() == 9_999
    dead = dead_letter_rows(spark, tables).select("envelope.*").collect()
    assert len(dead) == 1 and "bad record p4321" in dead[0]["error"]["message"]
    place = dead[0]["metadata"]
    assert (place["partition"], place["offset"], place["retryCount"]) == (2, "4321", 3)
    c = stream_counters(spark, tables).first()
    assert (c["processed"], c["dlq"]) == (9_999, 1)
    before = sorted(tuple(r) for r in log.select("_id", "_part").collect())
    writer(feats, 7)                                     # the finished batch delivered once more
    assert sorted(tuple(r) for r in StoredTable(spark, tables.transactions).log().select("_id", "_part").collect()) == before
    assert stream_counters(spark, tables).first()["processed"] == 9_999


def test_threshold_newest_row(spark, tmp_path):
    from txguard.streaming.scoring_stream import read_threshold
    path = str(tmp_path / "threshold")
    assert read_threshold(spark, path).first()["threshold"] == 0.6
    sc.set_threshold(spark, path, 0.9)
    sc.set_threshold(spark, path, 0.3)
    assert read_threshold(spark, path).first()["threshold"] == 0.3


def test_a_log_of_messages_and_history_that_outlives_the_checkpoint(spark, tmp_path):
    """Half of the messages on one checkpoint, half on another that starts from the exported history: equal to the replay."""
    from txguard.streaming.state import export_history
    path = {n: str(tmp_path / n) for n in ("topic", "dead", "one", "two", "history")}
    msgs = fixtures.load(spark, SF001)["messages"].orderBy("createdAt", "event_id").select("value").collect()
    half = len(msgs) // 2
    tables = Tables(*(str(tmp_path / n) for n in ("tx", "alerts", "counters", "dlq")), dlq_topic=path["dead"])

    def send(rows):
        publish(spark.createDataFrame(rows, "value string").coalesce(1), path["topic"])

    def run(checkpoint, **more):
        job = start_scoring(spark, path["topic"], tables, checkpoint, fmt="log", **fixtures.fixture_model(), **more)
        job.process_all()
        job.stop()

    send(msgs[:half])
    run(path["one"])
    held = export_history(spark, path["one"], path["history"])
    assert held.count() > 10 and held.filter("size(amounts) > 50 or size(amounts) <> size(lats)").count() == 0
    send(msgs[half:])
    latest = {"startingOffsets": "latest"}
    t2 = Tables(*(str(tmp_path / f"{n}2") for n in ("tx", "alerts", "counters", "dlq")), dlq_topic=path["dead"])
    job = start_scoring(spark, path["topic"], t2, path["two"], fmt="log", seeds=path["history"], log_options=latest,
                        **fixtures.fixture_model())
    job.process_all()
    assert stream_counters(spark, t2).first()["processed"] == 0         # started behind the last record
    send(msgs[half:])
    job.process_all()
    job.stop()

    m = validate_messages(fixtures.load(spark, SF001)["messages"])
    valid = m.filter("valid").select(*STRING_FIELDS, *NUMBER_FIELDS, "timestamp")
    rep = sc.score_rows(on.online_features(valid), **fixtures.fixture_model())
    want = {r["_id"]: (r["fraud_score"], r["status"]) for r in rep.select("_id", "fraud_score", "status").collect()}
    got = {}
    for t in (tables, t2):
        for r in StoredTable(spark, t.transactions).current().select("_id", "fraud_score", "status").collect():
            got[r["_id"]] = (r["fraud_score"], r["status"])
    assert got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1] == want[k][1] for k in want)

    # a dead letter names the record it came from, in the rows and in the topic
    records = {(r["partition"], str(r["offset"])): r["value"] for r in read_log(spark, path["topic"]).collect()}
    dead = dead_letter_rows(spark, tables).select("envelope.*").collect()
    assert dead and all(records[(d["metadata"]["partition"], d["metadata"]["offset"])] == d["originalMessage_raw"] for d in dead)
    import json
    topic = [json.loads(r["value"]) for r in read_log(spark, path["dead"]).collect()]
    both = dead + dead_letter_rows(spark, t2).select("envelope.*").collect()
    assert sorted((t["metadata"]["partition"], t["metadata"]["offset"]) for t in topic) == sorted(
        (d["metadata"]["partition"], d["metadata"]["offset"]) for d in both)
