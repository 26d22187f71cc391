"""The message log: offsets, start at the latest record, commits that leave no half batch."""

import json
import os

import pytest
from pyspark.sql import functions as F

from txguard.sources import message_log as ml


@pytest.fixture
def log(spark, tmp_path):
    ml.register_message_log(spark)
    return str(tmp_path / "topic")


def read(spark, path, **options):
    return spark.read.format("message_log").options(path=path, **options).load()


def write(df, path, **options):
    df.write.format("message_log").mode("append").options(path=path, **options).save()


def messages(spark, lo, hi, parts=3):
    return spark.range(lo, hi, 1, parts).select(F.concat(F.lit("k"), "id").alias("key"), F.to_json(F.struct("id")).alias("value"))


def test_round_trip_with_dense_offsets(spark, log):
    write(messages(spark, 0, 100), log)
    write(messages(spark, 100, 130), log)
    write(messages(spark, 0, 0), log)
    odd = spark.createDataFrame([(None, "line\nbreak   é"), ("x", None), ("", "")], "key string, value string")
    write(odd.coalesce(1), log, partition=4)
    rows = read(spark, log, recordsPerTask=7).collect()
    one = {r["offset"]: json.loads(r["value"])["id"] for r in rows if r["partition"] == 0}
    assert sorted(one) == list(range(130)) and sorted(one.values()) == list(range(130))
    assert {one[k] < 100 for k in range(100)} == {True}          # a later write is behind an earlier one
    assert [(r["offset"], r["key"], r["value"]) for r in sorted(rows) if r["partition"] == 4] == [
        (0, None, "line\nbreak   é"), (1, "x", None), (2, "", "")]
    assert ml.ends_of(log) == {"0": 130, "4": 3}


def test_tasks_are_bounded():
    pieces = [ml.Piece(0, 0, 5, "a"), ml.Piece(0, 5, 5, "b"), ml.Piece(0, 10, 25, "c"), ml.Piece(1, 0, 3, "d")]
    got = [(r.pieces[0].partition, r.lo, r.hi) for r in ml.ranges(pieces, {"0": 2}, {"0": 35, "1": 3}, 10)]
    assert got == [(0, 2, 10), (0, 10, 20), (0, 20, 30), (0, 30, 35), (1, 0, 3)]
    assert ml.ranges(pieces, {"0": 35, "1": 3}, {"0": 35, "1": 3}, 10) == []


def test_a_failed_write_leaves_nothing(spark, log):
    write(messages(spark, 0, 10), log)
    bad = messages(spark, 10, 5_000, 4).withColumn(
        "value", F.when(F.col("key") == "k4990", F.raise_error(F.lit("killed"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="killed"):
        write(bad, log)
    assert read(spark, log).count() == 10 and ml.ends_of(log) == {"0": 10}
    # what a killed driver leaves: staged files, never moved
    staging = ml.LogWriter(log, 0)
    staging.write(iter([{"key": "k", "value": "v"}]))
    assert os.listdir(os.path.join(log, "_staged"))
    assert read(spark, log).count() == 10


def test_a_lost_offset_is_tried_again(spark, log, monkeypatch):
    """Another writer takes the offset between looking and moving."""
    write(messages(spark, 0, 3, 1), log)
    staging = ml.LogWriter(log, 0)
    mine = staging.write(iter([{"key": "late", "value": "v"}]))
    seen, real = [], ml.ends_of

    def slow(path):
        ends = real(path)
        if not seen:
            seen.append(1)
            write(messages(spark, 3, 5, 1), log)
        return ends
    monkeypatch.setattr(ml, "ends_of", slow)
    staging.commit([mine])
    assert {r["offset"]: r["key"] for r in read(spark, log).collect()} == {0: "k0", 1: "k1", 2: "k2", 3: "k3", 4: "k4", 5: "late"}


def test_a_micro_batch_is_written_once(spark, log):
    w = ml.LogStreamWriter(log, 0, "ingress")
    w.commit([w.write(iter([{"key": "a", "value": "1"}])), None], 0)
    again = ml.LogStreamWriter(log, 0, "ingress")
    again.commit([again.write(iter([{"key": "a", "value": "1"}]))], 0)
    # the driver was lost after the move, before it noted the write
    os.remove(os.path.join(log, "_written", "ingress-0"))
    third = ml.LogStreamWriter(log, 0, "ingress")
    third.commit([third.write(iter([{"key": "a", "value": "1"}]))], 0)
    other = ml.LogStreamWriter(log, 0, "scoring")
    other.commit([other.write(iter([{"key": "b", "value": "2"}]))], 0)
    assert [r["key"] for r in sorted(read(spark, log).collect())] == ["a", "b"]


def test_streams_from_log_to_log(spark, log, tmp_path):
    out = str(tmp_path / "out")
    write(messages(spark, 0, 40), log)

    def run(name, **options):
        s = spark.readStream.format("message_log").options(path=log, **options).load()
        w = s.select("key", F.concat(F.col("offset").cast("string"), F.lit("|"), "value").alias("value")).writeStream
        q = (w.format("message_log").option("path", out).option("writer", name)
             .option("checkpointLocation", str(tmp_path / f"ckpt-{name}")).start())
        q.processAllAvailable()
        return q

    q = run("all")
    late = run("late", startingOffsets="latest")
    write(messages(spark, 40, 50), log)
    q.processAllAvailable()
    late.processAllAvailable()
    q.stop()
    late.stop()
    run("all").stop()                                           # from its checkpoint: nothing new
    rows = [r["value"].split("|", 1) for r in read(spark, out).collect()]
    ids = sorted(json.loads(v)["id"] for _, v in rows)
    assert ids == sorted([*range(50), *range(40, 50)])
    where = {r["offset"]: r["value"] for r in read(spark, log).collect()}
    assert all(where[int(o)] == v for o, v in rows)
