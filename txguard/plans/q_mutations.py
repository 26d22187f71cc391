"""Validation, mutation, sink and counter registrations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from txguard.learning import retrain_features as rt
from txguard.learning.autoencoder import materialize
from txguard.operators import mutations as mu
from txguard.operators import online as on
from txguard.operators import scoring as sc
from txguard.operators import validate as va
from txguard.operators.metrics import pipeline_counters
from txguard.plans.q_online import ONLINE_SQL
from txguard.plans.q_scoring import scored_sql
from txguard.plans.registry import register
from txguard.plans.sqlfrag import TWO_PI, feature_spec
from txguard.schemas import FEATURE_COLS, LATENCY_BUCKETS
from txguard.session import ensure_checkpoint_dir
from txguard.sources import fixtures
from txguard.sources import message_log
from txguard.sources.sinks import StoredTable
from txguard.sources.tables import read_table
from txguard.streaming.ingress_stream import parse_requests


def fx(spark, sf):
    return fixtures.load(spark, sf)


def tx(spark, sf):
    return fx(spark, sf)["transactions"]


FAULTS = "(event_id % 97 = 0 OR event_id % 89 = 0 OR event_id % 83 = 0)"
def fixed_now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


# ------------------------------------------------------------- validation --

def _ingress_fields_sql():
    parts = ["CASE WHEN userId IS NULL OR length(userId) < 1 THEN 'userId' END",
             "CASE WHEN amount IS NULL OR isnan(amount) OR amount <= 0 THEN 'amount' END",
             "CASE WHEN lat IS NULL OR isnan(lat) OR lat < -90 OR lat > 90 THEN 'lat' END",
             "CASE WHEN lon IS NULL OR isnan(lon) OR lon < -180 OR lon > 180 THEN 'lon' END",
             "CASE WHEN distance_from_home IS NULL OR isnan(distance_from_home) OR distance_from_home < 0 "
             "THEN 'distance_from_home' END"]
    for f in ["repeat_retailer", "used_chip", "used_pin_number", "online_order"]:
        parts.append(f"CASE WHEN {f} IS NULL OR isnan({f}) OR {f} < 0 OR {f} > 1 THEN '{f}' END")
    return "concat_ws(',', " + ", ".join(parts) + ")"


@register("ingress_validate", "event_id:i, valid:b, fields:s",
          f"SELECT event_id, {_ingress_fields_sql()} = '' AS valid, {_ingress_fields_sql()} AS fields FROM ingress_raw")
def q_ingress_validate(spark, sf):
    raw = fx(spark, sf)["ingress_raw"]
    chk = raw.withColumn("errors", va.errors_column(va.ingress_rules()))
    return chk.select("event_id", (F.size("errors") == 0).alias("valid"),
                      F.concat_ws(",", F.array_distinct(F.col("errors.field"))).alias("fields"))


@register("ingress_defaults", "event_id:i, userId:s, amount:d, fraud_score:d, status:s, id_len:i",
          f"SELECT event_id, userId, amount, -1.0e0 AS fraud_score, 'PENDING' AS status, 36 AS id_len "
          f"FROM ingress_raw WHERE {_ingress_fields_sql()} = ''")
def q_ingress_defaults(spark, sf):
    valid, _ = va.validate_ingress(fx(spark, sf)["ingress_raw"], keep=["event_id"])
    d = mu.with_defaults(valid, id_from=["event_id"])
    return d.withColumn("id_len", F.length("_id"))


@register("msg_validate", "event_id:i, valid:b, error_message:s, retry_count:i",
          f"SELECT event_id, NOT {FAULTS} AS valid, CASE WHEN event_id % 97 = 0 THEN 'Malformed JSON' "
          f"WHEN {FAULTS} THEN 'Schema validation failed' END AS error_message, "
          "CASE WHEN event_id % 97 = 0 THEN 3 ELSE 0 END AS retry_count FROM transactions")
def q_msg_validate(spark, sf):
    return va.validate_messages(fx(spark, sf)["messages"])


@register("review_validate", "_id:s, new_status:s, valid:b",
          "SELECT _id, status AS new_status, coalesce(status IN ('CLEARED', 'BLOCKED'), false) AND length(_id) >= 1 "
          "AS valid FROM transactions")
def q_review_validate(spark, sf):
    r = tx(spark, sf).select("_id", F.col("status").alias("new_status"))
    return va.validate_review(r)


# --------------------------------------------------------------- mutations --

@register("tx_upsert", "_id:s, status:s, fraud_score:d",
          "SELECT _id, CASE WHEN status = 'PENDING' THEN (CASE WHEN s > 0.6e0 THEN 'FLAGGED' ELSE 'CLEARED' END) "
          "ELSE status END AS status, CASE WHEN status = 'PENDING' THEN s ELSE fraud_score END AS fraud_score "
          "FROM (SELECT *, (event_id * 7919 % 1000) / 1000.0e0 AS s FROM transactions) t")
def q_upsert(spark, sf):
    t = tx(spark, sf)
    pend = t.filter(F.col("status") == "PENDING").withColumn("s", (F.col("event_id") * 7919 % 1000) / 1000.0)
    # the same record delivered twice (a replay): the later version must win
    v1 = pend.select("_id", F.lit("CLEARED").alias("status"), F.lit(0.0).alias("fraud_score"),
                     F.lit(1).alias("_version"))
    v2 = pend.select("_id", F.when(F.col("s") > 0.6, "FLAGGED").otherwise("CLEARED").alias("status"),
                     F.col("s").alias("fraud_score"), F.lit(2).alias("_version"))
    return mu.upsert(t, v1.unionByName(v2))


@register("tx_review", "_id:s, status:s",
          "SELECT _id, CASE WHEN _id = 'tx_42' THEN 'BLOCKED' ELSE status END AS status FROM transactions")
def q_review(spark, sf):
    t = tx(spark, sf)
    req = spark.createDataFrame([("tx_42", "BLOCKED")], "_id string, new_status string")
    updated, _ = mu.review(t, req, analyst="analyst_1", bulk=False, now=fixed_now())
    return updated


@register("tx_bulk_review", "_id:s, status:s",
          "SELECT t._id, coalesce(r.new_status, t.status) AS status FROM transactions t LEFT JOIN reviews r "
          "ON t._id = r._id")
def q_bulk_review(spark, sf):
    f = fx(spark, sf)
    updated, _ = mu.review(f["transactions"], f["reviews"], analyst="analyst_1", now=fixed_now())
    return updated


@register("audit_bulk", "action:s, transactionId:s, userId:s, details:s, id_len:i",
          "SELECT new_status AS action, _id AS transactionId, 'analyst_1' AS userId, "
          "'Analyst bulk marked transaction as ' || new_status AS details, 36 AS id_len FROM reviews")
def q_audit(spark, sf):
    f = fx(spark, sf)
    _, audit = mu.review(f["transactions"], f["reviews"], analyst="analyst_1", now=fixed_now())
    return audit.withColumn("id_len", F.length("_id"))


SCORED_TX = scored_sql(f"SELECT * EXCLUDE (status, fraud_score) FROM ({ONLINE_SQL}) o")


@register("alerts_append", "transactionId:s, userId:s, score:d, reasoning:s, status:s",
          f"SELECT _id AS transactionId, userId, fraud_score AS score, reasoning, 'OPEN' AS status "
          f"FROM ({SCORED_TX}) s WHERE status_new = 'FLAGGED'")
def q_alerts_append(spark, sf):
    scored = sc.score_rows(on.online_features(tx(spark, sf)).drop("status"), **fixtures.fixture_model())
    return mu.alerts_from(scored, now=fixed_now())


@register("dlq_envelope", "event_id:i, message:s, retryCount:i, originalTopic:s, dlq_topic:s, raw_kept:b",
          f"SELECT event_id, CASE WHEN event_id % 97 = 0 THEN 'Malformed JSON' ELSE 'Schema validation failed' END "
          f"AS message, CASE WHEN event_id % 97 = 0 THEN 3 ELSE 0 END AS retryCount, 'transactions' AS originalTopic, "
          f"'transactions-dlq' AS dlq_topic, true AS raw_kept FROM transactions WHERE {FAULTS}")
def q_dlq(spark, sf):
    m = va.validate_messages(fx(spark, sf)["messages"])
    d = mu.dead_letters(m.filter(~F.col("valid")), now=fixed_now())
    e = F.col("envelope")
    return d.select("event_id", e["error"]["message"].alias("message"), e["metadata"]["retryCount"].alias("retryCount"),
                    e["metadata"]["originalTopic"].alias("originalTopic"), "dlq_topic",
                    (e["originalMessage_raw"] == F.col("value")).alias("raw_kept"))


def _request_errors_sql():
    def number(f, lo, hi, wrong=""):
        v = f"r.{f}"
        checks = f"WHEN {v} IS NULL THEN 'Required' "
        if f == "amount":
            checks += f"WHEN {v} <= 0 THEN 'Amount must be positive' "
        else:
            checks += f"WHEN {v} < {lo} THEN 'Number must be greater than or equal to {lo}' "
            if hi is not None:
                checks += f"WHEN {v} > {hi} THEN 'Number must be less than or equal to {hi}' "
        return f"'{f}: ' || CASE {wrong}{checks}END"
    user = ("'userId: ' || CASE WHEN event_id % 103 = 0 AND event_id % 107 <> 0 AND event_id % 109 <> 0 THEN "
            "'Expected string, received number' WHEN length(r.userId) < 1 THEN 'userId is required' END")
    amount = number("amount", 0, None, "WHEN event_id % 107 = 0 AND event_id % 109 <> 0 THEN 'Expected number, received string' ")
    lat = number("lat", -90, 90, "WHEN event_id % 109 = 0 THEN 'Expected number, received null' ")
    parts = [user, amount, lat, number("lon", -180, 180), number("distance_from_home", 0, None)]
    parts += [number(f, 0, 1) for f in ("repeat_retailer", "used_chip", "used_pin_number", "online_order")]
    return f"CASE WHEN event_id % 113 = 0 THEN ': Malformed JSON' ELSE concat_ws('; ', {', '.join(parts)}) END"


@register("ingress_messages", "event_id:i, errors:s",
          f"SELECT event_id, {_request_errors_sql()} AS errors FROM ingress_raw r")
def q_ingress_messages(spark, sf):
    """Per-field messages of JSON requests with absent, null and wrongly typed members."""
    r = parse_requests(fixtures.ingress_requests(fx(spark, sf)["ingress_raw"]))
    text = F.transform("errors", lambda e: F.concat(e["field"], F.lit(": "), e["message"]))
    return r.select("event_id", F.array_join(text, "; ").alias("errors"))


@register("stored_table", "_id:s, status:s, fraud_score:d, createdAt:t",
          "SELECT _id, CASE WHEN event_id % 2 <> 0 THEN 'PENDING' WHEN s > 0.6e0 AND event_id % 4 = 0 THEN 'BLOCKED' "
          "WHEN s > 0.6e0 THEN 'FLAGGED' ELSE 'CLEARED' END AS status, "
          "CASE WHEN event_id % 2 <> 0 THEN -1.0e0 ELSE s END AS fraud_score, createdAt "
          "FROM (SELECT *, (event_id * 7919 % 1000) / 1000.0e0 AS s FROM transactions) t")
def q_stored_table(spark, sf):
    """Ingress, scoring (with a replay) and review of the published flagged rows on one stored table; its current rows."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    table = StoredTable(spark, f"{root}/transactions")

    def at(hour):
        return F.lit(f"2024-02-01 0{hour}:00:00").cast("timestamp")

    t = tx(spark, sf)
    pending = t.withColumns({"status": F.lit("PENDING"), "fraud_score": F.lit(-1.0),
                             "createdAt": F.col("createdAt").cast("timestamp"), "updatedAt": at(0)})
    table.write_batch(pending, 0, "ingress")
    score = (F.col("event_id") * 7919 % 1000) / 1000.0
    scored = pending.filter("event_id % 2 = 0").withColumns({
        "fraud_score": score, "status": F.when(score > 0.6, "FLAGGED").otherwise("CLEARED"),
        "createdAt": at(1), "updatedAt": at(1)})
    table.write_batch(scored, 0, "scoring")
    table.write_batch(scored.withColumn("status", F.lit("REPLAYED")), 0, "scoring")
    published = table.publish(f"{root}/published")
    chosen = published.filter("status = 'FLAGGED' AND event_id % 4 = 0").select("_id", F.lit("BLOCKED").alias("new_status"))
    mu.store_review(table, chosen, "analyst_1", f"{root}/audit", 0, now=at(2))
    return table.current()


# -------------------------------------------------------------- sinks/json --

PUB_COLS = ["_id", "userId", "amount", "lat", "lon", "distance_from_home", "repeat_retailer", "used_chip",
            "used_pin_number", "online_order", "fraud_score", "status"]


@register("sink_publish_json", "_id:s, userId:s, amount:d, status:s",
          "SELECT _id, userId, amount, status FROM transactions")
def q_publish(spark, sf):
    p = mu.publish_json(tx(spark, sf).select(*PUB_COLS))
    v = F.col("value")
    return p.select(F.get_json_object(v, "$._id").alias("_id"), F.get_json_object(v, "$.userId").alias("userId"),
                    F.get_json_object(v, "$.amount").cast("double").alias("amount"),
                    F.get_json_object(v, "$.status").alias("status"))


@register("message_topics", "topic:s, key:s, amount:d, message:s, dense:b",
          "SELECT 'transactions' AS topic, _id AS key, amount, NULL AS message, true AS dense FROM transactions UNION ALL "
          "SELECT 'transactions-dlq', NULL, CASE WHEN event_id % 97 <> 0 THEN amount END, "
          "CASE WHEN event_id % 97 = 0 THEN 'Malformed JSON' ELSE 'Schema validation failed' END, true "
          f"FROM transactions WHERE {FAULTS}")
def q_topics(spark, sf):
    """Both topics published to a message log and read back: what a record says, and whether offsets have neither gap nor double."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/topics-{uuid.uuid4().hex}"
    message_log.publish(mu.publish_json(tx(spark, sf).select(*PUB_COLS), key="_id"), f"{root}/transactions")
    invalid = va.validate_messages(fx(spark, sf)["messages"]).filter(~F.col("valid"))
    message_log.publish(mu.dead_letter_json(mu.dead_letters(invalid, now=fixed_now())), f"{root}/transactions-dlq")
    v = F.col("value")
    seen = {"transactions": (F.get_json_object(v, "$.amount"), F.lit(None).cast("string")),
            "transactions-dlq": (F.get_json_object(v, "$.originalMessage.amount"), F.get_json_object(v, "$.error.message"))}
    out = None
    for topic, (amount, message) in seen.items():
        log = message_log.read_log(spark, f"{root}/{topic}")
        places = log.agg(((F.count_distinct("offset") == F.count(F.lit(1))) & (F.max("offset") + 1 == F.count(F.lit(1)))).alias("dense"))
        rows = log.select(F.lit(topic).alias("topic"), "key", amount.cast("double").alias("amount"), message.alias("message"))
        rows = rows.crossJoin(F.broadcast(places))
        out = rows if out is None else out.unionByName(rows)
    return out


@register("json_roundtrip", "_id:s, amount:d, lat:d, lon:d, fraud_score:d, status:s",
          "SELECT _id, amount, lat, lon, fraud_score, status FROM transactions")
def q_json(spark, sf):
    t = tx(spark, sf).select(*PUB_COLS)
    schema = t.schema
    back = mu.publish_json(t).select(F.from_json("value", schema).alias("r")).select("r.*")
    return back


# ------------------------------------------------------------------ retrain --

@register("retrain_source", "_id:s, amount:d, status:s",
          "SELECT _id, amount, status FROM transactions WHERE status = 'CLEARED'")
def q_retrain_source(spark, sf):
    return rt.retrain_source(tx(spark, sf))


def _retrain_sql():
    present = {"distance_from_home", "repeat_retailer", "used_chip", "used_pin_number", "online_order"}
    dow = "(isodow(timestamp) - 1)"
    exprs = {
        "time_of_day_sin": f"sin(hour(timestamp) * ({TWO_PI} / 24))",
        "time_of_day_cos": f"cos(hour(timestamp) * ({TWO_PI} / 24))",
        "day_of_week_sin": f"sin({dow} * ({TWO_PI} / 7))",
        "day_of_week_cos": f"cos({dow} * ({TWO_PI} / 7))",
        "amt_log": "ln(amount + 1)",
        "is_weekend": f"CASE WHEN {dow} >= 5 THEN 1.0e0 ELSE 0.0e0 END",
    }
    cols = []
    for c in FEATURE_COLS:
        if c in present:
            cols.append(c)
        elif c in exprs:
            cols.append(f"{exprs[c]} AS {c}")
        else:
            cols.append(f"0.0e0 AS {c}")
    return "SELECT _id, " + ", ".join(cols) + " FROM transactions WHERE status = 'CLEARED'"


@register("retrain_features", feature_spec("_id:s"), _retrain_sql())
def q_retrain_features(spark, sf):
    return rt.retrain_features(rt.retrain_source(tx(spark, sf)))


@register("retrain_guard", "n_seen:i, proceed:b",
          "SELECT least(count(*), 100) AS n_seen, count(*) >= 100 AS proceed FROM transactions WHERE status = 'CLEARED'")
def q_retrain_guard(spark, sf):
    return rt.retrain_guard(rt.retrain_source(tx(spark, sf)))


# ---------------------------------------------------------------- counters --

def _valid_online_sql():
    return ONLINE_SQL.replace("FROM transactions", f"FROM (SELECT * FROM transactions WHERE NOT {FAULTS}) vt")


@register("pipeline_counters", "processed:i, flagged:i, dlq:i, model_errors:i",
          f"SELECT count(*) AS processed, count(*) FILTER (WHERE status_new = 'FLAGGED') AS flagged, "
          f"(SELECT count(*) FROM transactions WHERE {FAULTS}) AS dlq, "
          f"count(*) FILTER (WHERE model_failed) AS model_errors "
          f"FROM ({scored_sql(f'SELECT * EXCLUDE (status, fraud_score) FROM ({_valid_online_sql()}) o')}) s")
def q_counters(spark, sf):
    """Messages are parsed and checked once, into a table from which both sides are counted."""
    m = va.validate_messages(fx(spark, sf)["messages"]).select("event_id", "valid", *va.STRING_FIELDS, *va.NUMBER_FIELDS, "timestamp")
    m, _ = materialize(m, "checked-messages")
    scored = sc.score_rows(on.online_features(m.filter("valid").drop("valid")), **fixtures.fixture_model())
    return pipeline_counters(scored, m.filter(~F.col("valid")))


@register("latency_histogram", "le:s, cnt:i, total_sum:d, total_count:i",
          "SELECT le, cnt, total_sum, total_count FROM (SELECT "
          + ", ".join(f"count(*) FILTER (WHERE d <= {b}) AS c{i}" for i, b in enumerate(LATENCY_BUCKETS))
          + ", count(*) AS cinf, sum(d) AS total_sum, count(*) AS total_count FROM "
          "(SELECT (event_id * 31 % 6000) / 1000.0e0 AS d FROM transactions) x) a, LATERAL (VALUES "
          + ", ".join(f"('{b}', c{i})" for i, b in enumerate(LATENCY_BUCKETS)) + ", ('+Inf', cinf)) v(le, cnt)")
def q_latency(spark, sf):
    from txguard.operators.metrics import latency_histogram
    d = tx(spark, sf).select(((F.col("event_id") * 31 % 6000) / 1000.0).alias("duration"))
    return latency_histogram(d)
