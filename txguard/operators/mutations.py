"""Set-based mutations: ingress defaults, upsert, review + audit, alerts, DLQ.

No row is updated in place: each operation returns the new version of the
affected rows (or the whole table as a lazy plan) and the caller appends it
to a stored table (sources.sinks.StoredTable).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txguard.schemas import DLQ_TOPIC, MAX_RETRIES, SOURCE_TOPIC

BROADCAST_ROWS = 1_000_000   # largest side we broadcast after counting it


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` only when it provably has <= max_rows rows.

    The check reads at most max_rows + 1 rows; above the bound the frame is
    returned as is and the join shuffles (AQE may still pick a broadcast
    from runtime sizes).
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def stable_uuid(*cols) -> Column:
    """Deterministic UUID-shaped id from row content (replays give the same id)."""
    h = F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("")) if isinstance(c, str)
                                       else F.coalesce(c.cast("string"), F.lit("")) for c in cols]), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4),
                       F.concat(F.lit("4"), F.substring(h, 14, 3)),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))


def with_defaults(df: DataFrame, id_from: list[str] | None = None, now: Column | None = None) -> DataFrame:
    """Insert defaults: _id (uuid), fraud_score -1, status PENDING, timestamp/createdAt/updatedAt now.

    ``id_from``: columns for a deterministic id (idempotent re-runs); without
    it a random uuid() is drawn, so materialise the result before reusing it.
    """
    now = F.current_timestamp() if now is None else now
    new_id = stable_uuid(*id_from) if id_from else F.expr("uuid()")
    cols = {
        "_id": F.coalesce(F.col("_id"), new_id) if "_id" in df.columns else new_id,
        "fraud_score": F.coalesce(F.col("fraud_score"), F.lit(-1.0)) if "fraud_score" in df.columns else F.lit(-1.0),
        "status": F.coalesce(F.col("status"), F.lit("PENDING")) if "status" in df.columns else F.lit("PENDING"),
        "reasoning": F.col("reasoning") if "reasoning" in df.columns else F.lit(None).cast("string"),
        "timestamp": F.coalesce(F.col("timestamp"), now) if "timestamp" in df.columns else now,
        "createdAt": now, "updatedAt": now,
    }
    return df.withColumns(cols)


def latest_per_key(df: DataFrame, key: str = "_id", version: list[str] | None = None) -> DataFrame:
    """Newest row per key by ``version`` columns (descending).

    A hash aggregate with ``max_by`` over a struct: partial aggregation on the
    map side keeps one row per key per partition, so repeated keys never pile
    up in one task.
    """
    version = version or ["_version"]
    payload = [c for c in df.columns if c != key]
    v = F.struct(*[F.col(c) for c in version])
    g = df.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in payload]), v).alias("_row"))
    return g.select(key, *[F.col(f"_row.{c}").alias(c) for c in payload])


def upsert(table: DataFrame, updates: DataFrame, key: str = "_id", version: str = "_version",
           preserve_review: DataFrame | None = None) -> DataFrame:
    """Insert-or-replace by key: the newest version of each key wins.

    ``table`` rows count as version -inf; among updates the highest
    ``version`` wins (a replayed batch resolves to one row).  Columns absent
    from updates keep the stored value (createdAt).  ``preserve_review``: a
    frame of ids with analyst decisions; those stored rows are not overwritten.
    """
    cols = table.columns
    upd_cols = [c for c in cols if c in updates.columns]
    u = updates.select(*upd_cols, F.col(version).cast("double").alias("_v"))
    t = table.select(*cols, F.lit(float("-inf")).alias("_v"))
    if preserve_review is not None:
        keep = preserve_review.select(F.col(preserve_review.columns[0]).alias(key)).distinct()
        u = u.join(keep, key, "left_anti")
    missing = [c for c in cols if c not in upd_cols]
    if missing:
        # carry stored values of columns the update does not set (e.g. createdAt)
        stored = table.select(key, *[F.col(c).alias(f"_old_{c}") for c in missing])
        u = u.join(stored, key, "left").withColumns(
            {c: F.col(f"_old_{c}") for c in missing}).drop(*[f"_old_{c}" for c in missing])
        u = u.select(*cols, "_v")
    both = t.unionByName(u)
    return latest_per_key(both, key, ["_v"]).select(*cols)


def review(tx: DataFrame, reviews: DataFrame, analyst: str, bulk: bool = True,
           now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Apply analyst decisions; return (updated table, audit rows).

    Bulk: unknown ids are ignored by the update but still audited, one audit
    row per requested id (duplicates kept).  Single: unknown id -> no audit.
    The request list is broadcast only after its size is checked.
    """
    now = F.current_timestamp() if now is None else now
    req = reviews.select(F.col("_id"), F.col("new_status"))
    # one decision per id; with several requests for an id the greatest status
    # text wins (deterministic; a single request carries one status anyway)
    dec = req.groupBy("_id").agg(F.max("new_status").alias("_new"))
    dec = bounded_broadcast(dec)
    updated = tx.join(dec, "_id", "left")
    if "updatedAt" in tx.columns:
        updated = updated.withColumn("updatedAt", F.when(F.col("_new").isNotNull(), now)
                                     .otherwise(F.col("updatedAt")))
    updated = updated.withColumn("status", F.coalesce(F.col("_new"), F.col("status"))).drop("_new")
    src = req if bulk else req.join(tx.select("_id"), "_id", "left_semi")
    text = "Analyst bulk marked transaction as " if bulk else "Analyst marked transaction as "
    audit = src.select(
        stable_uuid(F.col("_id"), F.col("new_status"), F.lit(analyst), F.monotonically_increasing_id()).alias("_id"),
        F.col("new_status").alias("action"), F.col("_id").alias("transactionId"),
        F.lit(analyst).alias("userId"), F.concat(F.lit(text), F.col("new_status")).alias("details"),
        now.alias("timestamp"))
    return updated, audit


def store_review(table, reviews: DataFrame, analyst: str, audit_path: str, batch_id: int, bulk: bool = True,
                 now: Column | None = None) -> None:
    """Apply decisions to a stored table: the affected rows as a batch of writer ``review``, and the audit rows."""
    from txguard.sources.sinks import append
    updated, audit = review(table.current(), reviews, analyst, bulk, now)
    touched = updated.join(reviews.select("_id").distinct(), "_id", "left_semi")
    table.write_batch(touched, batch_id, "review")
    append(audit, audit_path, batch_id)


def affected_count(tx: DataFrame, reviews: DataFrame) -> DataFrame:
    """Rows the update touches (0 -> not found for a single review)."""
    return tx.join(reviews.select("_id").distinct(), "_id", "left_semi").agg(F.count(F.lit(1)).alias("affected"))


def alerts_from(scored: DataFrame, now: Column | None = None) -> DataFrame:
    """One OPEN alert per FLAGGED row."""
    now = F.current_timestamp() if now is None else now
    return scored.filter(F.col("status") == "FLAGGED").select(
        stable_uuid(F.lit("alert"), F.col("_id")).alias("_id"), F.col("_id").alias("transactionId"),
        "userId", F.col("fraud_score").alias("score"), "reasoning", now.alias("timestamp"),
        F.lit("OPEN").alias("status"))


def dead_letters(invalid: DataFrame, value: str = "value", error: str = "error_message",
                 retry: str = "retry_count", topic: str = SOURCE_TOPIC, partition: Column | None = None,
                 offset: Column | None = None, now: Column | None = None) -> DataFrame:
    """DLQ envelope; the raw text is kept even when it is not valid JSON."""
    now = F.current_timestamp() if now is None else now
    env = F.struct(
        F.col(value).alias("originalMessage_raw"), F.try_parse_json(F.col(value)).alias("originalMessage"),
        F.struct(F.col(error).alias("message"), F.lit(None).cast("string").alias("stack")).alias("error"),
        F.struct(F.lit(topic).alias("originalTopic"),
                 (partition if partition is not None else F.lit(0)).alias("partition"),
                 (offset if offset is not None else F.lit(None).cast("string")).alias("offset"),
                 F.col(retry).alias("retryCount"),
                 F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("sentToDlqAt")).alias("metadata"))
    return invalid.select("*", env.alias("envelope"), F.lit(DLQ_TOPIC).alias("dlq_topic"))


def dead_letter_json(dead: DataFrame) -> DataFrame:
    """(key, value) rows for the dead-letter topic; a message that is JSON stays an object in the envelope."""
    e = F.col("envelope")
    body = F.coalesce(F.to_json(e["originalMessage"]), F.to_json(F.struct(e["originalMessage_raw"].alias("raw"))))
    rest = F.to_json(F.struct(e["error"].alias("error"), e["metadata"].alias("metadata")))
    return dead.select(F.lit(None).cast("string").alias("key"),
                       F.concat(F.lit('{"originalMessage":'), body, F.lit(","), F.substring(rest, F.lit(2), F.length(rest)))
                       .alias("value"), F.col("dlq_topic").alias("topic"))


def publish_json(df: DataFrame, key: str | None = None) -> DataFrame:
    """(key, value) rows for a message sink: value = JSON of the whole row."""
    cols = [c for c in df.columns]
    out = df.select(F.to_json(F.struct(*cols)).alias("value"), *([F.col(key).alias("key")] if key else []))
    return out


__all__ = ["bounded_broadcast", "stable_uuid", "with_defaults", "latest_per_key", "upsert", "review",
           "store_review", "affected_count", "alerts_from", "dead_letters", "publish_json", "MAX_RETRIES"]
