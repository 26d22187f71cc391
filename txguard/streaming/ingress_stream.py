"""Ingress pipeline as a stream: validate -> defaults -> store PENDING -> publish.

Rejected requests go to an error table with per-field messages.  An id comes
from the request's position, micro-batch and row, so equal requests are stored
as two, and a replayed micro-batch gives the same ids and finds its batch
stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txguard.operators import mutations as mu
from txguard.operators.validate import INGRESS_COLUMNS, request_errors
from txguard.plans.fence import fence
from txguard.sources.message_log import publish
from txguard.sources.sinks import StoredTable, append


def parse_requests(raw: DataFrame) -> DataFrame:
    """``value``, typed request columns and ``errors`` (empty for a valid request)."""
    r = fence(raw.withColumn("payload", F.try_parse_json("value")), ["payload"])
    p = F.col("payload")
    typed = {c: F.try_variant_get(p, f"$.{c}", "string" if c == "userId" else "double") for c in INGRESS_COLUMNS}
    return r.withColumns({**typed, "errors": request_errors(p)}).drop("payload")


def ingest(batch: DataFrame, batch_id: int, transactions: str, rejects: str, topic: str) -> None:
    """Store one micro-batch of ``value`` rows and publish it to the message log ``topic``."""
    placed = batch.select("value").withColumn("_row", F.monotonically_increasing_id())
    req = parse_requests(placed).persist()
    try:
        valid = req.filter(F.size("errors") == 0).withColumn("_batch_no", F.lit(int(batch_id)))
        stored = mu.with_defaults(valid, id_from=["_batch_no", "_row", "value"]).drop("value", "errors", "_row", "_batch_no")
        StoredTable(batch.sparkSession, transactions).write_batch(stored, batch_id, "ingress")
        publish(mu.publish_json(stored.select("_id", *INGRESS_COLUMNS, "fraud_score", "status", "timestamp",
                                              "createdAt", "updatedAt")), topic, f"ingress-{batch_id}")
        append(req.filter(F.size("errors") > 0).select("value", "errors"), rejects, batch_id)
    finally:
        req.unpersist()


def start_ingress(spark: SparkSession, source: str, transactions: str, rejects: str, topic: str,
                  checkpoint: str, available_now: bool = False):
    raw = spark.readStream.format("text").load(source)

    def write(batch: DataFrame, batch_id: int) -> None:
        ingest(batch, batch_id, transactions, rejects, topic)

    w = raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()
