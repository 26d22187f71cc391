"""Online scoring consumer as Structured Streaming.

messages (Kafka, a message log, or JSON text files)
  -> strict validation (VARIANT)                      [row-local]
  -> valid:   keyed history state per userId          [shuffle by userId]
              -> foreachBatch: score, decide (threshold re-read per batch),
                 upsert transactions, append alerts and counters
  -> invalid: dead-letter envelopes (second query), as rows and, if wanted,
              as JSON in a message log

Every sink write belongs to a micro-batch, or to a part of one, and replaces or
finds its own folder, so a batch replayed after a failure adds nothing; the
checkpoint holds offsets and state.  Transient write failures are retried with
1 s, 2 s, 4 s back-off.  A batch that still fails is cut in two by a bit of the
hash of its ids, again and again, until the records that fail stand alone: these
become dead letters, all others are scored.  If the sinks refuse even an empty
batch, no record is at fault, and the whole batch goes to the dead letters.
"""

from __future__ import annotations

import threading
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupStateTimeout

from txguard.operators import mutations as mu
from txguard.operators import scoring as sc
from txguard.operators.metrics import histogram_rows, scored_counts
from txguard.operators.online import features_from_history
from txguard.operators.validate import NUMBER_FIELDS, STRING_FIELDS, validate_messages
from txguard.schemas import DEFAULT_THRESHOLD, EXPLAIN_UNAVAILABLE, HISTORY_CAP, LATENCY_BUCKETS, MAX_RETRIES, SOURCE_TOPIC
from txguard.sources.message_log import publish, register_message_log
from txguard.sources.sinks import WHOLE, StoredTable, append, exists, read_or_empty, remove
from txguard.streaming.state import HISTORY_SCHEMA, POSITION, STATE_SCHEMA, make_state_fn, output_schema

#: Wall clock of the executor, per row; Spark's current_timestamp is one value for a whole micro-batch.
NOW_MS = "CAST(java_method('java.lang.System', 'currentTimeMillis') AS BIGINT)"

COUNTER_SCHEMA = ("processed long, flagged long, model_errors long, "
                  + "".join(f"c{i} long, " for i in range(len(LATENCY_BUCKETS))) + "cinf long, total_sum double")


def read_messages(spark: SparkSession, source: str, fmt: str = "text", max_files: int | None = None,
                  kafka_options: dict | None = None, log_options: dict | None = None) -> DataFrame:
    """Message stream with a ``value`` string column and source position columns.

    ``text`` reads files of JSON lines, whose position is the file; ``log``
    reads a message log (``sources.message_log``) and ``kafka`` a topic, whose
    records have a partition and an offset.  Kafka starts at the latest record;
    a log does with ``log_options={"startingOffsets": "latest"}``.
    """
    if fmt == "kafka":
        opts = {"subscribe": SOURCE_TOPIC, "startingOffsets": "latest", **(kafka_options or {})}
        r = spark.readStream.format("kafka").options(**opts).load()
        return r.select(F.col("value").cast("string").alias("value"), "topic", "partition",
                        F.col("offset").cast("string").alias("offset"))
    if fmt == "log":
        register_message_log(spark)
        r = spark.readStream.format("message_log").options(path=source, **(log_options or {})).load()
        return r.select("value", F.lit(SOURCE_TOPIC).alias("topic"), "partition", F.col("offset").cast("string").alias("offset"))
    r = spark.readStream.format("text")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    r = r.load(source)
    return r.select("value", F.lit(SOURCE_TOPIC).alias("topic"), F.lit(0).alias("partition"),
                    F.col("_metadata.file_path").alias("offset"))


def stateful_features(valid: DataFrame, history: int = HISTORY_CAP, seeds: DataFrame | None = None) -> DataFrame:
    """Features of valid messages from the users' state; ``seeds`` (a stream of exported history) give it its start."""
    v = valid.withColumn("timestamp", F.coalesce(F.col("timestamp"), F.current_timestamp()))
    have = set(v.columns)
    position = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in POSITION]
    v = v.select(*STRING_FIELDS, *NUMBER_FIELDS, "timestamp", *position)
    if seeds is not None:
        v = v.unionByName(seeds.select("userId", *STATE_SCHEMA.fieldNames()), allowMissingColumns=True)
    rows = v.groupBy("userId").applyInPandasWithState(
        make_state_fn(history), output_schema(), STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)
    return features_from_history(rows)


def with_retry(fn, retries: int = MAX_RETRIES, base_delay: float = 1.0):
    for attempt in range(retries + 1):
        try:
            return fn()
        except Exception:  # noqa: BLE001 - retry any sink failure, then surface it
            if attempt == retries:
                raise
            time.sleep(base_delay * (2 ** attempt))


@dataclass
class Tables:
    transactions: str
    alerts: str
    counters: str
    dlq: str
    threshold: str | None = None      # parquet dir with a ``threshold`` column (optional)
    dlq_topic: str | None = None      # message log that gets all dead letters as JSON (optional)

    @property
    def failed(self) -> str:
        """Dead letters of records that failed after the last retry."""
        return f"{self.dlq.rstrip('/')}_failed"


def read_threshold(spark: SparkSession, path: str | None) -> DataFrame:
    """The threshold in force; the default only where none was ever written (a failed read is an error)."""
    cfg = spark.createDataFrame([], "threshold double")
    if path and exists(spark, path):
        cfg = spark.read.parquet(path)
    return sc.effective_threshold(cfg, DEFAULT_THRESHOLD)


class BatchWriter:
    """``foreachBatch`` function of the scoring stream."""

    TX_COLS = ["_id", "userId", "amount", "timestamp", "lat", "lon", "distance_from_home", "repeat_retailer",
               "used_chip", "used_pin_number", "online_order", "fraud_score", "status", "reasoning"]

    def __init__(self, tables: Tables, scaler, weights, supervised, retry_delay: float = 1.0):
        if weights is None or supervised is None:
            raise ValueError("the scoring stream needs a trained model")
        self.tables, self.retry_delay = tables, retry_delay
        self.model = (scaler, weights, supervised)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            if self._was_cut(batch.sparkSession, batch_id):         # an earlier attempt ended while it cut the batch
                self._forget(batch.sparkSession, batch_id)
            try:
                with_retry(lambda: self.store(batch, batch_id), base_delay=self.retry_delay)
            except Exception as e:  # noqa: BLE001 - after the last retry the failing records are looked for
                self._isolate(batch, batch_id, e)
        finally:
            batch.unpersist()

    def store(self, batch: DataFrame, batch_id: int, part: str = WHOLE) -> None:
        """Score some rows of a micro-batch and write them to all sinks."""
        spark, t = batch.sparkSession, self.tables
        thr = read_threshold(spark, t.threshold)                       # live threshold (T8)
        scored = sc.score_rows(batch, *self.model, thr)
        flagged = F.col("status") == "FLAGGED"
        explained = F.when(flagged, F.concat("reasoning", F.lit(EXPLAIN_UNAVAILABLE))).otherwise(F.col("reasoning"))
        scored = scored.withColumn("reasoning", explained)
        if "read_ms" in scored.columns:
            scored = scored.withColumn("_seconds", (F.expr(NOW_MS) - F.col("read_ms")) / 1000.0)
        else:
            scored = scored.withColumn("_seconds", F.lit(None).cast("double"))
        scored = scored.persist()
        try:
            now = F.current_timestamp()
            # readers keep the earliest createdAt of a key, so a row that ingress stored first keeps its own
            txs = scored.select(*self.TX_COLS).withColumns({"createdAt": now, "updatedAt": now})
            StoredTable(spark, t.transactions).write_batch(txs, batch_id, "scoring", part)
            append(mu.alerts_from(scored), t.alerts, batch_id, part)
            append(scored.agg(*scored_counts(F.col("_seconds"))), t.counters, batch_id, part)
        finally:
            scored.unpersist()

    def _folders(self, spark: SparkSession, batch_id: int, part: str | None = None) -> list[str]:
        t, tail = self.tables, "" if part is None else f"/_part={part}"
        plain = [f"{p.rstrip('/')}/_batch={int(batch_id)}{tail}" for p in (t.alerts, t.counters, t.failed)]
        return [StoredTable(spark, t.transactions).folder("scoring", batch_id, part), *plain]

    def _was_cut(self, spark: SparkSession, batch_id: int) -> bool:
        """Whether some parts of the batch were stored or given up without the mark of the last one."""
        return (not exists(spark, f"{self._folders(spark, batch_id, WHOLE)[0]}/_SUCCESS")
                and any(exists(spark, f) for f in self._folders(spark, batch_id)))

    def _forget(self, spark: SparkSession, batch_id: int, part: str | None = None) -> None:
        for folder in self._folders(spark, batch_id, part):
            remove(spark, folder)

    def _isolate(self, batch: DataFrame, batch_id: int, error: Exception) -> None:
        """Store every record that can be stored; part ``b-v`` holds the ids whose hash ends in the b bits of v."""
        spark = batch.sparkSession
        self._forget(spark, batch_id)
        try:
            self.store(batch.limit(0), batch_id, "none")
        except Exception as e:  # noqa: BLE001 - no record is at fault
            self._forget(spark, batch_id)
            self._give_up(batch, batch_id, WHOLE, e)
            return
        self._forget(spark, batch_id, "none")
        todo = [(0, 0, error)]
        while todo:
            bits, value, error = todo.pop()
            rows = batch.filter(F.xxhash64("_id").bitwiseAND(F.lit((1 << bits) - 1)) == F.lit(value))
            ids = rows.select("_id").distinct().limit(2).count()
            part = f"{bits}-{value}"
            if not ids:
                continue
            if bits:
                try:
                    self.store(rows, batch_id, part)
                    continue
                except Exception as e:  # noqa: BLE001 - some record in this part fails
                    self._forget(spark, batch_id, part)
                    error = e
            if ids == 1 or bits == 62:
                self._give_up(rows, batch_id, part, error)
            else:
                todo += [(bits + 1, value, error), (bits + 1, value | 1 << bits, error)]

    def _give_up(self, rows: DataFrame, batch_id: int, part: str, error: Exception) -> None:
        message = F.to_json(F.struct(*STRING_FIELDS, *NUMBER_FIELDS, "timestamp"))
        failed = rows.withColumns({"value": message, "error_message": F.lit(str(error)[:500]), "retry_count": F.lit(MAX_RETRIES)})
        where = {c: F.col(c) for c in ("partition", "offset") if c in rows.columns}
        bury(mu.dead_letters(failed, **where), self.tables.failed, self.tables.dlq_topic, batch_id, part, "failed")


def bury(dead: DataFrame, path: str, topic: str | None, batch_id: int, part: str, name: str) -> None:
    """Write dead letters of a micro-batch, as rows and as JSON messages."""
    if topic:
        publish(mu.dead_letter_json(dead), topic, f"{name}-{int(batch_id)}-{part}")
    append(dead.select("envelope", "dlq_topic"), path, batch_id, part)


def make_batch_writer(tables: Tables, scaler, weights, supervised, retry_delay: float = 1.0) -> BatchWriter:
    return BatchWriter(tables, scaler, weights, supervised, retry_delay)


class MessageCounts(StreamingQueryListener):
    """Messages read and found valid by the scoring query, as observed on the stream, each micro-batch once."""

    NAME = "messages"

    def __init__(self):
        self._lock = threading.Lock()
        self._seen: dict[str, int] = {}            # last batch counted, by query
        self.read = self.valid = 0

    @staticmethod
    def observe(messages: DataFrame) -> DataFrame:
        return messages.observe(MessageCounts.NAME, F.count(F.lit(1)).alias("read"), F.count(F.when(F.col("valid"), 1)).alias("valid"))

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = p.observedMetrics.get(self.NAME)
        if row is None:
            return
        with self._lock:
            if p.batchId > self._seen.get(str(p.id), -1):
                self._seen[str(p.id)] = p.batchId
                self.read += row["read"]
                self.valid += row["valid"]


@dataclass
class ScoringJob:
    scoring: object
    dead_letters: object
    messages: MessageCounts = field(default_factory=MessageCounts)

    def process_all(self):
        self.scoring.processAllAvailable()
        self.dead_letters.processAllAvailable()

    def stop(self):
        self.scoring.stop()
        self.dead_letters.stop()


def start_scoring(spark: SparkSession, source: str, tables: Tables, checkpoint: str, fmt: str = "text",
                  history: int = HISTORY_CAP, *, weights, supervised, scaler=None,
                  available_now: bool = False, max_files: int | None = None, seeds: str | None = None,
                  kafka_options: dict | None = None, log_options: dict | None = None, retry_delay: float = 1.0) -> ScoringJob:
    """Start both queries.  ``seeds`` is a history written by ``export_history``.

    A checkpoint made with seeds has to be restarted with them (they are one of
    its sources); they are read once, in its first micro-batch.
    """
    def messages() -> DataFrame:
        read = read_messages(spark, source, fmt, max_files, kafka_options, log_options)
        return validate_messages(read.withColumn("read_ms", F.expr(NOW_MS)))

    history_rows = None if seeds is None else spark.readStream.schema(HISTORY_SCHEMA).parquet(seeds)
    counts = MessageCounts()
    spark.streams.addListener(counts)
    feats = stateful_features(MessageCounts.observe(messages()).filter("valid"), history, history_rows)
    w = feats.writeStream.foreachBatch(make_batch_writer(tables, scaler, weights, supervised, retry_delay)) \
        .option("checkpointLocation", f"{checkpoint.rstrip('/')}/scoring")

    def write_dead(batch: DataFrame, batch_id: int) -> None:
        dead = mu.dead_letters(batch, partition=F.col("partition"), offset=F.col("offset"), topic=SOURCE_TOPIC).persist()
        try:
            bury(dead, tables.dlq, tables.dlq_topic, batch_id, WHOLE, "invalid")
        finally:
            dead.unpersist()

    d = messages().filter(~F.col("valid")).writeStream.foreachBatch(write_dead) \
        .option("checkpointLocation", f"{checkpoint.rstrip('/')}/dlq")
    if available_now:
        w, d = w.trigger(availableNow=True), d.trigger(availableNow=True)
    return ScoringJob(w.start(), d.start(), counts)


def dead_letter_rows(spark: SparkSession, tables: Tables) -> DataFrame:
    """``envelope, dlq_topic`` of all dead letters: records that were invalid, and those that failed in the end."""
    blank = spark.createDataFrame([], "value string, error_message string, retry_count int")
    schema = mu.dead_letters(blank, offset=F.lit("")).select("envelope", "dlq_topic").schema
    parts = [read_or_empty(spark, path, schema) for path in (tables.dlq, tables.failed)]
    return parts[0].select(*schema.names).unionByName(parts[1].select(*schema.names))


def stream_counters(spark: SparkSession, tables: Tables) -> DataFrame:
    """A13 over the sinks: processed, flagged, model errors (counters) and all dead letters."""
    c = read_or_empty(spark, tables.counters, COUNTER_SCHEMA).agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("processed", "flagged", "model_errors")])
    return c.crossJoin(dead_letter_rows(spark, tables).agg(F.count(F.lit(1)).alias("dlq")))


def stream_latency(spark: SparkSession, tables: Tables) -> DataFrame:
    """A14 over the sinks: histogram of the seconds from reading a record to its score, one value per record."""
    names = [*[f"c{i}" for i in range(len(LATENCY_BUCKETS))], "cinf", "total_sum"]
    total = read_or_empty(spark, tables.counters, COUNTER_SCHEMA).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
    return histogram_rows(total)
