"""Sinks: stored batches of rows and append tables; messages go to ``message_log``.

Everything is Parquet in partition folders that Spark itself writes,
commits, discovers and prunes.  A ``StoredTable`` keeps what several writers
stored, partitioned by writer, batch and part; its current rows are one
aggregation over them, which ``publish`` writes partitioned by status for
readers that want few rows.  A batch belongs to its writer and is written once:
a replayed batch finds itself stored, so replays change nothing and writers
never touch each other's folders.  The newest version of a key is the one with
the latest ``updatedAt`` (then writer, batch, part, row); ``createdAt`` is the
earliest of all its versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

WHOLE = "all"                                  # the part of a batch that was not cut
VERSION = ["_at", "_writer", "_batch", "_part", "_seq"]


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _folder(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a batch's folder, if there is one."""
    fs, p = _folder(spark, path)
    fs.delete(p, True)


def read_or_empty(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The rows under ``path``; none where nothing was ever written (a failed read is an error)."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


class StoredTable:
    def __init__(self, spark: SparkSession, path: str, key: str = "_id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def folder(self, writer: str, batch_id: int, part: str | None = None) -> str:
        batch = f"{self.path}/_writer={writer}/_batch={int(batch_id)}"
        return batch if part is None else f"{batch}/_part={part}"

    def write_batch(self, df: DataFrame, batch_id: int, writer: str = "main", part: str = WHOLE) -> bool:
        """Store a batch, or a part of one; False if it is stored already (a replay)."""
        folder = self.folder(writer, batch_id, part)
        if exists(self.spark, f"{folder}/_SUCCESS"):
            return False
        df.withColumn("_seq", F.monotonically_increasing_id()).write.mode("overwrite").parquet(folder)
        return True

    def log(self) -> DataFrame:
        """Rows of all batches, with their writer, batch and part; a column that a writer does not have is NULL."""
        if not exists(self.spark, self.path):
            raise ValueError(f"{self.path} holds no batch")
        rows = self.spark.read.option("mergeSchema", True).parquet(self.path)
        return rows.withColumns({"_batch": F.col("_batch").cast("bigint"), "_part": F.col("_part").cast("string"),
                                 "_writer": F.col("_writer").cast("string")})

    def current(self) -> DataFrame:
        """One row per key, the newest version, by a partially aggregated maximum."""
        rows = self.log()
        at = F.col("updatedAt") if "updatedAt" in rows.columns else F.lit(None).cast("timestamp")
        rows = rows.withColumn("_at", at)
        cols = [c for c in rows.columns if c != self.key and c not in VERSION]
        aggs = [F.max_by(F.struct(*cols), F.struct(*VERSION)).alias("_row")]
        if "createdAt" in cols:
            aggs.append(F.min("createdAt").alias("_first"))
        newest = rows.groupBy(self.key).agg(*aggs)
        return newest.select(self.key, *[F.col("_first").alias(c) if c == "createdAt" else F.col(f"_row.{c}").alias(c) for c in cols])

    def publish(self, path: str) -> DataFrame:
        """Write the current rows to ``path``, partitioned by status, and read them back.

        A filter on status then reads that status' folder and shuffles nothing.
        Publish to a new path each time, so that readers of the last one go on.
        """
        self.current().write.mode("overwrite").partitionBy("status").parquet(path)
        return self.spark.read.parquet(path)


def append(df: DataFrame, path: str, batch_id: int | None = None, part: str = WHOLE) -> None:
    """Append rows; with a batch id the part's own folder is replaced (idempotent)."""
    if batch_id is None:
        df.write.mode("append").parquet(path)
    else:
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/_batch={int(batch_id)}/_part={part}")
