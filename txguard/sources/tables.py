"""Readers for the driver tables and for raw card-transaction files."""

from __future__ import annotations

import csv
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from txguard.schemas import RAW_TRANSACTION_SCHEMA


def read_table(spark: SparkSession, sf_dir: str, name: str, cache: bool = True) -> DataFrame:
    """Parquet table ``name`` under ``sf_dir``.

    The reader (file listing + footer schema) is kept with its session, by path;
    the driver tables are immutable, so a cached reader cannot go stale.
    """
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    if not cache:
        return spark.read.parquet(path)
    readers = spark.__dict__.setdefault("_txguard_readers", {})
    if path not in readers:
        readers[path] = spark.read.parquet(path)
    return readers[path]


#: The file of a row and the place in it where the row's split begins.
_PLACE = ("_metadata.file_path AS _file", "_metadata.file_block_start AS _block")


def _headers(spark: SparkSession, paths: list[str]) -> list[tuple[str, list[str]]]:
    """(header line, its files) of all CSV files; a file without a line has none."""
    lines = spark.read.text(paths).select(*map(F.expr, _PLACE), "value", F.monotonically_increasing_id().alias("_at"))
    first = (lines.filter("_block = 0").groupBy("_file").agg(F.min_by("value", "_at").alias("header"))
             .groupBy("header").agg(F.sort_array(F.collect_list("_file")).alias("files")))
    return sorted((r["header"], r["files"]) for r in first.collect())


def read_raw_csv(spark: SparkSession, *paths: str) -> DataFrame:
    """Raw card transactions from CSV files with a header.

    Every file is read by its own header (files with equal headers together), so
    columns are taken by name in whatever order a file has them; others are
    ignored, and a column that a file does not have is NULL.  ``event_id`` is
    the row's place in all files, by path, then by split, then by line: dense,
    the same at every reading of the same files, and in file order, so it breaks
    ties of time as a stable sort of the files would.  A text that is no value
    of its column becomes NULL; ``read_raw_csv_strict`` keeps such rows apart.
    """
    return _numbered_csv(spark, paths).select("event_id", *RAW_TRANSACTION_SCHEMA.names)


def read_raw_csv_strict(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """As ``read_raw_csv``, but with the rows that are no transactions kept apart.

    A row is rejected if it has another number of values than its header, or a
    text that is no value of its column: ``event_id``, ``file``, ``reason`` and
    the ``record``.  Rejected rows keep their place in the numbering.
    """
    rows = _numbered_csv(spark, paths)
    bad = rows.filter("_reason is not null").select("event_id", F.col("_file").alias("file"), F.col("_reason").alias("reason"),
                                                    F.col("_text").alias("record"))
    return rows.filter("_reason is null").select("event_id", *RAW_TRANSACTION_SCHEMA.names), bad


def _numbered_csv(spark: SparkSession, paths: tuple[str, ...]) -> DataFrame:
    """Typed rows with ``event_id``, ``_file`` and, for rows that are no transactions, ``_reason`` and ``_text``."""
    raw = None
    for header, files in _headers(spark, list(paths)):
        names = next(csv.reader([header.removeprefix("\ufeff")]))
        read_as = StructType([*[StructField(f"c{k}", StringType()) for k in range(len(names))], StructField("_record", StringType())])
        rows = (spark.read.schema(read_as).option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE")
                .option("columnNameOfCorruptRecord", "_record").csv([unquote(f) for f in files]))       # paths come as escaped URIs
        at = {name.strip(): f"c{k}" for k, name in reversed(list(enumerate(names)))}
        cols, wrong = [], []
        for f in RAW_TRANSACTION_SCHEMA:
            text = F.col(at[f.name]) if f.name in at else F.lit(None).cast("string")
            value = text.try_cast(f.dataType)
            cols.append(value.alias(f.name))
            wrong.append(F.when(text.isNotNull() & value.isNull(), F.lit(f.name)))
        reason = F.when(F.col("_record").isNotNull(), "number of values").otherwise(
            F.concat(F.lit("no value of "), F.array_join(F.array_compact(F.array(*wrong)), ", ")))
        ok = F.col("_record").isNull() & (F.size(F.array_compact(F.array(*wrong))) == 0)
        record = F.coalesce("_record", F.concat_ws(",", *[F.coalesce(f"c{k}", F.lit("")) for k in range(len(names))]))
        part = rows.select(*map(F.expr, _PLACE), F.monotonically_increasing_id().alias("_at"), *cols, F.when(~ok, reason).alias("_reason"),
                           F.when(~ok, record).alias("_text"))
        raw = part if raw is None else raw.unionByName(part)
    if raw is None:
        raw = spark.createDataFrame([], StructType([StructField("_file", StringType()), StructField("_block", LongType()),
                                                    StructField("_at", LongType()), *RAW_TRANSACTION_SCHEMA.fields,
                                                    StructField("_reason", StringType()), StructField("_text", StringType())]))
    # one row per split: where its lines are numbered from
    splits = raw.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("_file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # so many rows as the driver lists splits to plan the scan
    return raw.join(F.broadcast(starts), ["_file", "_block"]).withColumn("event_id", F.col("_start") + F.col("_at") - F.col("_first"))


def union_sources(*frames: DataFrame) -> DataFrame:
    """Union all by column name; columns missing from a side become NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def normal_rows(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    """Keep rows labelled non-fraud (label = 0)."""
    return df.filter(F.col(label) == 0)
