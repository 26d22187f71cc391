"""Skew-safe per-key sequence windows with a bounded look-back.

``Window.partitionBy(key)`` sends every row of a key to one task; a key that
holds a large share of the data (one card with a third of all rows) becomes
one straggler task that must buffer the whole key.  Window columns that look
back at most ``k`` rows (lag, rowsBetween(-k, 0) aggregates) do not need the
whole key in one place:

* light keys (<= ``hot_rows`` rows) use the plain partitioned window;
* hot keys get exact positions 1..n inside the key: a range exchange on
  (key, order...) splits a hot key over many partitions (the boundaries come
  from sampling, so the split follows the data), rows are sorted inside each
  partition and numbered per key in one pass; only the few keys that go on in
  another partition - fewer than partitions - have offsets to add, prefix-summed
  from counts and sent along as a broadcast, so no row is shuffled again;
* positions are cut into blocks of ``block_rows``; the last ``k`` rows of each
  block are copied into the next block as a halo; the window runs per
  (key, block) ordered by position, and the halo copies are dropped.

Results are identical to the plain window: every row sees exactly its ``k``
predecessors in the same order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txguard.session import ensure_checkpoint_dir

HOT_ROWS = 200_000      # keys above this many rows take the blocked path
BLOCK_ROWS = 100_000    # rows per block on the blocked path
LISTED_KEYS = 10_000    # so many hot keys are sent along as a list; more are joined by shuffle


def hot_keys(df: DataFrame, key: str, hot_rows: int) -> DataFrame:
    """Keys with more than ``hot_rows`` rows (partial aggregation; at most n/hot_rows keys)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows).select(key)


def split_hot(df: DataFrame, key: str, hot_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """(light rows, hot rows); hot rows is None when no key is hot.

    One action: the hot keys are counted from the key column alone.  A NULL key
    is a key like others.
    """
    keys = hot_keys(df.select(key), key, hot_rows)
    found = keys.limit(LISTED_KEYS + 1).collect()
    if not found:
        return df, None
    if len(found) <= LISTED_KEYS:
        keys = F.broadcast(df.sparkSession.createDataFrame(found, keys.schema))
    hot = keys.select(F.col(key).alias("_hot"))
    same = F.col(key).eqNullSafe(F.col("_hot"))
    return df.join(hot, same, "left_anti"), df.join(hot, same, "left_semi")


def positions(hot: DataFrame, key: str, order: list[str], partitions: int | None = None,
              out: str = "_g", counted: Column | None = None) -> DataFrame:
    """Exact 1-based position of each row inside its key, by ``order`` (must be unique per key).

    ``counted``: a condition; adds ``_c``, the number of rows up to this one that meet it.
    """
    spark = hot.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    r = hot.withColumn("_one", F.when(counted, 1).otherwise(0) if counted is not None else F.lit(0))
    r = (r.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order).withColumn("_pid", F.spark_partition_id()))
    schema = T.StructType([*r.schema.fields, T.StructField("_l", T.LongType()), T.StructField("_lc", T.LongType())])
    r = r.mapInArrow(lambda it: numbered(it, key, "_one"), schema).drop("_one")
    # The numbering is read twice (stats and rows).  Upstream shuffles make row
    # order nondeterministic, so two evaluations could sample different range
    # bounds; a reliable checkpoint (shared checkpoint folder) fixes one copy.
    ensure_checkpoint_dir(spark)
    r = r.checkpoint(eager=True)
    stats = r.groupBy("_pid", key).agg(F.max("_l").alias("_n0"), F.max("_lc").alias("_n1"))
    w = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = stats.select(F.col("_pid").alias("_opid"), F.col(key).alias("_okey"), F.sum("_n0").over(w).alias("_off"),
                        F.sum("_n1").over(w).alias("_offc")).filter("_off is not null")
    # ranges of (key, order): at most one key of each partition began in an earlier one
    res = r.join(F.broadcast(offs), (F.col("_pid") == F.col("_opid")) & F.col(key).eqNullSafe(F.col("_okey")), "left")
    res = res.withColumn(out, F.coalesce("_off", F.lit(0)) + F.col("_l"))
    if counted is not None:
        res = res.withColumn("_c", F.coalesce("_offc", F.lit(0)) + F.col("_lc"))
    return res.drop("_pid", "_l", "_lc", "_off", "_offc", "_opid", "_okey")


def numbered(batches: Iterator[pa.RecordBatch], key: str, one: str) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, with their place inside the key and the sum of ``one`` up to them."""
    current, place, ones = object(), 0, 0
    for batch in batches:
        places, sums = [], []
        for k, x in zip(batch.column(batch.schema.get_field_index(key)).to_pylist(),
                        batch.column(batch.schema.get_field_index(one)).to_pylist()):
            if k != current and (k == k or current == current):     # NaN is one key
                current, place, ones = k, 0, 0
            place += 1
            ones += x
            places.append(place)
            sums.append(ones)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64()), pa.array(sums, pa.int64())],
                                         names=[*batch.schema.names, "_l", "_lc"])


def blocked(hot_pos: DataFrame, lookback: int, block_rows: int) -> DataFrame:
    """Assign blocks; rows in the last ``lookback`` positions of a block also go to the next block."""
    if lookback >= block_rows:
        raise ValueError("block_rows must exceed the look-back")
    g0 = F.col("_g") - 1
    own = F.floor(g0 / block_rows).cast("bigint")
    tail = (g0 % block_rows) >= (block_rows - lookback)
    blocks = F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))
    return hot_pos.withColumn("_own", own).withColumn("_blk", F.explode(blocks))


def sequence_window(df: DataFrame, key: str, order: list[str], build: Callable[[WindowSpec], dict[str, Column]],
                    lookback: int, hot_rows: int = HOT_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``build(window)`` columns; every column may look back at most ``lookback`` rows."""
    light, hot = split_hot(df, key, hot_rows)
    w_light = Window.partitionBy(key).orderBy(*order)
    out_light = light.withColumns(build(w_light))
    if hot is None:
        return out_light
    hb = blocked(positions(hot, key, order), lookback, block_rows)
    w_hot = Window.partitionBy(key, "_blk").orderBy("_g")
    out_hot = hb.withColumns(build(w_hot)).filter(F.col("_own") == F.col("_blk")).drop("_own", "_blk", "_g")
    return out_light.unionByName(out_hot)
