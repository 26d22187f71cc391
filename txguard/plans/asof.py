"""As-of join without a key: each left row gets the newest right row at or before its time.

One time line has no key to deal rows out by, so it is cut at quantiles of the
left times.  Inside a piece a window passes the last right row on; what is in
force when a piece begins is the newest right row of the pieces before, a table
with one row per piece.  A piece with very many rows of one time, or between two
right rows, is dealt out further by a salt, and its right rows go to every salt:
no task gets a whole interval, however long it is or how many rows it holds.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_PIECE = 1_000_000
MAX_PIECES = 10_000
SALTS = 8


def as_of(left: DataFrame, right: DataFrame, time: str, at: str, value: str, name: str, order: list[str] | None = None,
          rows_per_piece: int = ROWS_PER_PIECE, salts: int = SALTS) -> DataFrame:
    """``left`` with the column ``name``: ``value`` of the newest row of ``right`` with ``at`` <= ``time``.

    NULL where there is none, where the time is NULL, and where that row's value
    is NULL.  Of right rows with equal times the last by ``order`` counts (else
    the greatest value); right rows without a time never do.  Every left row
    stays, in any number of copies.
    """
    def micros(c: str):
        return F.unix_micros(F.col(c).cast("timestamp"))

    marks = right.filter(F.col(at).isNotNull()).groupBy(micros(at).alias("_t")).agg(
        F.max_by(F.struct(F.col(value).alias("v")), F.struct(*(order or [value]))).alias("_v"))
    rows = left.select(F.struct(*left.columns).alias("_row"), micros(time).alias("_t"))
    n = rows.count()
    pieces = min(MAX_PIECES, max(1, -(-n // rows_per_piece)))
    cuts = []
    if pieces > 1:
        shares = [k / pieces for k in range(1, pieces)]
        cuts = sorted(set(rows.agg(F.percentile_approx("_t", shares, 10 * pieces)).first()[0] or []))

    def placed(df: DataFrame) -> DataFrame:
        if not cuts:
            return df.withColumn("_p", F.lit(0.0))
        cut = Bucketizer(splits=[float("-inf"), *map(float, cuts), float("inf")], inputCol="_x", outputCol="_p", handleInvalid="keep")
        return cut.transform(df.withColumn("_x", F.coalesce(F.col("_t").cast("double"), F.lit(float("-inf"))))).drop("_x")

    marks = placed(marks)
    last = marks.groupBy("_p").agg(F.max_by("_v", "_t").alias("_v"))
    every = left.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("double").alias("_p"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)          # one row per piece
    carried = every.join(last, "_p", "left").select("_p", F.last("_v", ignorenulls=True).over(before).alias("_c"))
    mine = placed(rows).withColumn("_s", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    copies = marks.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # a mark comes before the rows of its own time
    line = mine.withColumn("_side", F.lit(1)).unionByName(copies.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    so_far = Window.partitionBy("_p", "_s").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    filled = line.withColumn("_f", F.last("_v", ignorenulls=True).over(so_far)).filter("_side = 1")
    found = F.when(F.col("_t").isNotNull(), F.coalesce("_f", "_c")["v"])
    return filled.join(F.broadcast(carried), "_p").select("_row.*", found.alias(name))
