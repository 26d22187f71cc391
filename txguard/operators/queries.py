"""Analyst query API over the transaction and alert tables.

Every function returns a lazy DataFrame; filters are plain Column predicates,
so Catalyst pushes them into the parquet scan, and every bounded result is an
ORDER BY ... LIMIT that plans as a per-partition top-k (TakeOrderedAndProject).
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txguard.schemas import (ALERTS_DEFAULT, ALERTS_MAX, FLAGGED_LIMIT, PAGE_DEFAULT, PAGE_MAX)


def newest_first() -> list[Column]:
    return [F.col("createdAt").desc(), F.col("_id").asc()]


def _int_or(value, default: int) -> int:
    """``parseInt(x) || default``: missing, unparsable or 0 -> default."""
    try:
        v = int(str(value).strip().split(".")[0]) if value is not None and str(value).strip() else 0
    except ValueError:
        v = 0
    return v or default


def page_params(page=None, limit=None) -> tuple[int, int]:
    p = max(1, _int_or(page, 1))
    n = min(max(1, _int_or(limit, PAGE_DEFAULT)), PAGE_MAX)
    return p, n


def status_is(status: str) -> Column:
    return F.col("status") == F.lit(status)


def user_ilike(fragment: str) -> Column:
    """Case-insensitive substring match; % and _ in the input stay wildcards."""
    return F.col("userId").ilike(f"%{fragment}%")


def amount_between(min_amount=None, max_amount=None) -> Column | None:
    preds = []
    if min_amount not in (None, ""):
        preds.append(F.col("amount") >= F.lit(float(min_amount)))
    if max_amount not in (None, ""):
        preds.append(F.col("amount") <= F.lit(float(max_amount)))
    return reduce(and_, preds) if preds else None


def search_filter(user_id=None, status=None, min_amount=None, max_amount=None) -> Column:
    """Conjunction of the optional filters; no filter -> TRUE.  'ALL' = any status."""
    preds = []
    if user_id:
        preds.append(user_ilike(user_id))
    if status and status != "ALL":
        preds.append(status_is(status))
    amt = amount_between(min_amount, max_amount)
    if amt is not None:
        preds.append(amt)
    return reduce(and_, preds) if preds else F.lit(True)


def search(tx: DataFrame, user_id=None, status=None, min_amount=None, max_amount=None,
           page=None, limit=None) -> tuple[DataFrame, DataFrame]:
    """Filtered, newest-first page plus a one-row page_info (page, limit, total, pages)."""
    p, n = page_params(page, limit)
    filtered = tx.filter(search_filter(user_id, status, min_amount, max_amount))
    rows = filtered.orderBy(*newest_first()).offset((p - 1) * n).limit(n)
    info = filtered.agg(F.count(F.lit(1)).alias("total")).select(
        F.lit(p).cast("bigint").alias("page"), F.lit(n).cast("bigint").alias("limit"), "total",
        F.ceil(F.col("total") / F.lit(n)).cast("bigint").alias("pages"))
    return rows, info


def _place() -> list[Column]:
    """The page order as three ascending keys: missing times last, newest first, then the id."""
    return [F.col("createdAt").isNull().alias("late"), (-F.unix_micros(F.col("createdAt").cast("timestamp"))).alias("age"),
            F.col("_id").alias("id")]


def page_after(tx: DataFrame, created_at=None, id_: str | None = None, limit=None) -> DataFrame:
    """The page behind the row with this time and id, or the first one: a filter and a top-n, however far down it is."""
    _, n = page_params(1, limit)
    if id_ is None:
        return newest(tx, n)
    later = F.col("_id") > F.lit(id_)
    if created_at is None:
        return newest(tx.filter(F.col("createdAt").isNull() & later), n)
    t = F.lit(created_at)
    return newest(tx.filter((F.col("createdAt") < t) | ((F.col("createdAt") == t) & later) | F.col("createdAt").isNull()), n)


def page_index(tx: DataFrame, ranges: int = 1000) -> DataFrame:
    """One row per range of the page order: how many rows are before it (``start``) and in it (``n``), its first and last place.

    The ranges are those of a range exchange of time and id, so rows of one time
    are cut as well.  Keep the index as a table beside ``tx`` and make it anew
    when ``tx`` changes.
    """
    keys = tx.select(*_place()).repartitionByRange(ranges, "late", "age", "id")
    place = F.struct("late", "age", "id")
    r = keys.groupBy(F.spark_partition_id().alias("range")).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"),
                                                               F.max(place).alias("last"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)           # ``ranges`` rows
    return r.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), "n", "first", "last")


def page_at(tx: DataFrame, index: DataFrame, page=None, limit=None) -> DataFrame:
    """Page ``page`` of all rows by reading only the ranges it lies in; the same rows as with an offset."""
    p, n = page_params(page, limit)
    offset = (p - 1) * n
    hit = index.filter((F.col("start") < offset + n) & (F.col("start") + F.col("n") > offset)).orderBy("range").collect()
    if not hit:
        return tx.limit(0)
    first, last = hit[0]["first"], hit[-1]["last"]
    late, age, id_ = _place()
    place = F.struct(late, age, id_)

    def literal(k):
        return F.struct(F.lit(k["late"]).alias("late"), F.lit(k["age"]).cast("bigint").alias("age"), F.lit(k["id"]).alias("id"))

    rows = tx.filter((place >= literal(first)) & (place <= literal(last)))
    # the same bounds on the stored column, which the scan can use to skip files and row groups
    kind = tx.schema["createdAt"].dataType
    if not last["late"]:
        oldest, newest_ = (F.timestamp_micros(F.lit(-k["age"])).cast(kind) for k in (last, first))
        rows = rows.filter(F.col("createdAt").between(oldest, newest_))
    return rows.orderBy(*newest_first()).offset(offset - hit[0]["start"]).limit(n)


def by_id(tx: DataFrame, id_: str) -> DataFrame:
    """Point lookup; an empty result means not found."""
    return tx.filter(F.col("_id") == F.lit(id_))


def in_ids(tx: DataFrame, ids, key: str = "_id") -> DataFrame:
    """Rows whose id is in ``ids`` (a short Python list or a DataFrame of ids)."""
    if isinstance(ids, DataFrame):
        return tx.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_semi")
    return tx.filter(F.col(key).isin(list(ids)))


def status_counts(tx: DataFrame) -> DataFrame:
    """COUNT(status) GROUP BY status — a NULL status group counts 0."""
    return tx.groupBy("status").agg(F.count("status").alias("count"))


def stats(tx: DataFrame) -> DataFrame:
    """One row {total, flagged, blocked, cleared, pending} in one aggregation pass."""
    s = F.lower(F.col("status"))

    def n(key):
        return F.count(F.when(s == key, 1)).alias(key)

    return tx.agg(F.count("status").alias("total"), n("flagged"), n("blocked"), n("cleared"), n("pending"))


def flagged(tx: DataFrame, limit: int = FLAGGED_LIMIT) -> DataFrame:
    return tx.filter(status_is("FLAGGED")).orderBy(*newest_first()).limit(limit)


def flagged_badge(tx: DataFrame, limit: int = FLAGGED_LIMIT) -> DataFrame:
    """The console badge shows the length of the flagged list, so at most ``limit``."""
    return tx.filter(status_is("FLAGGED")).agg(
        F.least(F.count(F.lit(1)), F.lit(limit).cast("bigint")).alias("flagged_count"))


def alerts_limit(limit=None) -> int:
    n = min(_int_or(limit, ALERTS_DEFAULT), ALERTS_MAX)
    if n < 1:
        raise ValueError("limit must be >= 1")
    return n


def recent_alerts(alerts: DataFrame, limit=None) -> DataFrame:
    return alerts.orderBy(F.col("timestamp").desc(), F.col("_id").asc()).limit(alerts_limit(limit))


def status_class(status: Column | str = "status") -> Column:
    s = F.col(status) if isinstance(status, str) else status
    return (F.when(s == "CLEARED", "status-cleared").when(s == "FLAGGED", "status-flagged")
             .when(s == "BLOCKED", "status-blocked").otherwise("status-pending"))


def newest(tx: DataFrame, n: int = PAGE_DEFAULT) -> DataFrame:
    return tx.orderBy(*newest_first()).limit(n)


def risk_series(tx: DataFrame, n: int = PAGE_DEFAULT) -> DataFrame:
    """Chart rows: newest n, in ascending time, with fraud_score in percent."""
    top = newest(tx, n)
    w = Window.orderBy(F.col("createdAt").asc(), F.col("_id").desc())  # over n rows only
    return top.select(F.row_number().over(w).alias("pos"),
                      F.date_format("createdAt", "HH:mm:ss").alias("time"), "amount",
                      (F.col("fraud_score") * 100).alias("fraud_score"))


def live_feed(tx: DataFrame, n: int = PAGE_DEFAULT) -> DataFrame:
    return newest(tx, n).select(
        "_id", F.date_format("createdAt", "HH:mm:ss").alias("time"), "userId",
        F.format_string("$%.2f", "amount").alias("amount_text"), "status",
        status_class().alias("status_class"))


def queue_rows(tx: DataFrame, status: str = "FLAGGED") -> DataFrame:
    """Review-queue cards: amount text, channel label, score in percent (1 decimal)."""
    return tx.filter(status_is(status)).select(
        "_id", "userId", F.format_string("$%.2f", "amount").alias("amount_text"),
        "distance_from_home",
        F.when(F.coalesce(F.col("online_order"), F.lit(0.0)) != 0, "Online").otherwise("In-Store")
        .alias("channel"),
        F.format_string("%.1f%%", F.col("fraud_score") * 100).alias("score_text"))
