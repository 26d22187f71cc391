"""Query-API registrations."""

from __future__ import annotations

from pyspark.sql import functions as F

from txguard.operators import queries as qy
from txguard.plans.registry import register
from txguard.sources import fixtures
from txguard.sources.tables import read_table


def fx(spark, sf):
    return fixtures.load(spark, sf)


def tx(spark, sf):
    return fx(spark, sf)["transactions"]


TX = "_id:s, userId:s, amount:d, status:s, fraud_score:d, createdAt:t"
TXSQL = "SELECT _id, userId, amount, status, fraud_score, createdAt FROM transactions"


@register("tx_by_status", TX, TXSQL + " WHERE status = 'FLAGGED'")
def q_by_status(spark, sf):
    return tx(spark, sf).filter(qy.status_is("FLAGGED"))


@register("tx_user_ilike", TX, TXSQL + " WHERE userId ILIKE '%user_1%'")
def q_ilike(spark, sf):
    return tx(spark, sf).filter(qy.user_ilike("user_1"))


@register("tx_amount_range", TX, TXSQL + " WHERE amount >= 20 AND amount <= 100")
def q_range(spark, sf):
    return tx(spark, sf).filter(qy.amount_between(20, 100))


@register("tx_filtered", TX, TXSQL + " WHERE userId ILIKE '%user_1%' AND status = 'FLAGGED' "
          "AND amount >= 10 AND amount <= 500")
def q_filtered(spark, sf):
    return tx(spark, sf).filter(qy.search_filter("user_1", "FLAGGED", "10", "500"))


@register("tx_by_id", TX, TXSQL + " WHERE _id = 'tx_42'")
def q_by_id(spark, sf):
    return qy.by_id(tx(spark, sf), "tx_42")


@register("tx_in_ids", TX, TXSQL + " WHERE _id IN (SELECT _id FROM reviews)")
def q_in_ids(spark, sf):
    f = fx(spark, sf)
    return qy.in_ids(f["transactions"], f["reviews"].select("_id"))


@register("tx_page", TX + ", pos:i",
          TXSQL.replace("SELECT ", "SELECT row_number() OVER (ORDER BY createdAt DESC, _id) AS pos, ")
          + " WHERE status = 'FLAGGED' ORDER BY createdAt DESC, _id LIMIT 20 OFFSET 20")
def q_page(spark, sf):
    rows, _ = qy.search(tx(spark, sf), status="FLAGGED", page=2, limit=20)
    # expose the rank so the order is part of the compared result
    from pyspark.sql import Window
    return rows.withColumn("pos", F.row_number().over(
        Window.orderBy(F.col("createdAt").desc(), F.col("_id"))) + 20)


DEEP_PAGE = 47


@register("tx_page_seek", TX, TXSQL + f" ORDER BY createdAt DESC, _id LIMIT 20 OFFSET {20 * (DEEP_PAGE - 1)}")
def q_page_seek(spark, sf):
    """A page far down, reached over the index of ranges of the page order."""
    t = tx(spark, sf)
    return qy.page_at(t, qy.page_index(t, 16), DEEP_PAGE, 20)


@register("tx_page_after", TX, TXSQL + " WHERE (createdAt, _id) IN (SELECT (createdAt, _id) FROM transactions ORDER BY createdAt DESC, _id "
          "LIMIT 20 OFFSET 20)")
def q_page_after(spark, sf):
    """The page behind the last row of the first one, found by that row's time and id."""
    t = tx(spark, sf)
    last = t.orderBy(*qy.newest_first()).limit(20).collect()[-1]
    return qy.page_after(t, last["createdAt"], last["_id"], 20)


@register("tx_page_info", "page:i, limit:i, total:i, pages:i",
          "SELECT 2 AS page, 20 AS \"limit\", count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages "
          "FROM transactions WHERE status = 'FLAGGED'")
def q_page_info(spark, sf):
    return qy.search(tx(spark, sf), status="FLAGGED", page=2, limit=20)[1]


@register("tx_status_counts", "status:s, count:i",
          "SELECT status, count(status) AS count FROM transactions GROUP BY status")
def q_status_counts(spark, sf):
    return qy.status_counts(tx(spark, sf))


@register("tx_stats", "total:i, flagged:i, blocked:i, cleared:i, pending:i",
          "SELECT count(status) AS total, count(*) FILTER (WHERE lower(status) = 'flagged') AS flagged, "
          "count(*) FILTER (WHERE lower(status) = 'blocked') AS blocked, "
          "count(*) FILTER (WHERE lower(status) = 'cleared') AS cleared, "
          "count(*) FILTER (WHERE lower(status) = 'pending') AS pending FROM transactions")
def q_stats(spark, sf):
    return qy.stats(tx(spark, sf))


@register("tx_flagged", TX, TXSQL + " WHERE status = 'FLAGGED' ORDER BY createdAt DESC, _id LIMIT 200")
def q_flagged(spark, sf):
    return qy.flagged(tx(spark, sf))


@register("flagged_badge", "flagged_count:i",
          "SELECT least(count(*), 200) AS flagged_count FROM transactions WHERE status = 'FLAGGED'")
def q_badge(spark, sf):
    return qy.flagged_badge(tx(spark, sf))


@register("alerts_recent", "_id:s, transactionId:s, userId:s, score:d, timestamp:t, status:s",
          "SELECT * FROM alerts ORDER BY timestamp DESC, _id LIMIT 20")
def q_alerts_recent(spark, sf):
    return qy.recent_alerts(fx(spark, sf)["alerts"])


@register("risk_series", "pos:i, time:s, amount:d, fraud_score:d",
          "SELECT row_number() OVER (ORDER BY createdAt, _id DESC) AS pos, strftime(createdAt, '%H:%M:%S') AS time, "
          "amount, fraud_score * 100 AS fraud_score FROM "
          "(SELECT * FROM transactions ORDER BY createdAt DESC, _id LIMIT 20) t")
def q_risk(spark, sf):
    return qy.risk_series(tx(spark, sf))


@register("live_feed", "_id:s, time:s, userId:s, amount_text:s, status:s, status_class:s",
          "SELECT _id, strftime(createdAt, '%H:%M:%S') AS time, userId, printf('$%.2f', amount) AS amount_text, "
          "status, CASE status WHEN 'CLEARED' THEN 'status-cleared' WHEN 'FLAGGED' THEN 'status-flagged' "
          "WHEN 'BLOCKED' THEN 'status-blocked' ELSE 'status-pending' END AS status_class "
          "FROM (SELECT * FROM transactions ORDER BY createdAt DESC, _id LIMIT 20) t")
def q_live(spark, sf):
    return qy.live_feed(tx(spark, sf))


@register("review_queue_rows", "_id:s, userId:s, amount_text:s, distance_from_home:d, channel:s, score_text:s",
          "SELECT _id, userId, printf('$%.2f', amount) AS amount_text, distance_from_home, "
          "CASE WHEN coalesce(online_order, 0) <> 0 THEN 'Online' ELSE 'In-Store' END AS channel, "
          "printf('%.1f%%', fraud_score * 100) AS score_text FROM transactions WHERE status = 'FLAGGED'")
def q_queue(spark, sf):
    return qy.queue_rows(tx(spark, sf))
