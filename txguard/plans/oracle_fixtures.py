"""DuckDB text of the fixture tables (see FIXTURES.md), as CTEs."""

CARD_TX = """
SELECT event_id, cc_num, trans_date_trans_time, amt, k, merchant, category, lat, long,
       lat + ((k * 17) % 100 - 50) / 50.0e0 AS merch_lat,
       long + CASE WHEN k % 10 = 9 THEN 20.0e0 ELSE ((k * 31) % 100 - 50) / 50.0e0 END AS merch_long,
       is_fraud
FROM (
  SELECT event_id, user_id AS cc_num, ts AS trans_date_trans_time, value AS amt, k,
         CASE WHEN k % 5 = 0 THEN 'ChipMart_' ELSE 'merchant_' END || CAST(k % 20 AS VARCHAR) AS merchant,
         CASE event_type WHEN 'purchase' THEN 'shopping_pos' WHEN 'click' THEN 'shopping_net'
              WHEN 'view' THEN 'travel' WHEN 'signup' THEN 'Online_services' ELSE 'grocery_POS' END AS category,
         25.0e0 + (user_id * 37 % 240) / 10.0e0 AS lat,
         -120.0e0 + (user_id * 53 % 500) / 10.0e0 AS long,
         CASE WHEN event_type = 'error' AND value > 20 THEN 1 ELSE 0 END AS is_fraud
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) e0
) e1
"""

TRANSACTIONS = """
SELECT _id, event_id, userId, amount, timestamp, lat, lon, distance_from_home,
       repeat_retailer, used_chip, used_pin_number, online_order,
       CASE WHEN status = 'PENDING' THEN -1.0e0 ELSE s END AS fraud_score, status, createdAt
FROM (
  SELECT *, CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 10 = 1 THEN 'PENDING'
                 WHEN s > 0.6e0 AND event_id % 3 = 0 THEN 'BLOCKED'
                 WHEN s > 0.6e0 THEN 'FLAGGED' ELSE 'CLEARED' END AS status
  FROM (
    SELECT 'tx_' || CAST(event_id AS VARCHAR) AS _id, event_id, 'User_' || CAST(cc_num AS VARCHAR) AS userId,
           amt AS amount, trans_date_trans_time AS timestamp, trans_date_trans_time AS createdAt,
           merch_lat AS lat, merch_long AS lon,
           2.0e0 * 6371 * asin(sqrt(least(1.0e0,
             pow(sin(radians(merch_lat - lat) / 2), 2) +
             cos(radians(lat)) * cos(radians(merch_lat)) * pow(sin(radians(merch_long - long) / 2), 2)))) AS distance_from_home,
           CASE WHEN row_number() OVER (PARTITION BY cc_num, merchant ORDER BY trans_date_trans_time, event_id) > 1
                THEN 1.0e0 ELSE 0.0e0 END AS repeat_retailer,
           CASE WHEN lower(merchant) LIKE '%chip%' THEN 1.0e0 ELSE 0.0e0 END AS used_chip,
           CASE WHEN lower(category) LIKE '%pos%' THEN 1.0e0 ELSE 0.0e0 END AS used_pin_number,
           CASE WHEN lower(category) LIKE '%net%' OR lower(category) LIKE '%online%' THEN 1.0e0 ELSE 0.0e0 END AS online_order,
           (event_id * 7919 % 1000) / 1000.0e0 AS s
    FROM card_tx
  ) t0
) t1
"""

REVIEWS = """
SELECT _id, CASE WHEN event_id % 8 = 0 THEN 'BLOCKED' ELSE 'CLEARED' END AS new_status
FROM transactions WHERE status = 'FLAGGED'
UNION ALL SELECT 'tx_missing' AS _id, 'CLEARED' AS new_status
"""

ALERTS = """
SELECT 'al_' || CAST(event_id AS VARCHAR) AS _id, _id AS transactionId, userId, fraud_score AS score,
       timestamp, 'OPEN' AS status
FROM transactions WHERE status = 'FLAGGED'
"""

EVAL_SCORES = """
SELECT event_id, is_fraud AS y_true, (event_id * 104729 % 4000) / 1000.0e0 + is_fraud AS mse FROM card_tx
"""

INGRESS_RAW = """
SELECT event_id, CASE WHEN event_id % 101 = 0 THEN '' ELSE userId END AS userId,
       CASE WHEN event_id % 97 = 0 THEN -amount ELSE amount END AS amount,
       CASE WHEN event_id % 89 = 0 THEN 91.0e0 ELSE lat END AS lat,
       CASE WHEN event_id % 83 = 0 THEN CAST(NULL AS DOUBLE) ELSE lon END AS lon,
       distance_from_home, repeat_retailer,
       CASE WHEN event_id % 79 = 0 THEN 2.0e0 ELSE used_chip END AS used_chip, used_pin_number, online_order
FROM transactions
"""

ALL = [("card_tx", CARD_TX), ("transactions", TRANSACTIONS), ("reviews", REVIEWS),
       ("alerts", ALERTS), ("eval_scores", EVAL_SCORES), ("ingress_raw", INGRESS_RAW)]


def ctes(extra: list[tuple[str, str]] | None = None) -> str:
    parts = ALL + (extra or [])
    return "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in parts) + "\n"
