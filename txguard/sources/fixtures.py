"""Fixture tables derived from the driver's ``events`` table.

Card transactions, stored transactions, review requests, alerts, labelled
scores, ingress rows and stream messages, all built with DataFrame
expressions so they scale with ``events``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txguard.functions.geo import haversine_km
from txguard.schemas import FEATURE_COLS
from txguard.sources.tables import read_table


def card_tx(events: DataFrame) -> DataFrame:
    ev = events.select("event_id", F.col("user_id").alias("cc_num"), F.col("ts").alias("trans_date_trans_time"),
                       F.col("value").alias("amt"),
                       F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"), "event_type")
    k, et, cc = F.col("k"), F.col("event_type"), F.col("cc_num")
    merchant = F.concat(F.when(k % 5 == 0, F.lit("ChipMart_")).otherwise(F.lit("merchant_")),
                        (k % 20).cast("string"))
    category = (F.when(et == "purchase", "shopping_pos").when(et == "click", "shopping_net")
                 .when(et == "view", "travel").when(et == "signup", "Online_services")
                 .otherwise("grocery_POS"))
    lat = F.lit(25.0) + (cc * 37 % 240) / 10.0
    lon = F.lit(-120.0) + (cc * 53 % 500) / 10.0
    merch_lat = lat + ((k * 17) % 100 - 50) / 50.0
    merch_lon = lon + F.when(k % 10 == 9, F.lit(20.0)).otherwise(((k * 31) % 100 - 50) / 50.0)
    is_fraud = F.when((et == "error") & (F.col("amt") > 20), 1).otherwise(0)
    return ev.select("event_id", "cc_num", "trans_date_trans_time", "amt", "k", merchant.alias("merchant"),
                     category.alias("category"), lat.alias("lat"), lon.alias("long"),
                     merch_lat.alias("merch_lat"), merch_lon.alias("merch_long"), is_fraud.alias("is_fraud"))


def card_gaps(cards: DataFrame) -> DataFrame:
    """Card transactions with NULL amounts and merchants and many equal times."""
    ev = F.col("event_id")
    return cards.withColumns({
        "amt": F.when(ev % 5 != 0, F.col("amt")), "merchant": F.when(ev % 3 != 0, F.col("merchant")),
        "trans_date_trans_time": F.date_trunc("day", "trans_date_trans_time").cast(
            cards.schema["trans_date_trans_time"].dataType)})


def transactions(cards: DataFrame) -> DataFrame:
    """Stored transactions with every status, including NULL."""
    # repeat retailer: not the first (time, id) of its (card, merchant) pair; the
    # first occurrence is a partially aggregated min joined back (a hot pair is
    # split by AQE's skew join instead of landing in one window task)
    first = cards.groupBy("cc_num", "merchant").agg(
        F.min(F.struct("trans_date_trans_time", "event_id")).alias("_first"))
    cards = cards.join(first, ["cc_num", "merchant"], "left")
    ev = F.col("event_id")
    s = (ev * 7919 % 1000) / 1000.0
    t = cards.select(
        F.concat(F.lit("tx_"), ev.cast("string")).alias("_id"), "event_id",
        F.concat(F.lit("User_"), F.col("cc_num").cast("string")).alias("userId"),
        F.col("amt").alias("amount"), F.col("trans_date_trans_time").alias("timestamp"),
        F.col("trans_date_trans_time").alias("createdAt"),
        F.col("merch_lat").alias("lat"), F.col("merch_long").alias("lon"),
        haversine_km("lat", "long", "merch_lat", "merch_long").alias("distance_from_home"),
        F.when(F.struct("trans_date_trans_time", "event_id") > F.col("_first"), 1.0).otherwise(0.0)
        .alias("repeat_retailer"),
        F.when(F.lower("merchant").contains("chip"), 1.0).otherwise(0.0).alias("used_chip"),
        F.when(F.lower("category").contains("pos"), 1.0).otherwise(0.0).alias("used_pin_number"),
        F.when(F.lower("category").contains("net") | F.lower("category").contains("online"), 1.0)
        .otherwise(0.0).alias("online_order"),
        s.alias("s"))
    status = (F.when(ev % 50 == 0, F.lit(None).cast("string"))
               .when(ev % 10 == 1, "PENDING")
               .when((F.col("s") > 0.6) & (ev % 3 == 0), "BLOCKED")
               .when(F.col("s") > 0.6, "FLAGGED").otherwise("CLEARED"))
    t = t.withColumn("status", status)
    return t.select(
        "_id", "event_id", "userId", "amount", "timestamp", "lat", "lon", "distance_from_home",
        "repeat_retailer", "used_chip", "used_pin_number", "online_order",
        F.when(F.col("status") == "PENDING", F.lit(-1.0)).otherwise(F.col("s")).alias("fraud_score"),
        "status", "createdAt")


def reviews(tx: DataFrame) -> DataFrame:
    """Review requests: every FLAGGED transaction plus one id that does not exist."""
    r = (tx.filter(F.col("status") == "FLAGGED")
         .select("_id", F.when(F.col("event_id") % 8 == 0, "BLOCKED").otherwise("CLEARED")
                 .alias("new_status")))
    missing = tx.sparkSession.createDataFrame([("tx_missing", "CLEARED")], "_id string, new_status string")
    return r.unionByName(missing)


def alerts(tx: DataFrame) -> DataFrame:
    return (tx.filter(F.col("status") == "FLAGGED")
            .select(F.concat(F.lit("al_"), F.col("event_id").cast("string")).alias("_id"),
                    F.col("_id").alias("transactionId"), "userId",
                    F.col("fraud_score").alias("score"), "timestamp", F.lit("OPEN").alias("status")))


def eval_scores(cards: DataFrame) -> DataFrame:
    return cards.select("event_id", F.col("is_fraud").alias("y_true"),
                        ((F.col("event_id") * 104729 % 4000) / 1000.0 + F.col("is_fraud")).alias("mse"))


def eval_gaps(scores: DataFrame) -> DataFrame:
    """Labelled scores with NULL and NaN scores and NULL labels."""
    ev = F.col("event_id")
    return scores.select(
        "event_id", F.when(ev % 17 == 0, F.lit(None)).otherwise(F.col("y_true")).cast("int").alias("y_true"),
        F.when(ev % 11 == 0, F.lit(None)).when(ev % 13 == 0, F.lit(float("nan"))).otherwise(F.col("mse")).alias("mse"))


def fixture_model() -> dict:
    """Made-up weights for queries and tests that need some model."""
    from txguard.operators import scoring as sc
    inputs = [f"x{i}" for i in range(len(FEATURE_COLS))]
    return {"weights": sc.seeded_weights(), "supervised": sc.LinearProbe.seeded(inputs)}


def ingress_requests(raw: DataFrame) -> DataFrame:
    """Ingress rows as JSON requests; members are absent where NULL, some have the wrong type.

    event_id % 103 = 0 -> numeric userId; % 107 = 0 -> amount as text; % 109 = 0 -> lat null; % 113 = 0 -> no JSON.
    """
    ev = F.col("event_id")
    names = [c for c in raw.columns if c != "event_id"]
    good = F.to_json(F.struct(*names))
    user = F.to_json(F.struct(*[(ev if c == "userId" else F.col(c)).alias(c) for c in names]))
    text = F.to_json(F.struct(*[(F.col(c).cast("string") if c == "amount" else F.col(c)).alias(c) for c in names]))
    null = F.concat(F.lit('{"lat":null,'), F.substring(F.to_json(F.struct(*[c for c in names if c != "lat"])), F.lit(2), F.lit(10_000)))
    value = (F.when(ev % 113 == 0, F.lit("{bad json")).when(ev % 109 == 0, null).when(ev % 107 == 0, text)
             .when(ev % 103 == 0, user).otherwise(good))
    return raw.select("event_id", value.alias("value"))


def ingress_raw(tx: DataFrame) -> DataFrame:
    ev = F.col("event_id")
    return tx.select(
        "event_id",
        F.when(ev % 101 == 0, F.lit("")).otherwise(F.col("userId")).alias("userId"),
        F.when(ev % 97 == 0, -F.col("amount")).otherwise(F.col("amount")).alias("amount"),
        F.when(ev % 89 == 0, F.lit(91.0)).otherwise(F.col("lat")).alias("lat"),
        F.when(ev % 83 == 0, F.lit(None).cast("double")).otherwise(F.col("lon")).alias("lon"),
        "distance_from_home", "repeat_retailer",
        F.when(ev % 79 == 0, F.lit(2.0)).otherwise(F.col("used_chip")).alias("used_chip"),
        "used_pin_number", "online_order")


MESSAGE_FIELDS = ["_id", "userId", "amount", "lat", "lon", "distance_from_home",
                  "repeat_retailer", "used_chip", "used_pin_number", "online_order"]


def messages(tx: DataFrame) -> DataFrame:
    """Stream messages (JSON text) with injected faults.

    event_id % 97 = 0 -> malformed JSON; % 89 = 0 -> numeric userId;
    % 83 = 0 -> amount as a string.
    """
    ev = F.col("event_id")
    ts = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    fields = [F.col(c) for c in MESSAGE_FIELDS] + [ts.alias("timestamp")]

    def with_field(name, expr):
        return [expr.alias(name) if c == name else F.col(c) for c in MESSAGE_FIELDS] + [ts.alias("timestamp")]

    good = F.to_json(F.struct(*fields))
    num_user = F.to_json(F.struct(*with_field("userId", F.col("event_id"))))
    str_amount = F.to_json(F.struct(*with_field("amount", F.col("amount").cast("string"))))
    value = (F.when(ev % 97 == 0, F.lit("{bad json"))
              .when(ev % 89 == 0, num_user)
              .when(ev % 83 == 0, str_amount)
              .otherwise(good))
    return tx.select("event_id", "_id", "createdAt", value.alias("value"))


class Fixtures(dict):
    """Fixture frames built on first access (each build costs plan analysis)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        if name == "card_tx":
            df = card_tx(read_table(self.spark, self.sf_dir, "events"))
        elif name == "transactions":
            df = transactions(self["card_tx"])
        elif name == "eval_scores":
            df = eval_scores(self["card_tx"])
        else:
            df = {"reviews": reviews, "alerts": alerts, "ingress_raw": ingress_raw,
                  "messages": messages}[name](self["transactions"])
        self[name] = df
        return df


def load(spark: SparkSession, sf_dir: str) -> Fixtures:
    """All fixture frames for one scale-factor directory (lazy)."""
    return Fixtures(spark, sf_dir)
