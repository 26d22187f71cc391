"""Learning-job registrations (M1-M8).  Fits are compared by facts that do not
depend on an engine's arithmetic; the evaluation pipeline has fixed weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from txguard.learning import jobs
from txguard.learning.autoencoder import discard, hash_split, materialize
from txguard.operators import evaluate as ev
from txguard.operators import scoring as sc
from txguard.operators.features import engineer_features
from txguard.plans.q_eval import _r  # noqa: F401
from txguard.plans.q_scoring import recon_sql, scaled_sql
from txguard.plans.registry import register
from txguard.plans.sqlfrag import FEATURES_BATCH
from txguard.schemas import FEATURE_COLS
from txguard.sources import fixtures
from txguard.sources.tables import read_table


def cards(spark, sf):
    return fixtures.card_tx(read_table(spark, sf, "events"))


@register("train_split", "event_id:i, part:s",
          "SELECT event_id, CASE WHEN CAST('0x' || substr(md5('42:' || CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 80 "
          "THEN 'train' ELSE 'val' END AS part FROM card_tx")
def q_split(spark, sf):
    c = cards(spark, sf)
    tr, va = hash_split(c, "event_id")
    return tr.select("event_id", F.lit("train").alias("part")).unionByName(
        va.select("event_id", F.lit("val").alias("part")))


def _facts(spark, history, val: bool):
    """Facts of a fit that hold whatever the arithmetic of the engine: epochs run, and whether losses fell."""
    first, last = history[0], history[-1]
    return spark.createDataFrame([(len(history), last[1] < first[1], last[2] < first[2] if val else None)],
                                 "epochs int, train_fell boolean, val_fell boolean")


@register("autoencoder_fit", "epochs:i, train_fell:b, val_fell:b", "SELECT 15 AS epochs, true AS train_fell, true AS val_fell")
def q_fit(spark, sf):
    _, res = jobs.training_job(cards(spark, sf))
    return _facts(spark, res.history, True)


@register("supervised_fit", "n:i, in_range:b, ranks:b",
          "SELECT count(*) AS n, true AS in_range, true AS ranks FROM card_tx")
def q_supervised(spark, sf):
    """Rows scored, probabilities within 0 and 1, and an AUC above 0.8 on the training rows."""
    # every pass of the training reads the features, and the AUC and the counts read the scores: each computed once
    feats, feats_path = materialize(engineer_features(cards(spark, sf)).select("is_fraud", *FEATURE_COLS), "features")
    model = jobs.fit_supervised(feats)
    out, out_path = materialize(sc.supervised_probability(feats, model, "p_fraud")
                                .select(F.col("is_fraud").alias("y_true"), "p_fraud"), "scores")
    ranked = ev.auc(out, score="p_fraud").select((F.col("roc_auc") > 0.8).alias("ranks"))
    facts = out.agg(F.count(F.lit(1)).alias("n"), F.min(F.col("p_fraud").between(0, 1)).alias("in_range")).crossJoin(ranked)
    facts = spark.createDataFrame(facts.collect(), facts.schema)      # one row
    for path in (feats_path, out_path):
        discard(spark, path)
    return facts


@register("retrain_fit", "epochs:i, train_fell:b",
          "SELECT 5 AS epochs, true AS train_fell FROM transactions WHERE status = 'CLEARED' HAVING count(*) >= 100")
def q_retrain(spark, sf):
    tx = fixtures.transactions(cards(spark, sf))
    res = jobs.retrain(tx, sc.Scaler.reference())
    if res is None:
        return spark.createDataFrame([], "epochs int, train_fell boolean")
    return _facts(spark, res.history, False)


EVAL_CM = ("SELECT count(*) FILTER (WHERE is_fraud <> 1 AND NOT mse > 1.5) AS tn, "
           "count(*) FILTER (WHERE is_fraud <> 1 AND mse > 1.5) AS fp, "
           "count(*) FILTER (WHERE is_fraud = 1 AND NOT mse > 1.5) AS fn, "
           "count(*) FILTER (WHERE is_fraud = 1 AND mse > 1.5) AS tp FROM (" + recon_sql(scaled_sql(FEATURES_BATCH))
           + ") ej")


@register("eval_job_confusion", "tn:i, fp:i, fn:i, tp:i", EVAL_CM)
def q_eval_job(spark, sf):
    out = jobs.evaluation_job(cards(spark, sf), sc.Scaler.reference(), sc.seeded_weights(), with_auc=False)
    return out["confusion"]
