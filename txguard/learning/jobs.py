"""End-to-end learning jobs composed from the operators.

scaler job   : union -> normal rows -> features -> fit_scaler -> JSON artifact
training job : ... -> scale -> hash split -> fit_autoencoder -> weight table
supervised   : features -> VectorAssembler -> GBTClassifier (Spark ML)
evaluation   : features -> scale -> reconstruction error -> metrics
retraining   : CLEARED rows -> guard -> reduced features -> scale -> fit
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txguard.learning.autoencoder import FitResult, discard, fit_autoencoder, hash_split, materialize
from txguard.learning.retrain_features import retrain_features, retrain_source
from txguard.operators import evaluate as ev
from txguard.operators.features import engineer_features
from txguard.operators.scoring import Scaler, fit_scaler, recon_mse_batches, scale_features
from txguard.schemas import FEATURE_COLS, MIN_RETRAIN_ROWS
from txguard.sources.tables import normal_rows, union_sources

XS = [f"x{i}" for i in range(len(FEATURE_COLS))]


def scaler_job(*raw: DataFrame) -> DataFrame:
    """Scaler from the normal rows of all sources (one-row frame)."""
    feats = engineer_features(normal_rows(union_sources(*raw)))
    return fit_scaler(feats)


def save_scaler(scaler_df: DataFrame, path: str) -> None:
    scaler_df.select("mean", "scale", "feature_names").coalesce(1).write.mode("overwrite").json(path)


def load_scaler(spark: SparkSession, path: str) -> Scaler:
    return Scaler.from_frame(spark.read.json(path))


def scaler_to_json(s: Scaler) -> str:
    return json.dumps({"mean": s.mean, "scale": s.scale, "feature_names": s.feature_names})


def training_job(raw: DataFrame, key: str = "event_id", epochs: int = 15, batch_size: int = 256, lr: float = 1e-3,
                 seed: int = 42, keep: str = "last", mode: str = "sync") -> tuple[Scaler, FitResult]:
    # the scaler, the training and the validation rows all read the features: computed once
    feats, path = materialize(engineer_features(normal_rows(raw)).select(key, *FEATURE_COLS), "features")
    scaler = Scaler.from_frame(fit_scaler(feats))
    scaled = scale_features(feats, scaler)
    train, val = hash_split(scaled, key, seed)
    res = fit_autoencoder(train, XS, val, epochs, batch_size, lr, seed, keep, mode=mode, key=key)
    discard(raw.sparkSession, path)
    return scaler, res


def fit_supervised(feats: DataFrame, label: str = "is_fraud", seed: int = 42, max_iter: int = 20):
    """GBT classifier on the unscaled 29 features (probability of class 1)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    va = VectorAssembler(inputCols=FEATURE_COLS, outputCol="features_vec", handleInvalid="keep")
    gbt = GBTClassifier(featuresCol="features_vec", labelCol=label, maxIter=max_iter, seed=seed)
    data = feats.withColumn(label, F.col(label).cast("double"))
    return Pipeline(stages=[va, gbt]).fit(data)


def evaluation_job(raw: DataFrame, scaler: Scaler, weights, threshold: float = 1.5, with_auc: bool = True):
    """Per-row mse plus the metric frames (confusion, prf, report, auc, sweep).

    ``auc`` sizes its buckets from the data (it runs a count), so it can be
    left out when only the threshold metrics are wanted.
    """
    feats = engineer_features(raw)
    r = recon_mse_batches(scale_features(feats, scaler), weights, XS)
    scored = r.select(*[c for c in ("event_id", "cc_num") if c in r.columns],
                      F.col("is_fraud").alias("y_true"), "mse")
    out = {
        "scores": scored,
        "confusion": ev.confusion(scored, threshold),
        "prf": ev.prf(scored, threshold),
        "report": ev.report(scored, threshold),
        "sweep": ev.sweep(scored),
    }
    if with_auc:
        out["auc"] = ev.auc(scored, score="mse")
    return out


def retrain(tx: DataFrame, scaler: Scaler, min_rows: int = MIN_RETRAIN_ROWS, epochs: int = 5,
            batch_size: int = 32, lr: float = 1e-3, seed: int = 42, mode: str = "sync") -> FitResult | None:
    """Retrain from reviewed CLEARED rows; None when fewer than ``min_rows`` exist."""
    src = retrain_source(tx)
    if src.limit(min_rows).count() < min_rows:
        return None
    scaled = scale_features(retrain_features(src), scaler)
    return fit_autoencoder(scaled, XS, None, epochs, batch_size, lr, seed, mode=mode, key="_id")


def save_supervised(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_supervised(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)
