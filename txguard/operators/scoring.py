"""Scaling, autoencoder reconstruction, ensemble score, decision and reasons.

The autoencoder (29-16-8-16-29, ReLU between layers) is evaluated by matrix
products over Arrow batches: the 29 inputs go to Python and one error comes
back, nothing is shuffled, and a batch is bounded.  Where the reconstruction
itself is wanted, ``reconstruct`` gives it as plain Column arithmetic, one
projection per layer with the weights as literals; this takes ten times as long,
since its last layer is one generated method above the JVM's limit for
compilation.  The weights are 1,253 numbers, a fixed bound independent of the
data.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from txguard.functions.text import to_fixed
from txguard.plans.asof import as_of
from txguard.plans.fence import fence
from txguard.schemas import (AE_LAYERS, AE_SCORE_DIVISOR, ANOMALY_TEXT, DEFAULT_THRESHOLD, FEATURE_COLS, FLAG_FIELDS,
                             GEO_REASON_KM, GEO_TEXT, MODEL_FAILURE_SCORE, MODEL_FAILURE_TEXT, REFERENCE_SCALER_MEAN,
                             REFERENCE_SCALER_SCALE, RISK_TEXT, SPEND_REASON_RATIO, SPEND_TEXT)

# ---------------------------------------------------------------- scaler ----


@dataclass
class Scaler:
    mean: list[float]
    scale: list[float]
    feature_names: list[str] = field(default_factory=lambda: list(FEATURE_COLS))

    @staticmethod
    def reference() -> "Scaler":
        return Scaler(list(REFERENCE_SCALER_MEAN), list(REFERENCE_SCALER_SCALE))

    @staticmethod
    def from_frame(df: DataFrame) -> "Scaler":
        """Read a one-row scaler frame (mean, scale, feature_names arrays)."""
        row = df.limit(2).collect()
        if len(row) != 1:
            raise ValueError("scaler frame must have exactly one row")
        r = row[0]
        return Scaler(list(r["mean"]), list(r["scale"]), list(r["feature_names"]))

    def to_frame(self, spark) -> DataFrame:
        return spark.createDataFrame(
            [(self.mean, self.scale, self.feature_names)],
            "mean array<double>, scale array<double>, feature_names array<string>")


MACHINE_EPS = 2.220446049250313e-16


def fit_scaler(df: DataFrame, cols=FEATURE_COLS) -> DataFrame:
    """Mean and population std per column in one aggregation pass.

    A column is constant (scale 1.0) when its variance is within floating
    noise of zero: var <= n*eps*var + (n*mean*eps)^2.  Output: one row with
    ``mean``, ``scale`` arrays, ``feature_names`` and ``n``.
    """
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(cols):
        aggs += [F.avg(c).alias(f"m{i}"), F.var_pop(c).alias(f"v{i}")]
    a = df.agg(*aggs)
    n = F.col("n").cast("double")
    scales = []
    for i in range(len(cols)):
        m, v = F.col(f"m{i}"), F.col(f"v{i}")
        const = v <= n * MACHINE_EPS * v + F.pow(n * m * MACHINE_EPS, 2)
        scales.append(F.when(const, F.lit(1.0)).otherwise(F.sqrt(v)))
    return a.select(F.array(*[F.col(f"m{i}") for i in range(len(cols))]).alias("mean"),
                    F.array(*scales).alias("scale"),
                    F.array(*[F.lit(c) for c in cols]).alias("feature_names"), "n")


def scale_features(df: DataFrame, scaler, cols=FEATURE_COLS, prefix: str = "x") -> DataFrame:
    """(x - mean) / scale per feature.  ``scaler``: Scaler or a one-row frame.

    A frame is attached with a broadcast cross join (exactly one row, so the
    broadcast is bounded) and stays lazy.
    """
    if isinstance(scaler, DataFrame):
        s = F.broadcast(scaler.select(F.col("mean").alias("_sm"), F.col("scale").alias("_ss")))
        out = df.crossJoin(s)
        out = out.withColumns({f"{prefix}{i}": (F.col(c) - F.col("_sm")[i]) / F.col("_ss")[i]
                               for i, c in enumerate(cols)})
        return out.drop("_sm", "_ss")
    return df.selectExpr("*", *[f"(`{c}` - {dlit(scaler.mean[i])}) / {dlit(scaler.scale[i])} AS `{prefix}{i}`"
                                for i, c in enumerate(cols)])


# ----------------------------------------------------------- autoencoder ----

Weights = list  # [(W[in][out], b[out]) per layer]


def seeded_weights(layers=AE_LAYERS) -> Weights:
    """Deterministic test weights (fixture formula, not learned):
    W_l[i][j] = ((31i + 17j + 7l) mod 13 - 6) / 20, b_l[j] = ((5j + l) mod 7 - 3) / 20."""
    out = []
    for l, (n_in, n_out) in enumerate(layers):
        W = [[((31 * i + 17 * j + 7 * l) % 13 - 6) / 20 for j in range(n_out)] for i in range(n_in)]
        b = [((5 * j + l) % 7 - 3) / 20 for j in range(n_out)]
        out.append((W, b))
    return out


def neuron_terms(W, b, inputs: list, j: int):
    """(bias, [(input, weight)...]) for output j, zero weights dropped."""
    return float(b[j]), [(inputs[i], float(W[i][j])) for i in range(len(inputs)) if W[i][j] != 0]


def dlit(v: float) -> str:
    """Spark SQL DOUBLE literal (shortest round-trip text + D suffix)."""
    v = float(v)
    if v != v or v in (float("inf"), float("-inf")):
        return f"CAST('{v}' AS DOUBLE)"
    return f"{v!r}D"


def reconstruct(df: DataFrame, weights: Weights, inputs: list[str], prefix: str = "r") -> DataFrame:
    """Forward pass; adds ``{prefix}0..{prefix}{d-1}`` (linear output layer).

    Each layer is one projection built from SQL text in a single call, so a
    layer costs one round trip to the JVM instead of one per term.
    """
    cur = list(inputs)
    last = len(weights) - 1
    tmp = []
    for l, (W, b) in enumerate(weights):
        exprs = []
        names = []
        for j in range(len(b)):
            bias, terms = neuron_terms(W, b, cur, j)
            e = dlit(bias) + "".join(f" + `{name}` * {dlit(w)}" for name, w in terms)
            if l < last:
                e = f"greatest({e}, 0.0D)"
            name = f"{prefix}{j}" if l == last else f"_h{l}_{j}"
            exprs.append(f"{e} AS `{name}`")
            names.append(name)
        df = df.selectExpr("*", *exprs)
        if l < last:
            tmp += names
        cur = names
    return df.drop(*tmp)


def recon_mse(df: DataFrame, n: int = len(FEATURE_COLS), x: str = "x", r: str = "r",
              name: str = "mse") -> DataFrame:
    e = " + ".join(f"pow(`{x}{i}` - `{r}{i}`, 2)" for i in range(n))
    out = df.selectExpr("*", f"({e}) / {dlit(n)} AS `{name}`")
    # filters on the error must not be inlined into the network (plans.fence)
    return fence(out, [name])


def recon_mse_batches(df: DataFrame, weights: Weights, inputs: list[str], name: str = "mse", batch_size: int = 10_000) -> DataFrame:
    """The reconstruction error by matrix products over Arrow batches, equal to ``reconstruct`` and ``recon_mse``.

    The inputs go to Python and one number comes back, no reconstructed columns.
    A missing input gives NULL.
    """
    def make():
        import numpy as np
        layers = [(np.asarray(W, dtype="float64"), np.asarray(b, dtype="float64")) for W, b in weights]

        def errors(x):
            h = x
            for k, (W, b) in enumerate(layers):
                h = h @ W + b
                if k < len(layers) - 1:
                    h = np.maximum(h, 0.0)
            return ((h - x) ** 2).mean(axis=1)
        return errors

    batches = predict_batch_udf(make, return_type=DoubleType(), batch_size=batch_size, input_tensor_shapes=[[len(inputs)]])
    known = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in inputs]
    return df.withColumn(name, batches(F.array(*known))).withColumn(name, F.when(~F.isnan(name), F.col(name)))


# ------------------------------------------------------- supervised side ----


@dataclass
class LinearProbe:
    """Logistic stand-in for the supervised model: sigmoid(b + sum w_i * x_i).

    Applied to the columns named in ``inputs`` (scaled features by default).
    """
    w: list[float]
    b: float
    inputs: list[str]

    @staticmethod
    def seeded(inputs: list[str]) -> "LinearProbe":
        return LinearProbe([((7 * i) % 11 - 5) / 50 for i in range(len(inputs))], -1.0, list(inputs))

    def column(self) -> Column:
        z = dlit(self.b) + "".join(f" + `{n}` * {dlit(w)}" for n, w in zip(self.inputs, self.w) if w != 0)
        return F.expr(f"1.0D / (1.0D + exp(-({z})))")


def supervised_probability(df: DataFrame, supervised, name: str = "xgb_score") -> DataFrame:
    """Attach P(class 1) from a LinearProbe, a Column, or a fitted Spark ML model
    whose output has a ``probability`` vector (features in ``features_vec``)."""
    if isinstance(supervised, LinearProbe):
        return df.withColumn(name, supervised.column())
    if isinstance(supervised, Column):
        return df.withColumn(name, supervised)
    from pyspark.ml.functions import vector_to_array
    out = supervised.transform(df)
    return out.withColumn(name, vector_to_array("probability")[1]).drop("probability", "rawPrediction",
                                                                        "prediction")


# ------------------------------------------------------ score / decision ----


def effective_threshold(config: DataFrame | None, default: float = DEFAULT_THRESHOLD) -> DataFrame:
    """One row ``threshold``: the configured value, else the default (empty or NULL)."""
    if config is None:
        from pyspark.sql import SparkSession
        spark = SparkSession.getActiveSession()
        return spark.range(1).select(F.lit(default).alias("threshold"))
    newest = F.max_by("threshold", "updatedAt") if "updatedAt" in config.columns else F.max("threshold")
    return config.agg(F.coalesce(newest.cast("double"), F.lit(default)).alias("threshold"))


def set_threshold(spark, path: str, value: float) -> None:
    """Append a threshold to the config table; the newest row is in force."""
    if not 0 <= value <= 1:
        raise ValueError("Threshold must be between 0 and 1")
    spark.range(1).select(F.lit(float(value)).alias("threshold"), F.current_timestamp().alias("updatedAt")) \
        .write.mode("append").parquet(path)


def decide_as_of(scored: DataFrame, history: DataFrame, time: str = "timestamp", default: float = DEFAULT_THRESHOLD,
                 **cut) -> DataFrame:
    """Add ``threshold``, the one in force at the record's own time, and ``status`` by it.

    ``history`` has one row per change, ``threshold`` and ``updatedAt``; a record
    before the first change, or without a time, gets the default.  A replay of
    old records so decides as the day did, not as today would.
    """
    out = as_of(scored.drop("threshold", "status"), history, time, "updatedAt", "threshold", "threshold", **cut)
    out = out.withColumn("threshold", F.coalesce(F.col("threshold").cast("double"), F.lit(default)))
    return out.withColumn("status", F.when(F.col("fraud_score") > F.col("threshold"), "FLAGGED").otherwise("CLEARED"))


def ensemble(df: DataFrame, sup: str = "xgb_score", mse: str = "mse") -> DataFrame:
    """ae = min(mse/1.5, 1); score = 0.5*sup + 0.5*ae; NULL/NaN -> model failure."""
    m = F.col(mse)
    ae = F.when(m.isNull() | F.isnan(m), F.lit(None).cast("double")).otherwise(
        F.least(m / AE_SCORE_DIVISOR, F.lit(1.0)))
    df = df.withColumn("ae_score", ae)
    raw = F.col(sup) * 0.5 + F.col("ae_score") * 0.5
    failed = raw.isNull() | F.isnan(raw)
    return df.withColumns({"model_failed": failed,
                           "fraud_score": F.when(failed, F.lit(MODEL_FAILURE_SCORE)).otherwise(raw)})


def reasoning(sup: str = "xgb_score") -> Column:
    dist = F.col("distance_from_last_transaction")
    ratio = F.col("ratio_to_median_purchase_price")
    base = F.concat(F.lit(RISK_TEXT), to_fixed(F.col(sup) * 100, 1),
                    F.lit(ANOMALY_TEXT), to_fixed(F.col("ae_score") * 100, 1), F.lit("%"))
    geo = F.when(dist > GEO_REASON_KM, F.concat(F.lit(GEO_TEXT[0]), to_fixed(dist, 0), F.lit(GEO_TEXT[1]))).otherwise(F.lit(""))
    spend = F.when(ratio > SPEND_REASON_RATIO, F.concat(F.lit(SPEND_TEXT[0]), to_fixed(ratio, 1), F.lit(SPEND_TEXT[1]))).otherwise(F.lit(""))
    return F.when(F.col("model_failed"), F.lit(MODEL_FAILURE_TEXT)).otherwise(F.concat(base, geo, spend))


def decide(df: DataFrame, threshold=DEFAULT_THRESHOLD) -> DataFrame:
    """status = FLAGGED if score > threshold (strict) else CLEARED.

    ``threshold``: a float or a one-row frame with column ``threshold``.
    """
    if isinstance(threshold, DataFrame):
        df = df.crossJoin(F.broadcast(threshold.select(F.col("threshold").alias("_thr"))))
        t = F.col("_thr")
    else:
        t = F.lit(float(threshold))
    df = df.withColumn("status", F.when(F.col("fraud_score") > t, "FLAGGED").otherwise("CLEARED"))
    return df.drop("_thr") if "_thr" in df.columns else df


def score_rows(df: DataFrame, scaler=None, weights: Weights | None = None, supervised=None,
               threshold=DEFAULT_THRESHOLD, cols=FEATURE_COLS, keep_intermediate: bool = False) -> DataFrame:
    """Add xgb_score, ae_score, mse, fraud_score, status, reasoning to a feature frame.

    ``weights`` and ``supervised`` are a trained model; there is no default one.
    """
    if weights is None or supervised is None:
        raise ValueError("score_rows needs the autoencoder's weights and a supervised model")
    scaler = Scaler.reference() if scaler is None else scaler
    xs = [f"x{i}" for i in range(len(cols))]
    out = scale_features(df, scaler, cols)
    if keep_intermediate:
        out = recon_mse(reconstruct(out, weights, xs), len(cols))
    else:
        out = recon_mse_batches(out, weights, xs)
    out = supervised_probability(out, supervised)
    out = fence(out, ["mse", "xgb_score"])
    out = ensemble(out)
    out = decide(out, threshold)
    out = out.withColumn("reasoning", reasoning())
    return out if keep_intermediate else out.drop(*xs)


def explain_prompt(df: DataFrame) -> DataFrame:
    """Case prompt for flagged rows (input for an outside explainer) and the
    fallback reasoning used when no explanation is available."""
    from txguard.schemas import EXPLAIN_UNAVAILABLE
    parts = [F.lit("Card payment held for review, score "), to_fixed("fraud_score", 2), F.lit(". Paid "), to_fixed("amount", 2),
             F.lit("; km from home "), to_fixed("distance_from_home", 1), F.lit("; km from the payment before "),
             to_fixed("distance_from_last_transaction", 1)]
    for name in FLAG_FIELDS:
        parts += [F.lit(f"; {name} "), to_fixed(name, 0)]
    parts += [F.lit(". Model notes: "), F.col("reasoning"), F.lit(". Say in two sentences what an analyst should check.")]
    flagged = F.col("status") == "FLAGGED"
    return df.withColumns({
        "prompt": F.when(flagged, F.concat(*parts)),
        "reasoning": F.when(flagged, F.concat(F.col("reasoning"), F.lit(EXPLAIN_UNAVAILABLE)))
        .otherwise(F.col("reasoning")),
    })
