"""Model evaluation: predictions, confusion matrix, P/R/F1, per-class report,
ROC-AUC and a threshold sweep — each a single aggregation pass (AUC: two)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txguard.schemas import OFFLINE_MSE_THRESHOLD, SWEEP_THRESHOLDS


def above(score: str | Column, threshold: float) -> Column:
    """score > threshold; false for a NULL or NaN score (as the numeric comparison has it)."""
    c = F.col(score) if isinstance(score, str) else score
    return F.coalesce((c > F.lit(float(threshold))) & ~F.isnan(c), F.lit(False))


def positive(y: str) -> Column:
    """label = 1; a NULL label counts as the negative class."""
    return F.coalesce(F.col(y) == 1, F.lit(False))


def predict(df: DataFrame, threshold: float = OFFLINE_MSE_THRESHOLD, score: str = "mse",
            name: str = "y_pred") -> DataFrame:
    return df.withColumn(name, above(score, threshold).cast("int"))


def _cnt(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def confusion(df: DataFrame, threshold: float = OFFLINE_MSE_THRESHOLD, y: str = "y_true",
              score: str = "mse") -> DataFrame:
    """One row tn, fp, fn, tp (the [[TN, FP], [FN, TP]] matrix); the four add up to the row count."""
    p, t = above(score, threshold), positive(y)
    return df.agg(_cnt(~t & ~p).alias("tn"), _cnt(~t & p).alias("fp"),
                  _cnt(t & ~p).alias("fn"), _cnt(t & p).alias("tp"))


def _ratio(a: Column, b: Column) -> Column:
    """a / b, 0 when b = 0 (zero_division = 0)."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))


def prf(df: DataFrame, threshold: float = OFFLINE_MSE_THRESHOLD, y: str = "y_true", score: str = "mse") -> DataFrame:
    c = confusion(df, threshold, y, score)
    p = _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    r = _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select(p.alias("precision"), r.alias("recall")).withColumn(
        "f1", _f1(F.col("precision"), F.col("recall")))


def report(df: DataFrame, threshold: float = OFFLINE_MSE_THRESHOLD, y: str = "y_true",
           score: str = "mse") -> DataFrame:
    """Per-class precision/recall/F1/support, accuracy, macro and weighted averages."""
    c = confusion(df, threshold, y, score)
    tn, fp, fn, tp = (F.col(k) for k in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    p1, r1 = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    p0, r0 = _ratio(tn, tn + fn), _ratio(tn, tn + fp)
    f1_1, f1_0 = _f1(p1, r1), _f1(p0, r0)
    s1, s0 = tp + fn, tn + fp
    acc = _ratio(tp + tn, n)
    nd = n.cast("double")

    def row(label, p, r, f, s):
        return F.struct(F.lit(label).alias("label"), p.cast("double").alias("precision"),
                        r.cast("double").alias("recall"), f.cast("double").alias("f1"),
                        s.cast("bigint").alias("support"))

    rows = F.array(
        row("0", p0, r0, f1_0, s0), row("1", p1, r1, f1_1, s1),
        row("accuracy", F.lit(None), F.lit(None), acc, n),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f1_0 + f1_1) / 2, n),
        row("weighted avg", (p0 * s0 + p1 * s1) / nd, (r0 * s0 + r1 * s1) / nd, (f1_0 * s0 + f1_1 * s1) / nd, n),
    )
    return c.select(F.inline(rows))


def auc(df: DataFrame, y: str = "y_true", score: str = "score", rows_per_bucket: int = 1_000_000,
        max_buckets: int = 100_000) -> DataFrame:
    """ROC-AUC with tied scores counted half (Mann-Whitney U / (P*N)); NULL when a class is absent
    or any score is NULL or NaN, which have no rank.

    No single-partition window over the data:
    1. bucket splits at approximate score quantiles, one bucket per about
       ``rows_per_bucket`` rows (balance only; exactness does not depend on
       them); the splits (<= max_buckets doubles) go to a JVM binary-search
       ``Bucketizer``;
    2. group by (bucket, score): positives and negatives per distinct score;
    3. per bucket, a window gives the negatives below each score inside the
       bucket, and the bucket's partial U_i, P_i, N_i are summed;
    4. U = sum_i (U_i + P_i * negatives in earlier buckets)   [window over the bucket table].
    """
    import math

    from pyspark.ml.feature import Bucketizer
    from pyspark.sql import Window
    d = df.select(F.when(positive(y), 1).otherwise(0).alias("_y"), F.col(score).cast("double").alias("_s"))
    unranked = F.col("_s").isNull() | F.isnan("_s")
    n, missing = d.agg(F.count(F.lit(1)), F.count(F.when(unranked, 1))).first()
    if missing:
        return df.sparkSession.createDataFrame([(None,)], "roc_auc double")
    buckets = int(min(max(1, math.ceil(n / rows_per_bucket)), max_buckets))
    splits = [float("-inf"), float("inf")]
    if buckets > 1:
        qs = [i / buckets for i in range(1, buckets)]
        row = d.agg(F.percentile_approx("_s", qs, max(10000, 10 * buckets)).alias("b")).first()
        inner = sorted({float(v) for v in (row["b"] or []) if v == v and abs(v) != float("inf")})
        splits = [float("-inf")] + inner + [float("inf")]
    if len(splits) > 2:
        b = Bucketizer(splits=splits, inputCol="_s", outputCol="_bucket", handleInvalid="keep").transform(d)
    else:
        b = d.withColumn("_bucket", F.lit(0.0))
    g = b.groupBy("_bucket", "_s").agg(
        F.sum(F.when(F.col("_y") == 1, 1).otherwise(0)).alias("_pos"),
        F.sum(F.when(F.col("_y") == 1, 0).otherwise(1)).alias("_neg"))
    w = Window.partitionBy("_bucket").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("_below", F.coalesce(F.sum("_neg").over(w), F.lit(0)))
    per = g.groupBy("_bucket").agg(
        F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") * 0.5)).alias("_u"),
        F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n"))
    wb = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)   # one row per bucket
    per = per.withColumn("_n_before", F.coalesce(F.sum("_n").over(wb), F.lit(0)))
    a = per.agg(F.sum(F.col("_u") + F.col("_p") * F.col("_n_before")).alias("_u"),
                F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
    return a.select(F.when((F.col("_p") > 0) & (F.col("_n") > 0),
                           F.col("_u") / (F.col("_p").cast("double") * F.col("_n"))).alias("roc_auc"))


def sweep(df: DataFrame, thresholds=SWEEP_THRESHOLDS, y: str = "y_true", score: str = "mse") -> DataFrame:
    """Precision/recall/F1 per threshold; NULL (N/A) where nothing is predicted positive.

    One aggregation computes every threshold's counts; the rows are then
    unpacked from that single result row.
    """
    t = positive(y)
    aggs = [_cnt(t).alias("_P")]
    for i, th in enumerate(thresholds):
        p = above(score, th)
        aggs += [_cnt(p).alias(f"_pp{i}"), _cnt(p & t).alias(f"_tp{i}")]
    a = df.agg(*aggs)
    rows = []
    for i, th in enumerate(thresholds):
        pp, tp, P = F.col(f"_pp{i}"), F.col(f"_tp{i}"), F.col("_P")
        prec, rec = _ratio(tp, pp), _ratio(tp, P)
        na = pp == 0
        rows.append(F.struct(F.lit(float(th)).alias("threshold"),
                             F.when(na, None).otherwise(prec).alias("precision"),
                             F.when(na, None).otherwise(rec).alias("recall"),
                             F.when(na, None).otherwise(_f1(prec, rec)).alias("f1")))
    return a.select(F.inline(F.array(*rows)))
