"""Evaluation registrations (A5-A9, X10) over the labelled-score fixture."""

from __future__ import annotations

from txguard.operators import evaluate as ev
from txguard.plans.registry import register
from txguard.sources import fixtures
from txguard.sources.tables import read_table


def scores(spark, sf):
    return fixtures.eval_scores(fixtures.card_tx(read_table(spark, sf, "events")))


CM = ("SELECT count(*) FILTER (WHERE y_true <> 1 AND NOT mse > 1.5) AS tn, "
      "count(*) FILTER (WHERE y_true <> 1 AND mse > 1.5) AS fp, "
      "count(*) FILTER (WHERE y_true = 1 AND NOT mse > 1.5) AS fn, "
      "count(*) FILTER (WHERE y_true = 1 AND mse > 1.5) AS tp FROM eval_scores")


def _r(a, b):
    return f"CASE WHEN ({b}) = 0 THEN 0.0e0 ELSE CAST({a} AS DOUBLE) / ({b}) END"


def _f(p, r):
    return f"CASE WHEN ({p}) + ({r}) = 0 THEN 0.0e0 ELSE 2 * ({p}) * ({r}) / (({p}) + ({r})) END"


@register("eval_predict", "event_id:i, y_true:i, y_pred:i",
          "SELECT event_id, y_true, CAST(mse > 1.5 AS INT) AS y_pred FROM eval_scores")
def q_predict(spark, sf):
    return ev.predict(scores(spark, sf)).select("event_id", "y_true", "y_pred")


@register("eval_confusion", "tn:i, fp:i, fn:i, tp:i", CM)
def q_confusion(spark, sf):
    return ev.confusion(scores(spark, sf))


@register("eval_prf", "precision:d, recall:d, f1:d",
          f"SELECT p AS precision, r AS recall, {_f('p', 'r')} AS f1 FROM "
          f"(SELECT {_r('tp', 'tp + fp')} AS p, {_r('tp', 'tp + fn')} AS r FROM ({CM}) c) x")
def q_prf(spark, sf):
    return ev.prf(scores(spark, sf))


@register("eval_report", "label:s, precision:d, recall:d, f1:d, support:i",
          f"""WITH c AS ({CM}), m AS (
  SELECT *, tn + fp + fn + tp AS n, tp + fn AS s1, tn + fp AS s0,
         {_r('tp', 'tp + fp')} AS p1, {_r('tp', 'tp + fn')} AS r1,
         {_r('tn', 'tn + fn')} AS p0, {_r('tn', 'tn + fp')} AS r0 FROM c),
 f AS (SELECT *, {_f('p1', 'r1')} AS f1_1, {_f('p0', 'r0')} AS f1_0 FROM m)
SELECT '0' AS label, p0 AS precision, r0 AS recall, f1_0 AS f1, s0 AS support FROM f
UNION ALL SELECT '1', p1, r1, f1_1, s1 FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, {_r('tp + tn', 'n')}, n FROM f
UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f1_0 + f1_1) / 2, n FROM f
UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / CAST(n AS DOUBLE), (r0 * s0 + r1 * s1) / CAST(n AS DOUBLE),
                 (f1_0 * s0 + f1_1 * s1) / CAST(n AS DOUBLE), n FROM f""")
def q_report(spark, sf):
    return ev.report(scores(spark, sf))


# Oracle: the classical mid-rank form (average rank of positives), not the prefix-sum form.
@register("eval_auc", "roc_auc:d",
          """SELECT CASE WHEN p > 0 AND n > 0 THEN (rs - p * (p + 1) / 2.0e0) / (p * CAST(n AS DOUBLE)) END AS roc_auc
FROM (SELECT sum(CASE WHEN y_true = 1 THEN r END) AS rs, count(*) FILTER (WHERE y_true = 1) AS p,
             count(*) FILTER (WHERE y_true <> 1) AS n
      FROM (SELECT y_true, (rank() OVER (ORDER BY mse) + count(*) OVER (PARTITION BY mse) - 1 + rank() OVER (ORDER BY mse)) / 2.0e0 AS r
            FROM eval_scores) rk) a""")
def q_auc(spark, sf):
    return ev.auc(scores(spark, sf), score="mse")


@register("eval_sweep", "threshold:d, precision:d, recall:d, f1:d",
          "SELECT threshold, CASE WHEN pp = 0 THEN NULL ELSE " + _r("tp", "pp") + " END AS precision, "
          "CASE WHEN pp = 0 THEN NULL ELSE " + _r("tp", "P") + " END AS recall, "
          "CASE WHEN pp = 0 THEN NULL ELSE " + _f(_r("tp", "pp"), _r("tp", "P")) + " END AS f1 FROM ("
          "SELECT t.threshold, count(*) FILTER (WHERE mse > t.threshold) AS pp, "
          "count(*) FILTER (WHERE mse > t.threshold AND y_true = 1) AS tp, "
          "(SELECT count(*) FROM eval_scores WHERE y_true = 1) AS P "
          "FROM eval_scores, (VALUES (0.5e0), (1.0e0), (1.5e0), (2.0e0), (2.5e0), (3.0e0), (5.0e0)) t(threshold) "
          "GROUP BY t.threshold) s")
def q_sweep(spark, sf):
    return ev.sweep(scores(spark, sf))


# Scores and labels with gaps: NULL and NaN scores are predicted 0, NULL labels are the negative class.
GAPS = [("gaps", "SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 0 ELSE y_true END AS y_true, "
                 "CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 THEN -1.0e0 ELSE mse END AS mse FROM eval_scores")]


def gaps(spark, sf):
    return fixtures.eval_gaps(scores(spark, sf))


@register("eval_confusion_gaps", "tn:i, fp:i, fn:i, tp:i", CM.replace("eval_scores", "gaps"), GAPS)
def q_confusion_gaps(spark, sf):
    return ev.confusion(gaps(spark, sf))


@register("eval_predict_gaps", "event_id:i, y_pred:i", "SELECT event_id, CAST(mse > 1.5 AS INT) AS y_pred FROM gaps", GAPS)
def q_predict_gaps(spark, sf):
    return ev.predict(gaps(spark, sf)).select("event_id", "y_pred")


@register("eval_sweep_gaps", "threshold:d, precision:d, recall:d",
          "SELECT threshold, CASE WHEN pp = 0 THEN NULL ELSE " + _r("tp", "pp") + " END AS precision, "
          "CASE WHEN pp = 0 THEN NULL ELSE " + _r("tp", "P") + " END AS recall FROM ("
          "SELECT t.threshold, count(*) FILTER (WHERE mse > t.threshold) AS pp, "
          "count(*) FILTER (WHERE mse > t.threshold AND y_true = 1) AS tp, "
          "(SELECT count(*) FROM gaps WHERE y_true = 1) AS P "
          "FROM gaps, (VALUES (0.5e0), (1.0e0), (1.5e0), (2.0e0), (2.5e0), (3.0e0), (5.0e0)) t(threshold) "
          "GROUP BY t.threshold) s", GAPS)
def q_sweep_gaps(spark, sf):
    return ev.sweep(gaps(spark, sf))


@register("eval_auc_gaps", "roc_auc:d", "SELECT CAST(NULL AS DOUBLE) AS roc_auc", GAPS)
def q_auc_gaps(spark, sf):
    """A score without a rank leaves no AUC."""
    return ev.auc(gaps(spark, sf), score="mse")
