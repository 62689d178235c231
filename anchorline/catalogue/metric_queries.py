"""Scores of predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from anchorline.catalogue.base import query, rounded, scored
from anchorline.catalogue.scans import FOLD_SCORES, event_scores
from anchorline.functions import metrics
from anchorline.sources import hospital

GROUP = ["model"]


@query("metric_confusion", "SELECT * FROM confusion")
def metric_confusion(spark, sf_dir):
    return metrics.confusion(scored(spark, sf_dir), GROUP)


_CONFUSED = {
    "accuracy": (metrics.accuracy, "(tp + tn) / CAST(tp + fp + tn + fn AS DOUBLE)"),
    "balanced_accuracy": (
        metrics.balanced_accuracy,
        "(CAST(tp AS DOUBLE) / nullif(tp + fn, 0) + CAST(tn AS DOUBLE) / nullif(tn + fp, 0)) / 2.0",
    ),
    "f1": (metrics.f1, "coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0.0)"),
}


def _confused(name: str):
    make, sql = _CONFUSED[name]

    @query(f"metric_{name}", f"SELECT model, round({sql}, 6) AS {name} FROM confusion")
    def metric(spark, sf_dir):
        counts = metrics.confusion(scored(spark, sf_dir), GROUP)
        return rounded(counts.select("model", make().alias(name)), [name])

    return metric


for _name in _CONFUSED:
    _confused(_name)


@query(
    "metric_auroc",
    """SELECT model, round(sum(pos * (fp_total - fp + neg / 2.0)) / (CAST(max(tp_total) AS DOUBLE) * max(fp_total)), 6) AS auroc
       FROM curve GROUP BY model""",
)
def metric_auroc(spark, sf_dir):
    return rounded(metrics.auroc(metrics.thresholds(scored(spark, sf_dir), GROUP), GROUP), ["auroc"])


@query(
    "metric_average_precision",
    """SELECT model, round(sum((CAST(pos AS DOUBLE) / tp_total) * (CAST(tp AS DOUBLE) / (tp + fp))), 6) AS average_precision
       FROM curve GROUP BY model""",
)
def metric_average_precision(spark, sf_dir):
    curve = metrics.thresholds(scored(spark, sf_dir), GROUP)
    return rounded(metrics.average_precision(curve, GROUP), ["average_precision"])


@query(
    "metric_r2",
    """SELECT event_type, round(1.0 - sum(power(value - p * 500, 2)) / (var_pop(value) * count(value)), 6) AS r2
       FROM (SELECT event_type, value, floor(value / 5.0) / 100.0 AS p FROM events) GROUP BY event_type""",
)
def metric_r2(spark, sf_dir):
    estimate = F.floor(F.col("value") / F.lit(5.0)) / F.lit(100.0) * 500
    rows = hospital.table(spark, sf_dir, "events").withColumn("estimate", estimate)
    return rounded(metrics.r_squared(rows, ["event_type"], "value", "estimate"), ["r2"])


@query(
    "mcc_f1_curve",
    "SELECT model, score, round(mcc, 6) AS mcc, round(f1, 6) AS f1 FROM mcc_points WHERE mcc IS NOT NULL",
)
def mcc_f1_curve(spark, sf_dir):
    curve = metrics.thresholds(scored(spark, sf_dir), GROUP)
    return rounded(metrics.mcc_f1_curve(curve, GROUP), ["mcc", "f1"])


@query(
    "metric_mcc_f1",
    """WITH ends AS (SELECT model, min(mcc) AS low, max(mcc) AS high FROM mcc_points GROUP BY 1),
       best AS (SELECT q.model, low, high, max(score) AS peak FROM mcc_points q JOIN ends e
         ON q.model = e.model AND q.mcc = e.high GROUP BY 1, 2, 3),
       ranges AS (SELECT q.model, score >= peak AS upper,
         least(coalesce(floor((mcc - low) / nullif((high - low) / 100.0, 0)), 0), 99) AS bin,
         avg(sqrt(power(mcc - 1.0, 2) + power(f1 - 1.0, 2))) AS d
         FROM mcc_points q JOIN best b ON q.model = b.model WHERE mcc IS NOT NULL GROUP BY 1, 2, 3)
       SELECT model, round(1.0 - avg(d) / sqrt(2.0), 6) AS mcc_f1 FROM ranges GROUP BY model""",
)
def metric_mcc_f1(spark, sf_dir):
    points = metrics.mcc_f1_curve(metrics.thresholds(scored(spark, sf_dir), GROUP), GROUP)
    return rounded(metrics.mcc_f1(points, GROUP), ["mcc_f1"])


@query("scores_long", f"WITH {FOLD_SCORES} SELECT model, fold, metric, round(value, 6) AS value FROM tidy")
def scores_long(spark, sf_dir):
    return rounded(event_scores(spark, sf_dir), ["value"])


@query(
    "scores_wide",
    f"WITH {FOLD_SCORES} SELECT model, "
    + ", ".join(f"round(avg({m}), 6) AS {m}" for m in metrics.METRICS)
    + " FROM wide GROUP BY model",
)
def scores_wide(spark, sf_dir):
    return rounded(metrics.scores_wide(event_scores(spark, sf_dir), GROUP), metrics.METRICS)
