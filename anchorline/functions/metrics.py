"""Scores of binary predictions per group, from a frame with a group, ``y`` in {0, 1} and ``p``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from anchorline.functions.encode import binarize
from anchorline.functions.ordered import running_sums
from anchorline.session import cut_lineage


def confusion(pred: DataFrame, group: Sequence[str], y: str = "y", p: str = "p", threshold: float = 0.5) -> DataFrame:
    hit = binarize(p, threshold)
    truth = F.col(y)
    return pred.groupBy(*group).agg(
        F.count_if((truth == 1) & (hit == 1)).alias("tp"),
        F.count_if((truth == 0) & (hit == 1)).alias("fp"),
        F.count_if((truth == 0) & (hit == 0)).alias("tn"),
        F.count_if((truth == 1) & (hit == 0)).alias("fn"),
    )


def accuracy() -> Column:
    return F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"))


def balanced_accuracy() -> Column:
    sensitivity = F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    specificity = F.try_divide(F.col("tn"), F.col("tn") + F.col("fp"))
    return (sensitivity + specificity) / 2.0


def f1() -> Column:
    """0 when nothing is positive, neither truly nor predicted."""
    return F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))


def score_counts(pred: DataFrame, group: Sequence[str], y: str = "y", p: str = "p") -> DataFrame:
    """Positive and negative rows per group and distinct score."""
    return pred.groupBy(*group, F.col(p).alias("score")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg")
    )


def thresholds(pred: DataFrame, group: Sequence[str], y: str = "y", p: str = "p") -> DataFrame:
    """One row per group and distinct score: rows at the score (``pos``, ``neg``), rows at or above it
    (``tp``, ``fp``) and the class totals (``tp_total``, ``fp_total``)."""
    return running_sums(score_counts(pred, group, y, p), group, "score", {"tp": "pos", "fp": "neg"}, descending=True)


def _auroc() -> Column:
    below = F.col("fp_total") - F.col("fp") + F.col("neg") / 2.0
    return F.try_divide(F.sum(F.col("pos") * below), F.max("tp_total").cast("double") * F.max("fp_total"))


def _average_precision() -> Column:
    gain = F.try_divide(F.col("pos").cast("double"), F.col("tp_total")) * (F.col("tp") / (F.col("tp") + F.col("fp")))
    return F.sum(gain)


def auroc(curve: DataFrame, group: Sequence[str]) -> DataFrame:
    """Share of (positive, negative) pairs ranked rightly, ties counting half."""
    return curve.groupBy(*group).agg(_auroc().alias("auroc"))


def average_precision(curve: DataFrame, group: Sequence[str]) -> DataFrame:
    """Sum over thresholds of recall gained times precision (steps, no interpolation)."""
    return curve.groupBy(*group).agg(_average_precision().alias("average_precision"))


def mcc_f1_curve(curve: DataFrame, group: Sequence[str]) -> DataFrame:
    """Unit-normalised Matthews coefficient and F1 at every threshold where the coefficient is defined."""
    tp, fp = F.col("tp").cast("double"), F.col("fp").cast("double")
    fn, tn = F.col("tp_total") - tp, F.col("fp_total") - fp
    spread = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    mcc = F.try_divide(tp * tn - fp * fn, spread)
    return curve.select(
        *group, "score", ((mcc + 1.0) / 2.0).alias("mcc"), (2.0 * tp / (2.0 * tp + fp + fn)).alias("f1")
    ).where(F.col("mcc").isNotNull())


def mcc_f1(points: DataFrame, group: Sequence[str], bins: int = 100) -> DataFrame:
    """1 - mean distance of the curve to (1, 1), over sqrt 2 (Cao, Chicco and Hoffman, 2020).

    Distances are averaged inside equal MCC ranges first, apart for the thresholds down to the best
    one and for those below it, and then over the ranges that hold a point.
    """
    best = F.max(F.struct("mcc", "score"))
    ends = points.groupBy(*group).agg(F.min("mcc").alias("__low"), best.alias("__best"))
    ends = ends.select(*group, "__low", F.col("__best.mcc").alias("__high"), F.col("__best.score").alias("__at"))
    width = (F.col("__high") - F.col("__low")) / F.lit(float(bins))
    number = F.coalesce(F.floor(F.try_divide(F.col("mcc") - F.col("__low"), width)), F.lit(0))
    distance = F.sqrt(F.pow(F.col("mcc") - 1.0, 2) + F.pow(F.col("f1") - 1.0, 2))
    ranged = points.join(ends, list(group)).select(
        *group,
        (F.col("score") >= F.col("__at")).alias("__upper"),
        F.least(number, F.lit(bins - 1)).alias("__bin"),
        distance.alias("__d"),
    )
    cells = ranged.groupBy(*group, "__upper", "__bin").agg(F.avg("__d").alias("__d"))
    return cells.groupBy(*group).agg((1.0 - F.avg("__d") / F.sqrt(F.lit(2.0))).alias("mcc_f1"))


def r_squared(df: DataFrame, group: Sequence[str], truth: str, estimate: str) -> DataFrame:
    """1 - residual over total sum of squares; the total comes from the population variance."""
    return df.groupBy(*group).agg(
        (
            1.0
            - F.try_divide(
                F.sum(F.pow(F.col(truth) - F.col(estimate), 2)), F.var_pop(truth) * F.count(F.col(truth))
            )
        ).alias("r2")
    )


def score_table(pred: DataFrame, group: Sequence[str], y: str = "y", p: str = "p", bins: int = 100) -> DataFrame:
    """All six scores per group as columns.

    The predictions are read once, into a stored table of their distinct scores; the curve over it is stored as well,
    as three scores are read from it.
    """
    scored = cut_lineage(score_counts(pred, group, y, p))
    hit = binarize("score", 0.5)
    cells = {"tp": ("pos", 1), "fp": ("neg", 1), "tn": ("neg", 0), "fn": ("pos", 0)}
    counts = scored.groupBy(*group).agg(
        *[F.coalesce(F.sum(F.when(hit == side, F.col(n))), F.lit(0)).alias(c) for c, (n, side) in cells.items()]
    )
    counts = counts.select(
        *group,
        accuracy().alias("accuracy"),
        balanced_accuracy().alias("balanced_accuracy"),
        f1().alias("f1"),
    )
    curve = cut_lineage(running_sums(scored, group, "score", {"tp": "pos", "fp": "neg"}, descending=True))
    areas = curve.groupBy(*group).agg(_auroc().alias("auroc"), _average_precision().alias("average_precision"))
    return counts.join(areas, list(group), "left").join(
        mcc_f1(mcc_f1_curve(curve, group), group, bins), list(group), "left"
    )


METRICS = ["accuracy", "balanced_accuracy", "average_precision", "f1", "auroc", "mcc_f1"]


def scores_long(wide: DataFrame, keys: Sequence[str], metrics: Sequence[str] = METRICS) -> DataFrame:
    """Tidy form: one row per key, metric and value."""
    return wide.unpivot(list(keys), list(metrics), "metric", "value")


def scores_wide(long: DataFrame, keys: Sequence[str], metrics: Sequence[str] = METRICS) -> DataFrame:
    """One row per key with the mean of every metric."""
    return long.groupBy(*keys).pivot("metric", list(metrics)).agg(F.avg("value"))
