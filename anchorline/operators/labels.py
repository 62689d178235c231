"""Outcome labels, censoring, and how rows are sampled, split and folded."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from anchorline.functions.ordered import hash_ranks
from anchorline.functions.times import plus_days, plus_hours

# fixed values: outcome windows in days; a number n means (0, n)
TARGETS = [7, 14, 21, 30, 60, 90, 120, (7, 14), (14, 21), (21, 30), (30, 60), (60, 90), (90, 120), (60, 120)]
SAMPLE_SIZES = [200, 300, 400, 500, 600, 700, 800, 900, 1000, 1500, 2000, 2500, 2971]
CLASS_RATIOS = ["50_50", "65_35", "70_30", "75_25", "80_20", "85_15", "90_10"]


def died_between(death: str, anchor: str, start_days: Column | int, end_days: Column | int) -> Column:
    """Death strictly inside the day window after the anchor; false for survivors."""
    inside = (F.col(death) > plus_days(anchor, start_days)) & (F.col(death) < plus_days(anchor, end_days))
    return F.coalesce(inside, F.lit(False))


def label_outcome(df: DataFrame, start_days: int, end_days: int, anchor="anchor_time", death="death_datetime") -> DataFrame:
    return df.withColumn("target", died_between(death, anchor, start_days, end_days))


def label_before(df: DataFrame, days: int, anchor="anchor_time", death="death_datetime") -> DataFrame:
    """One-sided form: death before the end of the window."""
    return df.withColumn("target", F.coalesce(F.col(death) < plus_days(anchor, days), F.lit(False)))


def target_spans(targets: Iterable[int | tuple[int, int]]) -> list[tuple[int, int]]:
    return [t if isinstance(t, tuple) else (0, t) for t in targets]


def label_targets(df: DataFrame, targets=TARGETS, anchor="anchor_time", death="death_datetime") -> DataFrame:
    """One labelled row per member and target window, all windows in one pass over the members."""
    spans = F.array(
        *[F.struct(F.lit(s).alias("start_days"), F.lit(e).alias("end_days")) for s, e in target_spans(targets)]
    )
    each = df.select("*", F.inline(spans))
    return each.withColumn("target", died_between(death, anchor, F.col("start_days"), F.col("end_days")))


def censor_early(df: DataFrame, hours: int, anchor="anchor_time", death="death_datetime") -> DataFrame:
    """Drop members who died before the end of the observation window."""
    return df.where(F.col(death).isNull() | (F.col(death) >= plus_hours(anchor, hours)))


def class_counts(df: DataFrame, target: str = "target") -> DataFrame:
    return df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))


def sample_n(df: DataFrame, n: int, ids: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly n rows (all, if there are fewer), the same ones for the same seed."""
    return hash_ranks(df, ids, seed, at_most=n, name="__rank").drop("__rank")


def sample_sizes(df: DataFrame, sizes: Sequence[int], ids: Sequence[str], seed: int = 42) -> DataFrame:
    """Samples of all sizes in one pass, one row per member and size."""
    ranked = hash_ranks(df, ids, seed, at_most=max(sizes), name="__rank")
    fitting = F.filter(F.array(*[F.lit(s) for s in sizes]), lambda s: s >= F.col("__rank"))
    return ranked.withColumn("sample_size", F.explode(fitting)).drop("__rank")


def class_sizes(positives: int, total: int = 1500, ratios: Sequence[str] = CLASS_RATIOS) -> dict[str, tuple[int, int]]:
    """Negatives and positives to draw per ratio label.

    The first two ratios use all positives and scale the negatives; the others share out ``total``.
    """
    sizes = {}
    for label in ratios:
        share = parse_ratio(label)
        if share < 70:
            sizes[label] = (positives * share // (100 - share), positives)
        else:
            sizes[label] = (total * share // 100, min(positives, int(total - total * share / 100)))
    return sizes


def parse_ratio(label: str) -> int:
    return int(label.split("_")[0])


def ratio_column(label: Column | str) -> Column:
    c = F.col(label) if isinstance(label, str) else label
    return F.split(c, "_")[0].cast("int")


def sample_class_ratio(
    df: DataFrame, sizes: Mapping[str, tuple[int, int]], ids: Sequence[str], target: str = "target", seed: int = 42
) -> DataFrame:
    """For every label ``negatives`` rows of class false and ``positives`` rows of class true, in one pass."""
    largest = max(max(pair) for pair in sizes.values())
    ranked = hash_ranks(df, ids, seed, group=[target], at_most=largest, name="__rank")
    table = F.array(
        *[
            F.struct(F.lit(label).alias("ratio"), F.lit(neg).alias("__neg"), F.lit(pos).alias("__pos"))
            for label, (neg, pos) in sizes.items()
        ]
    )
    wanted = F.when(F.col(target), F.col("__pos")).otherwise(F.col("__neg"))
    each = ranked.select("*", F.inline(table)).where(F.col("__rank") <= wanted)
    return each.drop("__rank", "__neg", "__pos")


def split_train_test(df: DataFrame, test_fraction: float, ids: Sequence[str], seed: int = 42) -> DataFrame:
    """Mark exactly ceil(fraction * n) rows as test; by id, so that all views of a row go the same way."""
    ranked = hash_ranks(df, ids, seed, name="__rank", total="__total")
    return ranked.withColumn("is_test", F.col("__rank") <= F.ceil(F.lit(test_fraction) * F.col("__total"))).drop(
        "__rank", "__total"
    )


def stratified_folds(df: DataFrame, target: str, ids: Sequence[str], k: int = 5, seed: int = 42) -> DataFrame:
    """Fold numbers 0..k-1 whose sizes differ by at most one inside each class."""
    ranked = hash_ranks(df, ids, seed, group=[target], name="__rank")
    return ranked.withColumn("fold", (F.col("__rank") % k).cast("int")).drop("__rank")


