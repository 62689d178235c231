"""From long measurements around an anchor to one wide row per member."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from anchorline.functions.ordered import row_numbers, with_tie_bucket
from anchorline.functions.times import plus_hours, strictly_between
from anchorline.operators.intervals import point_in_interval_join

STATISTICS = ("max", "min", "avg", "sd", "first", "last")


def filter_concepts(measurements: DataFrame, concept_ids: Sequence[int]) -> DataFrame:
    return measurements.where(
        F.col("measurement_concept_id").isin(list(concept_ids)) & F.col("value_as_number").isNotNull()
    )


def name_concepts(measurements: DataFrame, concept: DataFrame) -> DataFrame:
    """Attach concept name and family. The dictionary is not forced to be broadcast: its size decides."""
    return measurements.join(
        concept.withColumnRenamed("concept_id", "measurement_concept_id"), "measurement_concept_id"
    )


Windows = Mapping[str, tuple[int, int]]


def _widest_window(
    measurements: DataFrame,
    concept: DataFrame,
    cohort: DataFrame,
    runs: Sequence[Windows],
    keys: Sequence[str],
    on: str,
    anchor: str,
    concept_ids: Sequence[int] | None,
    salts: int,
) -> DataFrame:
    """Named measurements of the listed families inside the widest window of all runs, with ``__anchor``."""
    rows = measurements.where(F.col("value_as_number").isNotNull())
    if concept_ids:
        rows = filter_concepts(rows, concept_ids)
    families = sorted({f for windows in runs for f in windows})
    before = max(b for windows in runs for b, _ in windows.values())
    after = max(a for windows in runs for _, a in windows.values())
    named = name_concepts(rows, concept.where(F.col("family").isin(families)))
    members = cohort.select(
        *dict.fromkeys([*keys, on]),
        F.col(anchor).alias("__anchor"),
        plus_hours(anchor, -before).alias("__from"),
        plus_hours(anchor, after).alias("__to"),
    )
    joined = point_in_interval_join(
        named, members, [on], "measurement_datetime", "__from", "__to", closed=False,
        slot_hours=max(24, before + after), salts=salts,
    )
    return joined.drop("__from", "__to")


def _inside(before: Column | int, after: Column | int) -> Column:
    low, high = plus_hours("__anchor", -before), plus_hours("__anchor", after)
    return strictly_between("measurement_datetime", low, high)


def window_measurements(
    measurements: DataFrame,
    concept: DataFrame,
    cohort: DataFrame,
    windows: Windows,
    keys: Sequence[str] = ("micro_specimen_id",),
    on: str = "person_id",
    anchor: str = "anchor_time",
    concept_ids: Sequence[int] | None = None,
    salts: int = 1,
) -> DataFrame:
    """Measurements strictly inside ``anchor - before .. anchor + after`` hours, per concept family.

    One scan serves all families: the interval join uses the widest window and the family's own bounds
    are tested on its output. Concepts outside the listed families are dropped.
    """
    joined = _widest_window(measurements, concept, cohort, [windows], keys, on, anchor, concept_ids, salts)
    bounds = F.lit(False)
    for family, (before, after) in windows.items():
        bounds = bounds | ((F.col("family") == family) & _inside(before, after))
    return joined.where(bounds).drop("__anchor")


def sweep_windows(
    measurements: DataFrame,
    concept: DataFrame,
    cohort: DataFrame,
    runs: Mapping[str, Windows],
    keys: Sequence[str] = ("micro_specimen_id",),
    on: str = "person_id",
    anchor: str = "anchor_time",
    concept_ids: Sequence[int] | None = None,
    salts: int = 1,
) -> DataFrame:
    """The windows of many runs from one scan and one join, told apart by ``run_id``."""
    joined = _widest_window(
        measurements, concept, cohort, list(runs.values()), keys, on, anchor, concept_ids, salts
    )
    spans = F.array(
        *[
            F.struct(
                F.lit(run).alias("run_id"), F.lit(family).alias("f"), F.lit(b).alias("b"), F.lit(a).alias("a")
            )
            for run, windows in runs.items()
            for family, (b, a) in windows.items()
        ]
    )
    fitting = F.filter(spans, lambda r: (r["f"] == F.col("family")) & _inside(r["b"], r["a"]))
    return joined.withColumn("__run", F.explode(fitting)).withColumn("run_id", F.col("__run.run_id")).drop(
        "__run", "__anchor"
    )


def sequence_numbers(
    long: DataFrame,
    group: Sequence[str] = ("person_id", "concept_name"),
    time: str = "measurement_datetime",
    ties: Sequence[str] = ("measurement_id", "micro_specimen_id"),
) -> DataFrame:
    """Running number of each measurement in its group by time, ties in a fixed order.

    Reads ``long`` several times (count, cuts, cell counts, ranks): pass stored rows, not the join itself. Rows of one
    instant are told apart by the first tie-break, so an instant that holds much of the table covers many cells.
    """
    return row_numbers(with_tie_bucket(long, time, ties[0]), list(group), [time, *ties], "rn")


def pivot_sequence(long: DataFrame, keys: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """One row per key and sequence number, one column per concept name."""
    return long.groupBy(*keys, "rn").agg(
        *[
            F.max(F.when(F.col("concept_name") == name, F.col("value_as_number"))).alias(column)
            for name, column in columns.items()
        ]
    )


def statistic(name: str, value: str, order: Column) -> Column:
    return {
        "max": F.max(value),
        "min": F.min(value),
        "avg": F.avg(value),
        "sd": F.stddev_samp(value),
        "first": F.min_by(value, order),
        "last": F.max_by(value, order),
    }[name].alias(name)


def long_stats(
    long: DataFrame,
    keys: Sequence[str],
    statistics: Sequence[str] = STATISTICS,
    value: str = "value_as_number",
    time: str = "measurement_datetime",
    tiebreak: str | None = "measurement_id",
) -> DataFrame:
    """Statistics per key and concept in one aggregate that combines before the shuffle.

    ``tiebreak=None`` orders first/last by time alone, which stays in a hash aggregate and is about
    twice as fast, for sources whose times are unique per key and concept.
    """
    order = F.struct(time, tiebreak) if tiebreak else F.col(time)
    return (
        long.where(F.col(value).isNotNull())
        .groupBy(*keys, "family", "concept_name")
        .agg(*[statistic(s, value, order) for s in statistics])
    )


def feature_stats(
    long: DataFrame,
    keys: Sequence[str],
    columns: Mapping[str, str],
    statistics: Sequence[str] = STATISTICS,
    require: Sequence[str] = (),
    **options,
) -> DataFrame:
    """Wide ``<column>_<statistic>`` features per key; ``columns`` maps concept names to prefixes.

    The long aggregate shuffles once on (key, concept); the pivot then handles at most one row per
    concept and key. ``require`` keeps keys that have a measurement of each listed family.
    """
    stats = long_stats(long, keys, statistics, **options)
    wide = stats.groupBy(*keys).agg(
        *[F.count_if(F.col("family") == f).alias(f"__n_{f}") for f in require],
        *[
            F.max(F.when(F.col("concept_name") == name, F.col(s))).alias(f"{column}_{s}")
            for s in statistics
            for name, column in columns.items()
        ],
    )
    for f in require:
        wide = wide.where(F.col(f"__n_{f}") > 0)
    return wide.drop(*[f"__n_{f}" for f in require])


def feature_stats_unfused(
    long: DataFrame, keys: Sequence[str], families: Mapping[str, Mapping[str, str]], statistics: Sequence[str] = STATISTICS
) -> DataFrame:
    """The same features as one table per family and statistic joined on the key: the shape that
    ``feature_stats`` replaces, kept as its measure in the bench and as a check in the tests."""
    joined = None
    for family, columns in families.items():
        for s in statistics:
            part = feature_stats(long.where(F.col("family") == family), keys, columns, (s,))
            joined = part if joined is None else joined.join(part, list(keys))
    return joined


SUFFIXES = {"sd": ("sd", "stddev")}  # the file form of the matrix spells deviations out


def feature_views(columns: Sequence[str], families: Mapping[str, Sequence[str]]) -> dict[str, list[str]]:
    """Column lists per family and statistic, for instance ``vital_max``; absent columns are skipped."""
    present = set(columns)
    return {
        f"{family}_{s}": [f"{c}_{end}" for c in prefixes for end in SUFFIXES.get(s, (s,)) if f"{c}_{end}" in present]
        for family, prefixes in families.items()
        for s in STATISTICS
    }


def matrix(
    cohort: DataFrame,
    features: DataFrame,
    outcome: DataFrame,
    keys: Sequence[str],
    statics: DataFrame | None = None,
) -> DataFrame:
    """Members with anchor time, features, outcome time and, where given, static attributes.

    A member with several cohort rows (overlapping stays) has one row here, with the earliest anchor: members and
    outcomes are brought to one row per key before they are joined, so repeated rows do not multiply. Several static
    rows of a member (overlapping visits) stay several.
    """
    keys = list(keys)
    times = [c for c in ("anchor_time", "chart_time") if c in cohort.columns]
    rows = cohort.groupBy(*keys).agg(*[F.min(c).alias(c) for c in times]) if times else cohort.select(*keys).distinct()
    rows = rows.join(outcome.groupBy(*keys).agg(F.min("death_datetime").alias("death_datetime")), keys)
    if statics is not None:
        rows = rows.join(statics, keys)
    others = [c for c in rows.columns if c not in (*keys, "death_datetime")]
    return rows.join(features, keys).select(*keys, *others, *[c for c in features.columns if c not in keys], "death_datetime")


def whole_partition_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """Max, min, mean and deviation of the key's rows on every row: ``agg OVER (PARTITION BY key)``.

    Written as aggregate plus join: the aggregate combines before its shuffle and the join can split a
    hot key, where a window would hold all rows of the key in one task.
    """
    order = F.lit(0)
    stats = df.groupBy(key).agg(
        *[statistic(s, value, order).alias(f"{value}_{s}") for s in ("max", "min", "avg", "sd")]
    )
    return df.join(stats, key)


def first_known_value(df: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """First and last non-null value of the key's rows on every row."""
    position = F.struct(*order)
    ends = df.groupBy(key).agg(
        F.min_by(value, F.when(F.col(value).isNotNull(), position)).alias(f"{value}_first"),
        F.max_by(value, F.when(F.col(value).isNotNull(), position)).alias(f"{value}_last"),
    )
    return df.join(ends, key)




def rank_candidates(candidates: DataFrame, group: Sequence[str], score: str, listed: str) -> DataFrame:
    """Rank 1 for the best mean score of a group, the first listed candidate winning ties.

    The input has one row per candidate of a search, so its windows are small. Scores are compared to
    nine digits: sums in another order must not break a tie.
    """
    order = Window.partitionBy(*group).orderBy(F.round(score, 9).desc(), listed)
    return candidates.withColumn("rank", F.row_number().over(order).cast("long"))
