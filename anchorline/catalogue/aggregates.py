"""Aggregations and window functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from anchorline.catalogue.base import (
    COLUMNS, FEATURES, KEYS, STAT_SQL, cohort, features, fixed_long, labelled, long, matrix, query, r6, rounded,
)
from anchorline.catalogue.scans import FOLD_SCORES, event_scores
from anchorline.functions.ordered import quantiles_of_counts, value_counts
from anchorline.operators import cohort as members, features as feats, labels, quality
from anchorline.session import cut_lineage
from anchorline.sources import hospital


@query("agg_earliest", "SELECT * FROM cultures")
def agg_earliest(spark, sf_dir):
    return members.earliest_times(members.positive_cultures(hospital.micro(spark, sf_dir)))


def _pivot(family: str):
    names = hospital.NAMES[family]
    columns = ", ".join(f"max(CASE WHEN concept_name = '{n}' THEN value_as_number END) AS {n}" for n in names)

    @query(
        f"pivot_sequence_{family}s",
        f"SELECT micro_specimen_id, person_id, rn, {columns} FROM sequence WHERE family = '{family}' GROUP BY 1, 2, 3",
    )
    def pivoted(spark, sf_dir):
        numbered = feats.sequence_numbers(fixed_long(spark, sf_dir)).where(F.col("family") == family)
        return feats.pivot_sequence(numbered, KEYS, {n: n for n in names})

    return pivoted


pivot_sequence_vitals, pivot_sequence_labs = _pivot("vital"), _pivot("lab")


def _statistic(s: str):
    names = [f"{c}_{s}" for c in COLUMNS]
    columns = ", ".join(f"round({STAT_SQL[s].format(n=c)}, 6) AS {c}_{s}" for c in COLUMNS)

    @query(f"stat_{s}", f"SELECT micro_specimen_id, person_id, {columns} FROM long GROUP BY 1, 2")
    def statistic(spark, sf_dir):
        return rounded(feats.feature_stats(long(spark, sf_dir), KEYS, COLUMNS, (s,)), names)

    return statistic


for _s in feats.STATISTICS:
    _statistic(_s)


@query("feature_stats_all", f"SELECT micro_specimen_id, person_id, {r6(FEATURES)} FROM features")
def feature_stats_all(spark, sf_dir):
    return rounded(features(spark, sf_dir), FEATURES)


@query("distinct_rows", "SELECT DISTINCT person_id, concept_name, family FROM long")
def distinct_rows(spark, sf_dir):
    return long(spark, sf_dir).select("person_id", "concept_name", "family").distinct()


_MISSING_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing FROM matrix" for c in FEATURES
)


@query(
    "missing_counts",
    f"SELECT column_name, missing, CAST(count(*) FILTER (WHERE missing = 0) OVER () AS BIGINT) AS complete_columns FROM ({_MISSING_SQL})",
)
def missing_counts(spark, sf_dir):
    counts = quality.missing_counts(matrix(spark, sf_dir), FEATURES)
    complete = counts.agg(F.count_if(F.col("missing") == 0)).scalar()
    return counts.withColumn("complete_columns", complete)


@query(
    "order_by_missing",
    f"SELECT column_name, missing, row_number() OVER (ORDER BY missing, column_name) AS position FROM ({_MISSING_SQL})",
)
def order_by_missing(spark, sf_dir):
    """Columns by ascending missing count; the table has one row per column, so one task orders it."""
    counts = quality.missing_counts(matrix(spark, sf_dir), FEATURES)
    listed = F.sort_array(F.collect_list(F.struct("missing", "column_name")))
    placed = counts.agg(listed.alias("l")).select(F.posexplode("l"))
    return placed.select("col.column_name", "col.missing", (F.col("pos") + 1).cast("long").alias("position"))


@query("class_counts", "SELECT target, count(*) AS n FROM labelled GROUP BY target")
def class_counts(spark, sf_dir):
    return labels.class_counts(labelled(spark, sf_dir))


@query(
    "shape_report",
    """SELECT 'cohort' AS stage, count(*) AS n_rows, 4 AS n_columns FROM cohort
       UNION ALL SELECT 'long', count(*), 9 FROM long
       UNION ALL SELECT 'features', count(*), 26 FROM features
       UNION ALL SELECT 'matrix', count(*), 28 FROM matrix""",
)
def shape_report(spark, sf_dir):
    stages = {
        "cohort": cohort(spark, sf_dir), "long": long(spark, sf_dir), "features": features(spark, sf_dir),
        "matrix": matrix(spark, sf_dir),
    }
    return quality.shape_report(stages)


@query(
    "coverage_report",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS total, count(*) - count({c}) AS missing, round(100.0 * count({c}) / count(*), 6) AS coverage_pct FROM matrix"
        for c in FEATURES
    ),
)
def coverage_report(spark, sf_dir):
    return rounded(quality.coverage(matrix(spark, sf_dir), FEATURES), ["coverage_pct"])


@query("summarise_scores", f"WITH {FOLD_SCORES} SELECT model, metric, round(avg(value), 6) AS mean_value FROM tidy GROUP BY 1, 2")
def summarise_scores(spark, sf_dir):
    means = event_scores(spark, sf_dir).groupBy("model", "metric").agg(F.avg("value").alias("mean_value"))
    return rounded(means, ["mean_value"])


@query(
    "boxplot_summary",
    f"""WITH {FOLD_SCORES} SELECT model, metric, round(min(value), 6) AS low, round(quantile_cont(value, 0.25), 6) AS q1,
        round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3,
        round(max(value), 6) AS high FROM tidy GROUP BY 1, 2""",
)
def boxplot_summary(spark, sf_dir):
    group = ["model", "metric"]
    scores = cut_lineage(event_scores(spark, sf_dir))
    counts = value_counts(scores, group, "value")
    quartiles = quantiles_of_counts(counts, group, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    ends = counts.groupBy(*group).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return rounded(quartiles.join(ends, group), ["low", "q1", "median", "q3", "high"])


@query("sequence_number", "SELECT micro_specimen_id, measurement_id, person_id, concept_name, rn FROM sequence")
def sequence_number(spark, sf_dir):
    return feats.sequence_numbers(fixed_long(spark, sf_dir)).select(
        "micro_specimen_id", "measurement_id", "person_id", "concept_name", "rn"
    )


_WINDOWED = ["value_as_number_max", "value_as_number_min", "value_as_number_avg", "value_as_number_sd"]


@query(
    "window_partition_agg",
    """SELECT measurement_id, person_id, round(max(value_as_number) OVER w, 6) AS value_as_number_max,
       round(min(value_as_number) OVER w, 6) AS value_as_number_min, round(avg(value_as_number) OVER w, 5) AS value_as_number_avg,
       round(stddev_samp(value_as_number) OVER w, 6) AS value_as_number_sd
       FROM measurement WINDOW w AS (PARTITION BY person_id)""",
)
def window_partition_agg(spark, sf_dir):
    rows = feats.whole_partition_stats(hospital.measurement(spark, sf_dir), "person_id", "value_as_number")
    # a mean of 32 numbers with two decimals can end in a 5 at the seventh digit, where rounding may go
    # either way: the mean is compared to five digits
    exact = [c for c in _WINDOWED if c != "value_as_number_avg"]
    return rounded(rounded(rows.select("measurement_id", "person_id", *_WINDOWED), exact), ["value_as_number_avg"], 5)


@query(
    "window_first_value",
    """SELECT measurement_id, person_id,
       first_value(value_as_number) OVER (PARTITION BY person_id ORDER BY CASE WHEN value_as_number IS NULL THEN 1 ELSE 0 END,
         measurement_datetime, measurement_id) AS value_as_number_first,
       first_value(value_as_number) OVER (PARTITION BY person_id ORDER BY CASE WHEN value_as_number IS NULL THEN 1 ELSE 0 END,
         measurement_datetime DESC, measurement_id DESC) AS value_as_number_last FROM measurement""",
)
def window_first_value(spark, sf_dir):
    rows = feats.first_known_value(
        hospital.measurement(spark, sf_dir), "person_id", "value_as_number", ["measurement_datetime", "measurement_id"]
    )
    return rows.select("measurement_id", "person_id", "value_as_number_first", "value_as_number_last")


@query(
    "rank_candidates",
    f"""WITH {FOLD_SCORES}, means AS (SELECT model, metric, avg(value) AS mean_value FROM tidy GROUP BY 1, 2)
        SELECT model, metric, round(mean_value, 6) AS mean_value,
        row_number() OVER (PARTITION BY metric ORDER BY round(mean_value, 9) DESC, model) AS rank FROM means""",
)
def rank_candidates(spark, sf_dir):
    means = event_scores(spark, sf_dir).groupBy("model", "metric").agg(F.avg("value").alias("mean_value"))
    return rounded(feats.rank_candidates(means, ["metric"], "mean_value", "model"), ["mean_value"])
