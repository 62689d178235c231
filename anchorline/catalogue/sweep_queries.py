"""Sweeps: one pass for all settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from anchorline.catalogue.base import (
    COLUMNS, FEATURES, KEYS, STAT_SQL, anchored, fixed_matrix, labelled, matrix, query, r6, rounded,
)
from anchorline.catalogue.sampling import ID, RANKED_SQL, RATIO_SQL, class_ratio_samples
from anchorline.operators import features as feats, labels, quality, scaling
from anchorline.plans.sweeps import AFTER_HOURS, window_runs
from anchorline.sources import hospital


@query(
    "sweep_windows",
    " UNION ALL ".join(
        f"""SELECT 'micro_vb_24_va_{a}_lb_24_la_{a}' AS run_id, micro_specimen_id, person_id,
            {', '.join(f"round({STAT_SQL[s].format(n=n)}, 6) AS {n}_{s}" for s in feats.STATISTICS for n in COLUMNS)}
            FROM (SELECT m.*, t.concept_name, t.family, c.micro_specimen_id FROM measurement m
              JOIN concept t ON t.concept_id = m.measurement_concept_id JOIN cohort c ON c.person_id = m.person_id
              WHERE t.family IN ('vital', 'lab') AND m.value_as_number IS NOT NULL
                AND m.measurement_datetime > c.chart_time - INTERVAL '24' HOUR
                AND m.measurement_datetime < c.chart_time + INTERVAL '{a}' HOUR) GROUP BY 1, 2, 3
            HAVING count(*) FILTER (WHERE family = 'vital') > 0 AND count(*) FILTER (WHERE family = 'lab') > 0"""
        for a in AFTER_HOURS
    ),
)
def sweep_windows(spark, sf_dir):
    rows = feats.sweep_windows(
        hospital.measurement(spark, sf_dir), hospital.concept(spark), anchored(spark, sf_dir), window_runs("micro")
    )
    return rounded(feats.feature_stats(rows, ["run_id", *KEYS], COLUMNS, require=["vital", "lab"]), FEATURES)


@query(
    "sweep_sample_size",
    f"""SELECT s.n AS sample_size, micro_specimen_id FROM ({RANKED_SQL}) q
        JOIN (VALUES {', '.join(f'({n})' for n in labels.SAMPLE_SIZES)}) AS s(n) ON r <= s.n""",
)
def sweep_sample_size(spark, sf_dir):
    return labels.sample_sizes(labelled(spark, sf_dir).select(*ID), labels.SAMPLE_SIZES, ID)


@query("sweep_class_ratio", f"{RATIO_SQL} SELECT ratio, target, count(*) AS n FROM drawn GROUP BY 1, 2")
def sweep_class_ratio(spark, sf_dir):
    return class_ratio_samples(spark, sf_dir).groupBy("ratio", "target").agg(F.count(F.lit(1)).alias("n"))


THRESHOLDS = list(range(20, 100, 5))


@query(
    "sweep_missingness",
    f"""SELECT max_missing_pct, column_name FROM (SELECT column_name, 100.0 * (count(*) - count(value)) / count(*) AS pct
        FROM melted GROUP BY 1) JOIN (VALUES {', '.join(f'({t})' for t in THRESHOLDS)}) AS t(max_missing_pct)
        ON pct <= max_missing_pct""",
)
def sweep_missingness(spark, sf_dir):
    """Which columns each threshold keeps: one coverage table serves all thresholds."""
    report = quality.coverage(matrix(spark, sf_dir), FEATURES)
    fitting = F.filter(F.array(*[F.lit(t) for t in THRESHOLDS]), lambda t: 100.0 - F.col("coverage_pct") <= t)
    return report.select(F.explode(fitting).alias("max_missing_pct"), "column_name")


@query(
    "sweep_scaling",
    f"""SELECT 'none' AS scaling, micro_specimen_id, {r6(FEATURES)} FROM matrix
        UNION ALL SELECT 'standard', micro_specimen_id, {r6(FEATURES)} FROM scaled
        UNION ALL SELECT 'minmax', micro_specimen_id, {', '.join(
            f"round(({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0), 6) + 0.0 AS {c}"
            for c in FEATURES)} FROM matrix""",
)
def sweep_scaling(spark, sf_dir):
    return rounded(scaling.all_scalings(fixed_matrix(spark, sf_dir), ID, FEATURES), FEATURES)
