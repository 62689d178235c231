"""Outliers, coverage, scaling, imputation and data-quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from anchorline.catalogue.base import FEATURES, fixed_long, fixed_matrix, matrix, query, r6, rounded
from anchorline.operators import impute, quality, scaling
from anchorline.sources import hospital

ID = "micro_specimen_id"


def _rejected_sql(family: str, usable: str) -> str:
    return f"""WITH part AS (SELECT * FROM long WHERE family = '{family}'),
        limits AS (SELECT concept_name, quantile_cont(value_as_number, 0.9999) AS lim FROM part GROUP BY 1),
        moments AS (SELECT p.concept_name, avg(value_as_number) AS mean, stddev_samp(value_as_number) AS sd
          FROM part p JOIN limits l ON l.concept_name = p.concept_name WHERE {usable} GROUP BY 1)
        SELECT micro_specimen_id, measurement_id, p.concept_name, value_as_number FROM part p
        JOIN moments m ON m.concept_name = p.concept_name WHERE abs((value_as_number - mean) / nullif(sd, 0)) <= 3"""


def _kept(rows):
    return rows.select(ID, "measurement_id", "concept_name", "value_as_number")


@query("reject_outliers_vitals", _rejected_sql("vital", "value_as_number < lim"))
def reject_outliers_vitals(spark, sf_dir):
    return _kept(quality.reject_vitals_outliers(fixed_long(spark, sf_dir).where(F.col("family") == "vital")))


@query("reject_outliers_labs", _rejected_sql("lab", "value_as_number <> 999999"))
def reject_outliers_labs(spark, sf_dir):
    return _kept(quality.reject_labs_outliers(fixed_long(spark, sf_dir).where(F.col("family") == "lab")))


@query(
    "drop_low_coverage",
    """WITH kept AS (SELECT column_name FROM melted GROUP BY 1 HAVING 100.0 * (count(*) - count(value)) / count(*) <= 25)
       SELECT micro_specimen_id, m.column_name, round(value, 6) + 0.0 AS value FROM melted m
       JOIN kept k ON k.column_name = m.column_name""",
)
def drop_low_coverage(spark, sf_dir):
    """The kept columns depend on the data, so the check compares them in long form."""
    kept = quality.drop_low_coverage(fixed_matrix(spark, sf_dir).select(ID, *FEATURES), FEATURES, 25)
    columns = [c for c in kept.columns if c != ID]
    return rounded(kept.unpivot([ID], columns, "column_name", "value"), ["value"])


@query("standard_scale", f"SELECT micro_specimen_id, {r6(FEATURES)} FROM scaled")
def standard_scale(spark, sf_dir):
    return rounded(scaling.standard_scale(fixed_matrix(spark, sf_dir).select(ID, *FEATURES), FEATURES), FEATURES)


@query(
    "standard_scale_all_but_key",
    """SELECT c_custkey, round((c_nationkey - avg(c_nationkey) OVER ()) / stddev_pop(c_nationkey) OVER (), 6) + 0.0 AS c_nationkey,
       round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) + 0.0 AS c_acctbal FROM customer""",
)
def standard_scale_all_but_key(spark, sf_dir):
    rows = hospital.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return rounded(scaling.standard_scale_all_but(rows, "c_custkey"), ["c_nationkey", "c_acctbal"])


@query(
    "minmax_rescale",
    "SELECT micro_specimen_id, "
    + ", ".join(
        f"round(({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0), 6) + 0.0 AS {c}" for c in FEATURES
    )
    + " FROM matrix",
)
def minmax_rescale(spark, sf_dir):
    return rounded(scaling.minmax_scale(fixed_matrix(spark, sf_dir).select(ID, *FEATURES), FEATURES), FEATURES)


def _filled_sql(value: str) -> str:
    return (
        "SELECT micro_specimen_id, "
        + ", ".join(f"round(coalesce({c}, {value.format(c=c)}), 6) + 0.0 AS {c}" for c in FEATURES)
        + " FROM matrix"
    )


@query("impute_mean", _filled_sql("avg({c}) OVER ()"))
def impute_mean(spark, sf_dir):
    return rounded(impute.impute_mean(fixed_matrix(spark, sf_dir).select(ID, *FEATURES), FEATURES), FEATURES)


@query("impute_median", _filled_sql("(SELECT quantile_cont({c}, 0.5) FROM matrix)"))
def impute_median(spark, sf_dir):
    return rounded(impute.impute_median(fixed_matrix(spark, sf_dir).select(ID, *FEATURES), FEATURES), FEATURES)


@query(
    "impute_mode",
    """WITH classed AS (SELECT measurement_id, CAST(floor(value_as_number / 10.0) AS BIGINT) AS class FROM measurement)
       SELECT measurement_id, coalesce(class, (SELECT class FROM classed WHERE class IS NOT NULL
         GROUP BY class ORDER BY count(*) DESC, class LIMIT 1)) AS class FROM classed""",
)
def impute_mode(spark, sf_dir):
    classed = hospital.measurement(spark, sf_dir).select(
        "measurement_id", F.floor(F.col("value_as_number") / F.lit(10.0)).alias("class")
    )
    return impute.impute_mode(classed, ["class"])


def _knn_sql(k: int = 5) -> str:
    total = float(len(FEATURES))
    squared = " + ".join(f"coalesce(power(q.{c} - d.{c}, 2), 0.0)" for c in FEATURES)
    shared = " + ".join(f"CASE WHEN q.{c} IS NOT NULL AND d.{c} IS NOT NULL THEN 1 ELSE 0 END" for c in FEATURES)
    any_missing = " OR ".join(f"{c} IS NULL" for c in FEATURES)
    missing = " UNION ALL ".join(
        f"SELECT id, '{c}' AS c, avg(v) AS guess FROM (SELECT id, d.{c} AS v, row_number() OVER (PARTITION BY id ORDER BY distance, donor) AS r "
        f"FROM pairs JOIN scaled q ON q.micro_specimen_id = id JOIN scaled d ON d.micro_specimen_id = donor "
        f"WHERE q.{c} IS NULL AND d.{c} IS NOT NULL AND distance IS NOT NULL) WHERE r <= {k} GROUP BY id"
        for c in FEATURES
    )
    filled = ", ".join(
        f"round(coalesce(s.{c}, (SELECT guess FROM guesses g WHERE g.id = s.micro_specimen_id AND g.c = '{c}'), avg(s.{c}) OVER ()), 6) + 0.0 AS {c}"
        for c in FEATURES
    )
    return f"""WITH pairs AS (SELECT q.micro_specimen_id AS id, d.micro_specimen_id AS donor,
          {total} * ({squared}) / nullif({shared}, 0) AS distance
        FROM (SELECT * FROM scaled WHERE {any_missing}) q, scaled d),
        guesses AS ({missing}) SELECT micro_specimen_id, {filled} FROM scaled s"""


@query("impute_knn", _knn_sql())
def impute_knn(spark, sf_dir):
    scaled = scaling.standard_scale(fixed_matrix(spark, sf_dir).select(ID, *FEATURES), FEATURES)
    return rounded(impute.impute_knn(scaled, ID, FEATURES), FEATURES)


def _scaled(spark, sf_dir):
    return scaling.standard_scale(fixed_matrix(spark, sf_dir).select(ID, *FEATURES), FEATURES)


@query("impute_forest")
def impute_forest(spark, sf_dir):
    """Ten rounds at most, 100 trees a column, depth 30."""
    return impute.impute_forest(_scaled(spark, sf_dir).select(ID, *FEATURES), FEATURES)


@query("impute_chained")
def impute_chained(spark, sf_dir):
    return impute.impute_chained(_scaled(spark, sf_dir), FEATURES)


@query("impute_em")
def impute_em(spark, sf_dir):
    return impute.impute_em(_scaled(spark, sf_dir), FEATURES)


def imputers(**forest) -> dict:
    return {
        "mean": impute.impute_mean,
        "median": impute.impute_median,
        "knn": lambda df, columns, by: impute.impute_knn(df, ID, columns, by=by),
        "forest": lambda df, columns, by: impute.impute_forest(df, columns, by=by, **forest),
        "em": impute.impute_em,
        "chained": impute.impute_chained,
    }


HIDDEN = [0.1, 0.1663, 0.2, 0.3, 0.35, 0.4]  # fixed values: hidden shares of the published comparison


@query("impute_compare")
def impute_compare(spark, sf_dir):
    """All six imputers on all unscaled columns and all hidden shares; forests of 100 trees."""
    rows = fixed_matrix(spark, sf_dir).select(ID, *FEATURES)
    return impute.impute_compare(rows, ID, FEATURES, imputers(), HIDDEN)


@query(
    "impute_compare_constants",
    f"""WITH versions AS (SELECT fraction, column_name, value,
          CAST('0x' || substr(md5(concat(micro_specimen_id, column_name, '42')), 1, 8) AS BIGINT) / 4294967296.0 < fraction AS gone
          FROM melted, (SELECT unnest([{', '.join(f'{h}::DOUBLE' for h in HIDDEN)}]) AS fraction)),
        centres AS (SELECT fraction, column_name, avg(value) AS mean, quantile_cont(value, 0.5) AS median
          FROM versions WHERE NOT gone GROUP BY 1, 2),
        guesses AS (SELECT m.method, v.fraction, value, CASE method WHEN 'mean' THEN mean ELSE median END AS guess
          FROM versions v JOIN centres c ON c.fraction = v.fraction AND c.column_name = v.column_name,
          (SELECT unnest(['mean', 'median']) AS method) m WHERE gone AND value IS NOT NULL)
        SELECT method, fraction, round(1 - sum(power(value - guess, 2)) / (var_pop(value) * count(value)), 6) + 0.0 AS r2
        FROM guesses GROUP BY 1, 2""",
)
def impute_compare_constants(spark, sf_dir):
    """The comparison of the imputers that SQL can express."""
    rows = fixed_matrix(spark, sf_dir).select(ID, *FEATURES)
    methods = {name: imputers()[name] for name in ("mean", "median")}
    return rounded(impute.impute_compare(rows, ID, FEATURES, methods, HIDDEN), ["r2"])


PROFILE = ["mean", "sd", "minimum", "maximum", "q1", "median", "q3"]


@query(
    "column_profile",
    """SELECT column_name, count(value) AS present, count(*) - count(value) AS missing, round(avg(value), 6) AS mean,
       round(stddev_samp(value), 6) AS sd, round(min(value), 6) AS minimum, round(max(value), 6) AS maximum,
       round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median,
       round(quantile_cont(value, 0.75), 6) AS q3 FROM melted GROUP BY column_name""",
)
def column_profile(spark, sf_dir):
    return rounded(quality.column_profile(fixed_matrix(spark, sf_dir), FEATURES), PROFILE)


@query(
    "column_histogram",
    """WITH ends AS (SELECT column_name, min(value) AS low, max(value) AS high FROM melted GROUP BY 1)
       SELECT m.column_name, CAST(least(10, floor(coalesce((value - low) * 10 / nullif(high - low, 0), 0.0)) + 1) AS INTEGER) AS bin,
       count(*) AS n FROM melted m JOIN ends e ON e.column_name = m.column_name WHERE value IS NOT NULL GROUP BY 1, 2""",
)
def column_histogram(spark, sf_dir):
    return quality.histogram(matrix(spark, sf_dir), FEATURES)


_BOUNDS = {
    "z": "avg(value) - 3.0 * stddev_samp(value) AS low, avg(value) + 3.0 * stddev_samp(value) AS high",
    "iqr": "quantile_cont(value, 0.25) - 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS low, "
    "quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS high",
}


@query(
    "anomaly_summary",
    " UNION ALL ".join(
        f"""SELECT '{rule}' AS rule, m.column_name, count(*) - count(value) AS missing,
            count(*) FILTER (WHERE value < low OR value > high) AS out_of_range
            FROM melted m JOIN (SELECT column_name, {bounds} FROM melted GROUP BY 1) b ON b.column_name = m.column_name
            GROUP BY m.column_name"""
        for rule, bounds in _BOUNDS.items()
    ),
)
def anomaly_summary(spark, sf_dir):
    rows = fixed_matrix(spark, sf_dir)
    parts = [quality.anomaly_summary(rows, FEATURES, rule).withColumn("rule", F.lit(rule)) for rule in _BOUNDS]
    return parts[0].unionByName(parts[1])


@query(
    "anomaly_correction",
    f"""WITH bounds AS (SELECT column_name, {_BOUNDS['z']} FROM melted GROUP BY 1)
        SELECT micro_specimen_id, m.column_name, CASE WHEN value >= low AND value <= high THEN round(value, 6) + 0.0 END AS value
        FROM melted m JOIN bounds b ON b.column_name = m.column_name""",
)
def anomaly_correction(spark, sf_dir):
    corrected = quality.correct_anomalies(fixed_matrix(spark, sf_dir).select(ID, *FEATURES), FEATURES)
    return rounded(corrected.unpivot([ID], FEATURES, "column_name", "value"), ["value"])


@query(
    "validate_matrix",
    """SELECT column_name, count(*) FILTER (WHERE isinf(value)) AS infinite, count(*) - count(value) AS missing,
       count(*) AS total, count(value) = 0 AS all_missing FROM melted GROUP BY column_name""",
)
def validate_matrix(spark, sf_dir):
    return quality.matrix_checks(matrix(spark, sf_dir), FEATURES)
