"""Outlier rejection, coverage, missing counts, column profiles and anomaly reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from anchorline.functions.ordered import exact_quantiles
from anchorline.session import stored_small

# fixed values: upper quantile left out of the vitals moments, sentinel of labs, rejection distance
VITALS_QUANTILE = 0.9999
LABS_SENTINEL = 999999
REJECT_SD = 3.0


def reject_outliers(
    long: DataFrame,
    by: Sequence[str] = ("concept_name",),
    value: str = "value_as_number",
    quantile: float | None = None,
    sentinel: float | None = None,
    k: float = REJECT_SD,
) -> DataFrame:
    """Keep rows at most ``k`` deviations from their group's mean.

    Mean and deviation are taken over values strictly below the group's ``quantile`` and different
    from ``sentinel``. Groups whose deviation is zero or undefined lose all rows. Limits and moments are
    one row per group, combined on the map side; only the quantile needs the distinct values in order.
    Where there are few groups, the rows themselves are not shuffled.
    """
    by = list(by)
    reference = long.where(F.col(value).isNotNull())
    if sentinel is not None:
        reference = reference.where(F.col(value) != sentinel)
    if quantile is not None:
        limits = exact_quantiles(long, by, value, {"__limit": quantile})
        reference = reference.join(stored_small(limits), by).where(F.col(value) < F.col("__limit"))
    moments = reference.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    distance = F.abs(F.try_divide(F.col(value) - F.col("mean"), F.col("sd")))
    return long.join(stored_small(moments), by).where(distance <= k).drop("mean", "sd")


def reject_vitals_outliers(long: DataFrame, **options) -> DataFrame:
    return reject_outliers(long, quantile=VITALS_QUANTILE, **options)


def reject_labs_outliers(long: DataFrame, **options) -> DataFrame:
    return reject_outliers(long, sentinel=LABS_SENTINEL, **options)


def melt(
    df: DataFrame, columns: Sequence[str], name: str = "column_name", value: str = "value", keep: Sequence[str] = ()
) -> DataFrame:
    long = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns])
    return long.unpivot(list(keep), list(columns), name, value)


def _per_column(df: DataFrame, columns: Sequence[str], measures: Mapping[str, object]) -> DataFrame:
    """One aggregate over the wide frame, then one output row per column."""
    row = df.agg(*[make(c).alias(f"{m}__{c}") for m, make in measures.items() for c in columns])
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), *[F.col(f"{m}__{c}").alias(m) for m in measures])
            for c in columns
        ]
    )
    return row.select(F.inline(entries))


def missing_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _per_column(df, columns, {"missing": lambda c: F.count_if(F.col(c).isNull())})


def coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column the rows, the missing rows and the share of rows that are present, in percent."""
    counted = _per_column(
        df,
        columns,
        {"total": lambda c: F.count(F.lit(1)), "missing": lambda c: F.count_if(F.col(c).isNull())},
    )
    present = F.try_divide(100.0 * (F.col("total") - F.col("missing")), F.col("total"))
    return counted.withColumn("coverage_pct", present)


def columns_kept(report: DataFrame, max_missing_pct: float) -> list[str]:
    """Names of the columns of a coverage report that stay: one row per column on the driver."""
    kept = report.where(100.0 - F.col("coverage_pct") <= max_missing_pct).select("column_name")
    return [r[0] for r in kept.collect()]


def drop_low_coverage(df: DataFrame, columns: Sequence[str], max_missing_pct: float) -> DataFrame:
    """Drop attributes missing in more than ``max_missing_pct`` percent of the rows."""
    kept = set(columns_kept(coverage(df, columns), max_missing_pct))
    return df.drop(*[c for c in columns if c not in kept])


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, missing, mean, deviation, extremes and exact quartiles per column."""
    basics = _per_column(
        df,
        columns,
        {
            "present": lambda c: F.count(c),
            "missing": lambda c: F.count_if(F.col(c).isNull()),
            "mean": lambda c: F.avg(c),
            "sd": lambda c: F.stddev_samp(c),
            "minimum": lambda c: F.min(c),
            "maximum": lambda c: F.max(c),
        },
    )
    quartiles = exact_quantiles(melt(df, columns), ["column_name"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return basics.join(quartiles, "column_name", "left")


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """Equal-width bin counts per column between its extremes; the largest value is in the last bin.

    The extremes come to the driver, one pair per column; the bins are then counted in one pass with map-side
    combining.
    """
    ends = _per_column(df, columns, {"low": lambda c: F.min(c), "high": lambda c: F.max(c)})
    ends = {r["column_name"]: (r["low"], r["high"]) for r in ends.collect()}

    def number(c: str) -> Column:
        low, high = (F.lit(v).cast("double") for v in ends[c])
        value = F.col(c).cast("double")
        position = F.coalesce(F.try_divide((value - low) * bins, high - low), F.lit(0.0))
        return F.when(value.isNotNull(), F.least(F.lit(bins), F.floor(position) + 1).cast("int"))

    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), number(c).alias("bin")) for c in columns])
    binned = df.select(F.inline(cells)).where(F.col("bin").isNotNull())
    return binned.groupBy("column_name", "bin").agg(F.count(F.lit(1)).alias("n"))


def anomaly_bounds(df: DataFrame, columns: Sequence[str], rule: str = "z", k: float = 3.0) -> DataFrame:
    """Accepted range per column: mean +- k deviations (``z``) or quartiles -+ 1.5 ranges (``iqr``)."""
    if rule == "z":
        moments = _per_column(df, columns, {"mean": lambda c: F.avg(c), "sd": lambda c: F.stddev_samp(c)})
        reach = F.lit(k) * F.col("sd")
        return moments.select("column_name", (F.col("mean") - reach).alias("low"), (F.col("mean") + reach).alias("high"))
    quartiles = exact_quantiles(melt(df, columns), ["column_name"], "value", {"q1": 0.25, "q3": 0.75})
    reach = F.lit(1.5) * (F.col("q3") - F.col("q1"))
    return quartiles.select("column_name", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))


def anomaly_summary(df: DataFrame, columns: Sequence[str], rule: str = "z", k: float = 3.0) -> DataFrame:
    """Per column how many values are missing and how many lie outside the accepted range, whose bounds come to the
    driver, one row per column. One pass over the wide frame; no rows are shuffled."""
    bounds = {r["column_name"]: (r["low"], r["high"]) for r in anomaly_bounds(df, columns, rule, k).collect()}

    def outside(c: str) -> Column:
        low, high = (F.lit(v).cast("double") for v in bounds.get(c, (None, None)))
        return F.count_if((F.col(c) < low) | (F.col(c) > high))

    return _per_column(df, columns, {"missing": lambda c: F.count_if(F.col(c).isNull()), "out_of_range": outside})


def correct_anomalies(df: DataFrame, columns: Sequence[str], rule: str = "z", k: float = 3.0) -> DataFrame:
    """Null the values outside the accepted range; bounds come to the driver, one row per column."""
    bounds = {r["column_name"]: r for r in anomaly_bounds(df, columns, rule, k).collect()}

    def kept(c: str) -> Column:
        if c not in bounds or bounds[c]["low"] is None:
            return F.col(c)
        return F.when(F.col(c).between(F.lit(bounds[c]["low"]), F.lit(bounds[c]["high"])), F.col(c)).alias(c)

    return df.select(*[kept(c) if c in columns else F.col(c) for c in df.columns])


def matrix_checks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column the infinite and the missing values, and whether all rows are missing."""
    infinite = [float("inf"), float("-inf")]
    checked = _per_column(
        df,
        columns,
        {
            "infinite": lambda c: F.count_if(F.col(c).isin(infinite)),
            "missing": lambda c: F.count_if(F.col(c).isNull()),
            "total": lambda c: F.count(F.lit(1)),
        },
    )
    return checked.withColumn("all_missing", F.col("missing") >= F.col("total"))


def validate_matrix(df: DataFrame, columns: Sequence[str], fitted: Sequence[str] | None = None) -> bool:
    """Raise on infinite values, all-missing columns or other columns than fitted; True if any is missing."""
    if fitted is not None and list(fitted) != list(columns):
        raise ValueError("the columns differ from those the imputer was fitted on")
    rows = matrix_checks(df, columns).collect()
    if any(r["infinite"] for r in rows):
        raise ValueError("infinite values are not supported")
    empty = [r["column_name"] for r in rows if r["all_missing"]]
    if empty:
        raise ValueError(f"all rows are missing in {empty}")
    return any(r["missing"] for r in rows)


def shape_report(stages: Mapping[str, DataFrame]) -> DataFrame:
    """Rows and columns of every stage table."""
    rows = [
        df.agg(F.lit(name).alias("stage"), F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"))
        for name, df in stages.items()
    ]
    return reduce(DataFrame.unionByName, rows)
