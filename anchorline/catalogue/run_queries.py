"""Sweeps from source tables or matrices to stored scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from anchorline.catalogue.base import COLUMNS, FEATURES, KEYS, STAT_SQL, fixed_matrix, query, rounded
from anchorline.catalogue.sweep_queries import THRESHOLDS
from anchorline.functions.metrics import METRICS, score_table, scores_long
from anchorline.operators import features as feats, impute, labels, models
from anchorline.plans import fitted, ledger
from anchorline.plans.runs import Sources, Suite
from anchorline.plans.sweeps import AFTER_HOURS, window_runs
from anchorline.session import cut_lineage, scratch_path
from anchorline.sources import concepts, hospital

ID = "micro_specimen_id"
FAMILY_COLUMNS = {family: {n: n for n in names} for family, names in hospital.NAMES.items()}
SCALE_FIRST = (("scale", "standard"), ("impute", "mean"))
IMPUTE_FIRST = (("coverage", 25), ("impute", "mean"), ("anomalies", "z"), ("impute", "mean"), ("scale", "standard"))


def sources(spark, sf_dir) -> Sources:
    tables = (
        hospital.micro, hospital.patients, hospital.person, hospital.admissions, hospital.icustays, hospital.visit_occurrence,
        hospital.measurement,
    )
    dictionary = hospital.concept(spark).drop("family")
    families = {"vital": hospital.VITAL_IDS, "lab": hospital.LAB_IDS}
    # the measurements' dictionary has families only by its ids, as a common-model dictionary has; visits need all its ids
    named = dictionary.join(concepts.with_families(dictionary, families).select("concept_id", "family"), "concept_id", "left")
    return Sources(*(t(spark, sf_dir) for t in tables), named, hospital.death(spark, sf_dir))


@query(
    "concept_families",
    f"""SELECT concept_id, concept_name, CASE WHEN concept_id IN ({', '.join(map(str, hospital.VITAL_IDS))}) THEN 'vital' ELSE 'lab' END AS family
        FROM concept WHERE concept_id IN ({', '.join(map(str, hospital.VITAL_IDS + hospital.LAB_IDS))})""",
)
def concept_families(spark, sf_dir):
    """The dictionary of the measurements present, with families by its ids."""
    used = hospital.measurement(spark, sf_dir).select(F.col("measurement_concept_id").alias("concept_id")).distinct()
    dictionary = hospital.concept(spark).drop("family").join(used, "concept_id", "left_semi")
    return concepts.with_families(dictionary, {"vital": hospital.VITAL_IDS, "lab": hospital.LAB_IDS})


_RUNS = ", ".join(f"('micro_vb_24_va_{a}_lb_24_la_{a}', {a})" for a in AFTER_HOURS)
_STATS = ", ".join(f"{STAT_SQL[s].format(n=n)} AS {n}_{s}" for s in feats.STATISTICS for n in COLUMNS)
_MELTED_RUNS = f"""WITH inside AS (SELECT r.run_id, m.*, t.concept_name, t.family, c.micro_specimen_id FROM measurement m
      JOIN concept t ON t.concept_id = m.measurement_concept_id JOIN cohort c ON c.person_id = m.person_id
      JOIN (VALUES {_RUNS}) AS r(run_id, after) ON m.measurement_datetime > c.chart_time - INTERVAL '24' HOUR
        AND m.measurement_datetime < c.chart_time + to_hours(r.after)
      WHERE t.family IN ('vital', 'lab') AND m.value_as_number IS NOT NULL),
    limits AS (SELECT run_id, concept_name, quantile_cont(value_as_number, 0.9999) AS lim FROM inside WHERE family = 'vital' GROUP BY 1, 2),
    moments AS (SELECT i.run_id, i.concept_name, avg(value_as_number) AS mean, stddev_samp(value_as_number) AS sd FROM inside i
      LEFT JOIN limits l ON l.run_id = i.run_id AND l.concept_name = i.concept_name
      WHERE CASE WHEN family = 'vital' THEN value_as_number < lim ELSE value_as_number <> 999999 END GROUP BY 1, 2),
    kept AS (SELECT i.* FROM inside i JOIN moments o ON o.run_id = i.run_id AND o.concept_name = i.concept_name
      WHERE abs((value_as_number - mean) / nullif(sd, 0)) <= 3),
    described AS (SELECT c.micro_specimen_id, c.person_id FROM cohort c JOIN person p ON p.person_id = c.person_id
      JOIN patients pa ON pa.subject_id = CAST(p.person_source_value AS INTEGER)
      JOIN visit_occurrence v ON v.person_id = p.person_id AND v.visit_start_datetime < c.chart_time
        AND v.visit_end_datetime > c.chart_time GROUP BY 1, 2),
    wide AS (SELECT run_id, micro_specimen_id, person_id, {_STATS} FROM kept GROUP BY 1, 2, 3
      HAVING count(*) FILTER (WHERE family = 'vital') > 0 AND count(*) FILTER (WHERE family = 'lab') > 0),
    tall AS (SELECT w.run_id, w.micro_specimen_id, unnest([{', '.join(f"'{c}'" for c in FEATURES)}]) AS column_name,
      unnest([{', '.join(FEATURES)}]) AS value
      FROM wide w JOIN described d ON d.micro_specimen_id = w.micro_specimen_id AND d.person_id = w.person_id)"""
_BY = "OVER (PARTITION BY run_id, column_name)"


def _scaled_sql(source: str) -> str:
    return f"""SELECT run_id, micro_specimen_id, column_name, (value - avg(value) {_BY}) /
        CASE WHEN stddev_pop(value) {_BY} = 0 THEN 1.0 ELSE stddev_pop(value) {_BY} END AS value FROM {source}"""


def _filled_sql(source: str) -> str:
    return f"SELECT run_id, micro_specimen_id, column_name, coalesce(value, avg(value) {_BY}) AS value FROM {source}"


def _prepared(spark, sf_dir, steps) -> DataFrame:
    """All window runs, prepared, in long form."""
    settings = ledger.prepared_runs(sources(spark, sf_dir), window_runs("micro"), steps, FAMILY_COLUMNS)
    parts = []
    for run_id, make in settings.items():
        rows, columns = make()
        parts.append(rows.withColumn("run_id", F.lit(run_id)).unpivot(["run_id", ID], columns, "column_name", "value"))
    return rounded(reduce(DataFrame.unionByName, parts), ["value"])


@query(
    "prepare_scale_first",
    f"""{_MELTED_RUNS}, scaled_cells AS ({_scaled_sql('tall')}), filled AS ({_filled_sql('scaled_cells')})
        SELECT run_id, micro_specimen_id, column_name, round(value, 6) + 0.0 AS value FROM filled""",
)
def prepare_scale_first(spark, sf_dir):
    """Sources to matrices of five windows, scaled, then filled."""
    return _prepared(spark, sf_dir, SCALE_FIRST)


@query(
    "prepare_impute_first",
    f"""{_MELTED_RUNS}, shares AS (SELECT run_id, column_name FROM tall GROUP BY 1, 2 HAVING 100.0 * (count(*) - count(value)) / count(*) <= 25),
        covered AS (SELECT t.* FROM tall t JOIN shares s ON s.run_id = t.run_id AND s.column_name = t.column_name),
        first_fill AS ({_filled_sql('covered')}),
        ranged AS (SELECT run_id, micro_specimen_id, column_name, CASE WHEN value BETWEEN avg(value) {_BY} - 3.0 * stddev_samp(value) {_BY}
          AND avg(value) {_BY} + 3.0 * stddev_samp(value) {_BY} THEN value END AS value FROM first_fill),
        second_fill AS ({_filled_sql('ranged')}), done AS ({_scaled_sql('second_fill')})
        SELECT run_id, micro_specimen_id, column_name, round(value, 6) + 0.0 AS value FROM done""",
)
def prepare_impute_first(spark, sf_dir):
    """The other published order: coverage, fill, anomalies, fill, scale."""
    return _prepared(spark, sf_dir, IMPUTE_FIRST)


def _regressions() -> Suite:
    return Suite(logistic=models.logistic({"C": [1.0]}), models=("lr",))


@query("run_windows")
def run_windows(spark, sf_dir):
    """Sources to stored scores of five windows: the logistic regression at C = 1, outcome of seven days."""
    path = scratch_path(spark, "window-scores")
    return ledger.run_windows(
        sources(spark, sf_dir), window_runs("micro"), hospital.NAMES, path, [7], _regressions(), SCALE_FIRST, FAMILY_COLUMNS,
        label_anchor="chart_time",
    )


def _swept(spark, settings) -> DataFrame:
    path = scratch_path(spark, "sweep-scores")
    return ledger.sweep(spark, settings, KEYS, hospital.NAMES, path, [7], _regressions())


def _filled(spark, sf_dir) -> DataFrame:
    rows = fixed_matrix(spark, sf_dir).drop("target")
    return impute.impute_mean(ledger.prepare(rows, ID, FEATURES, [("scale", "standard")])[0], FEATURES)


@query("run_sample_sizes")
def run_sample_sizes(spark, sf_dir):
    return _swept(spark, ledger.size_settings(_filled(spark, sf_dir), FEATURES, labels.SAMPLE_SIZES, KEYS, "micro"))


@query("run_class_ratios")
def run_class_ratios(spark, sf_dir):
    return _swept(spark, ledger.ratio_settings(_filled(spark, sf_dir), FEATURES, labels.CLASS_RATIOS, KEYS, "micro"))


@query("run_missingness")
def run_missingness(spark, sf_dir):
    rows = fixed_matrix(spark, sf_dir).drop("target")
    return _swept(spark, ledger.missingness_settings(rows, FEATURES, THRESHOLDS, ID, "micro", SCALE_FIRST))


@query("run_scalings")
def run_scalings(spark, sf_dir):
    rows = fixed_matrix(spark, sf_dir).drop("target")
    return _swept(spark, ledger.scaling_settings(rows, FEATURES, ["none", "standard", "minmax"], ID, "micro"))


SPLIT_SQL = """SELECT micro_specimen_id, row_number() OVER (ORDER BY md5(concat(CAST(micro_specimen_id AS VARCHAR), '42')),
    micro_specimen_id) AS r, count(*) OVER () AS n FROM labelled"""


def _on_train(c: str) -> str:
    train = "FILTER (WHERE NOT is_test) OVER ()"
    return f"({c} - avg({c}) {train}) / CASE WHEN stddev_pop({c}) {train} = 0 THEN 1.0 ELSE stddev_pop({c}) {train} END AS {c}"


def _split(spark, sf_dir) -> DataFrame:
    return cut_lineage(labels.split_train_test(fixed_matrix(spark, sf_dir), 0.2, [ID]))


@query(
    "prepare_fitted",
    f"""WITH ranked AS ({SPLIT_SQL}), parted AS (SELECT m.*, r <= ceil(0.2 * n) AS is_test FROM matrix m
          JOIN ranked k ON k.micro_specimen_id = m.micro_specimen_id),
        z AS (SELECT micro_specimen_id, is_test, {', '.join(_on_train(c) for c in FEATURES)} FROM parted)
        SELECT micro_specimen_id, is_test, {', '.join(
            f"round(coalesce({c}, avg({c}) FILTER (WHERE NOT is_test) OVER ()), 6) + 0.0 AS {c}" for c in FEATURES)} FROM z""",
)
def prepare_fitted(spark, sf_dir):
    """Scales and means learned from the training rows, applied to all rows."""
    rows = _split(spark, sf_dir).select(ID, "is_test", *FEATURES)
    ready = fitted.fit_preparation(rows.where(~F.col("is_test")), FEATURES, SCALE_FIRST)
    return rounded(ready.apply(rows), FEATURES)


@query("score_saved")
def score_saved(spark, sf_dir):
    """A preparation and a regression fitted on the training rows, saved, loaded, and applied to raw rows."""
    rows = _split(spark, sf_dir).withColumn("label", F.col("target").cast("int").cast("double"))
    path = scratch_path(spark, "scorer")
    fitted.fit_scorer(rows.where(~F.col("is_test")), FEATURES, SCALE_FIRST, models.logistic(), {"C": 1.0}).save(spark, path)
    return fitted.load_scorer(spark, path).score(rows, [*KEYS, "is_test"])


@query("cross_validate_prepared")
def cross_validate_prepared(spark, sf_dir):
    """Cross-validation in which every fold's scales and fillings are learned from the other folds."""
    rows = models.model_frame(fixed_matrix(spark, sf_dir), KEYS, FEATURES)
    scored = models.out_of_fold(
        rows, FEATURES, models.logistic(), {"C": 1.0}, KEYS, parallelism=5,
        preparation=lambda train: fitted.fit_preparation(train, FEATURES, SCALE_FIRST).apply,
    )
    return scores_long(score_table(cut_lineage(scored), ["fold"]), ["fold"], METRICS)
