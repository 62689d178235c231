"""The query registry, the frames that queries share, and the SQL views that their checks share."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from anchorline.operators import cohort as members, features as feats
from anchorline.operators.labels import label_outcome
from anchorline.session import cut_lineage
from anchorline.sources import hospital

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

KEYS = ["micro_specimen_id", "person_id"]
WINDOWS = {"vital": (24, 72), "lab": (24, 72)}
COLUMNS = {name: name for names in hospital.NAMES.values() for name in names}
FEATURES = [f"{c}_{s}" for s in feats.STATISTICS for c in COLUMNS]


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` may use the names in VIEWS, which are prepended as needed."""

    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = with_views(sql)
        return function

    return register


def rounded(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """Round for comparison; adding 0.0 turns a negative zero into zero."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


def r6(columns: Sequence[str]) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in columns)


# --- frames ---------------------------------------------------------------------------------------


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return members.specimen_cohort(
        hospital.micro(spark, sf_dir), hospital.patients(spark, sf_dir), hospital.person(spark, sf_dir),
        hospital.admissions(spark, sf_dir), hospital.icustays(spark, sf_dir),
    )


def anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return members.with_anchor(cohort(spark, sf_dir), "micro")


def long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feats.window_measurements(
        hospital.measurement(spark, sf_dir), hospital.concept(spark), anchored(spark, sf_dir), WINDOWS
    )


def fixed_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windowed measurements, checkpointed for operators that read them more than once."""
    return cut_lineage(long(spark, sf_dir))


def features(spark: SparkSession, sf_dir: str, statistics: Sequence[str] = feats.STATISTICS) -> DataFrame:
    return feats.feature_stats(long(spark, sf_dir), KEYS, COLUMNS, statistics, require=list(WINDOWS))


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per specimen with a vital and a lab: anchor, 24 features, death time."""
    who = cut_lineage(anchored(spark, sf_dir))
    wide = feats.feature_stats(
        feats.window_measurements(hospital.measurement(spark, sf_dir), hospital.concept(spark), who, WINDOWS),
        KEYS, COLUMNS, require=list(WINDOWS),
    )
    died = members.outcomes(who, hospital.death(spark, sf_dir), KEYS)
    return feats.matrix(who.drop("chart_time"), wide, died, KEYS)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_outcome(matrix(spark, sf_dir), 0, 7)


def fixed_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled matrix, checkpointed: fits read it again and again."""
    return cut_lineage(labelled(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions without a model, as FIXTURES.md has them: many ties, one group per event type."""
    return hospital.table(spark, sf_dir, "events").select(
        "event_id",
        F.col("event_type").alias("model"),
        F.when(F.col("event_id") % 3 == 0, 1).otherwise(0).alias("y"),
        (F.floor(F.col("value") / F.lit(5.0)) / F.lit(100.0)).alias("p"),
    )


# --- SQL views ------------------------------------------------------------------------------------

_VISIT = "user_id*10 + CAST(floor((date_part('day', ts)-1)/5.0) AS BIGINT)"
_CONCEPT_ID = (
    "CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 WHEN 'error' THEN 4 ELSE 5 END"
)


def _age(time: str) -> str:
    return f"CAST(floor(date_part('day', {time} - make_timestamp(anchor_year, 1, 1, 0, 0, 0.0)) / 365.0) + anchor_age AS BIGINT)"


STAT_SQL = {
    "max": "max(value_as_number) FILTER (WHERE concept_name = '{n}')",
    "min": "min(value_as_number) FILTER (WHERE concept_name = '{n}')",
    "avg": "avg(value_as_number) FILTER (WHERE concept_name = '{n}')",
    "sd": "stddev_samp(value_as_number) FILTER (WHERE concept_name = '{n}')",
    "first": "arg_min(value_as_number, measurement_datetime) FILTER (WHERE concept_name = '{n}')",
    "last": "arg_max(value_as_number, measurement_datetime) FILTER (WHERE concept_name = '{n}')",
}


def stat_columns(statistics: Sequence[str] = feats.STATISTICS, names: Sequence[str] = tuple(COLUMNS)) -> str:
    return ", ".join(f"{STAT_SQL[s].format(n=n)} AS {n}_{s}" for s in statistics for n in names)


VIEWS = {
    "visit_occurrence": f"""SELECT {_VISIT} AS visit_occurrence_id, user_id AS person_id,
        min(ts) AS visit_start_datetime, max(ts) AS visit_end_datetime, min({_CONCEPT_ID}) AS visit_concept_id,
        max({_CONCEPT_ID}) AS visit_source_concept_id FROM events GROUP BY 1, 2""",
    "admissions": """SELECT person_id AS subject_id, visit_occurrence_id AS hadm_id,
        visit_start_datetime AS admittime, visit_end_datetime AS dischtime FROM visit_occurrence""",
    "icustays": """SELECT visit_occurrence_id AS hadm_id, visit_start_datetime + INTERVAL '2' HOUR AS intime,
        visit_end_datetime AS outtime FROM visit_occurrence WHERE visit_occurrence_id % 3 <> 0""",
    "concept": "SELECT * FROM (VALUES "
    + ", ".join(f"({i}, '{n}', '{f}')" for i, n, f in hospital.CONCEPTS)
    + ") AS t(concept_id, concept_name, family)",
    "measurement": f"""SELECT event_id AS measurement_id, user_id AS person_id, {_VISIT} AS visit_occurrence_id,
        ts AS measurement_datetime, {_CONCEPT_ID} AS measurement_concept_id,
        CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS value_as_number FROM events""",
    "micro": """SELECT event_id AS micro_specimen_id, user_id AS subject_id,
        CAST(date_trunc('day', ts) AS TIMESTAMP) AS chartdate,
        CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts END AS charttime,
        CASE WHEN event_id % 13 = 0 THEN 'URINE' ELSE 'BLOOD CULTURE' END AS spec_type_desc,
        CAST(CASE WHEN event_id % 17 = 0 THEN 90760 ELSE 80000 + event_id % 9 END AS INTEGER) AS org_itemid,
        CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'ORG' END AS org_name FROM events WHERE event_type = 'signup'""",
    "patients": """SELECT c_custkey AS subject_id, 2020 AS anchor_year,
        CAST(10 + c_custkey % 70 AS INTEGER) AS anchor_age FROM customer""",
    "person": """SELECT c_custkey AS person_id, CAST(c_custkey AS VARCHAR) AS person_source_value,
        CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender_source_value, c_mktsegment AS ethnicity
        FROM customer""",
    "death": """SELECT user_id AS person_id, max(ts) + INTERVAL '1' DAY AS death_datetime FROM events
        WHERE user_id % 4 = 0 GROUP BY user_id""",
    "cultures": """SELECT subject_id, micro_specimen_id, min(chartdate) AS chartdate, min(charttime) AS charttime
        FROM micro WHERE spec_type_desc = 'BLOOD CULTURE' AND org_itemid <> 90760 AND org_name IS NOT NULL
        GROUP BY subject_id, micro_specimen_id""",
    "cohort": f"""SELECT c.micro_specimen_id, p.person_id, coalesce(c.charttime, c.chartdate) AS chart_time, i.intime
        FROM cultures c JOIN patients pa ON pa.subject_id = c.subject_id
        JOIN person p ON CAST(p.person_source_value AS INTEGER) = pa.subject_id
        LEFT JOIN admissions a ON a.subject_id = pa.subject_id
          AND coalesce(c.charttime, c.chartdate) BETWEEN a.admittime AND a.dischtime
        LEFT JOIN icustays i ON i.hadm_id = a.hadm_id
          AND coalesce(c.charttime, c.chartdate) BETWEEN i.intime AND i.outtime
        WHERE {_age("c.chartdate")} > 18""",
    "long": """SELECT m.*, t.concept_name, t.family, c.micro_specimen_id
        FROM measurement m JOIN concept t ON t.concept_id = m.measurement_concept_id
        JOIN cohort c ON c.person_id = m.person_id
        WHERE t.family IN ('vital', 'lab') AND m.value_as_number IS NOT NULL
          AND m.measurement_datetime > c.chart_time - INTERVAL '24' HOUR
          AND m.measurement_datetime < c.chart_time + INTERVAL '72' HOUR""",
    "sequence": """SELECT *, row_number() OVER (PARTITION BY person_id, concept_name
        ORDER BY measurement_datetime, measurement_id, micro_specimen_id) AS rn FROM long""",
    "features": f"""SELECT micro_specimen_id, person_id, {stat_columns()} FROM long GROUP BY 1, 2
        HAVING count(*) FILTER (WHERE family = 'vital') > 0 AND count(*) FILTER (WHERE family = 'lab') > 0""",
    "matrix": """SELECT f.*, c.chart_time AS anchor_time, d.death_datetime FROM features f
        JOIN cohort c ON c.micro_specimen_id = f.micro_specimen_id AND c.person_id = f.person_id
        LEFT JOIN death d ON d.person_id = f.person_id""",
    "labelled": """SELECT *, coalesce(death_datetime > anchor_time AND death_datetime < anchor_time + INTERVAL '7' DAY,
        false) AS target FROM matrix""",
    "melted": f"""SELECT micro_specimen_id, unnest([{', '.join(f"'{c}'" for c in FEATURES)}]) AS column_name,
        unnest([{', '.join(FEATURES)}]) AS value FROM matrix""",
    "scaled": f"""SELECT micro_specimen_id, {', '.join(
        f"({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1.0 ELSE stddev_pop({c}) OVER () END AS {c}"
        for c in FEATURES)} FROM matrix""",
    "scored": """SELECT event_id, event_type AS model, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS y,
        floor(value / 5.0) / 100.0 AS p FROM events""",
    "confusion": """SELECT model, count(*) FILTER (WHERE y = 1 AND p >= 0.5) AS tp,
        count(*) FILTER (WHERE y = 0 AND p >= 0.5) AS fp, count(*) FILTER (WHERE y = 0 AND p < 0.5) AS tn,
        count(*) FILTER (WHERE y = 1 AND p < 0.5) AS fn FROM scored GROUP BY model""",
    "curve": """SELECT model, p AS score, pos, neg,
        sum(pos) OVER (PARTITION BY model ORDER BY p DESC) AS tp, sum(neg) OVER (PARTITION BY model ORDER BY p DESC) AS fp,
        sum(pos) OVER (PARTITION BY model) AS tp_total, sum(neg) OVER (PARTITION BY model) AS fp_total
        FROM (SELECT model, p, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg
              FROM scored GROUP BY model, p)""",
    "mcc_points": """SELECT model, score,
        ((CAST(tp AS DOUBLE) * (CAST(fp_total AS DOUBLE) - fp) - CAST(fp AS DOUBLE) * (CAST(tp_total AS DOUBLE) - tp))
          / nullif(sqrt((CAST(tp AS DOUBLE) + fp) * (CAST(tp AS DOUBLE) + (CAST(tp_total AS DOUBLE) - tp))
              * ((CAST(fp_total AS DOUBLE) - fp) + fp) * ((CAST(fp_total AS DOUBLE) - fp) + (CAST(tp_total AS DOUBLE) - tp))), 0)
          + 1.0) / 2.0 AS mcc,
        2.0 * tp / (2.0 * tp + fp + (tp_total - tp)) AS f1 FROM curve""",
}


def with_views(body: str) -> str:
    """Prepend the views that a statement uses, directly or through other views."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                needed.add(name)
                visit(VIEWS[name])

    visit(body)
    parts = [f"{name} AS ({VIEWS[name]})" for name in VIEWS if name in needed]
    if not parts:
        return body
    stripped = body.lstrip()
    if stripped.startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + stripped[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body
