"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from anchorline.catalogue.base import (
    COLUMNS, FEATURES, KEYS, STAT_SQL, WINDOWS, _age, anchored, cohort, features, long, matrix, query, r6, rounded,
)
from anchorline.functions import encode
from anchorline.functions.times import first_time
from anchorline.operators import cohort as members, features as feats
from anchorline.session import cut_lineage
from anchorline.sources import hospital


@query(
    "join_identity",
    """SELECT c.micro_specimen_id, c.subject_id, p.person_id, p.gender_source_value FROM cultures c
       JOIN patients pa ON pa.subject_id = c.subject_id
       JOIN person p ON CAST(p.person_source_value AS INTEGER) = pa.subject_id""",
)
def join_identity(spark, sf_dir):
    cultures = members.earliest_times(members.positive_cultures(hospital.micro(spark, sf_dir)))
    known = members.with_identity(cultures, hospital.patients(spark, sf_dir), hospital.person(spark, sf_dir))
    return known.select("micro_specimen_id", "subject_id", "person_id", "gender_source_value")


@query(
    "join_stay_containment",
    """SELECT m.micro_specimen_id, a.hadm_id, i.intime FROM micro m
       LEFT JOIN admissions a ON a.subject_id = m.subject_id
         AND coalesce(m.charttime, m.chartdate) BETWEEN a.admittime AND a.dischtime
       LEFT JOIN icustays i ON i.hadm_id = a.hadm_id
         AND coalesce(m.charttime, m.chartdate) BETWEEN i.intime AND i.outtime""",
)
def join_stay_containment(spark, sf_dir):
    timed = hospital.micro(spark, sf_dir).withColumn("chart_time", first_time("charttime", "chartdate"))
    stays = members.with_stay(timed, hospital.admissions(spark, sf_dir), hospital.icustays(spark, sf_dir), "chart_time")
    return stays.select("micro_specimen_id", "hadm_id", "intime")


@query(
    "join_visit_overlap",
    """SELECT c.micro_specimen_id, c.person_id, v.visit_occurrence_id FROM cohort c JOIN visit_occurrence v
       ON v.person_id = c.person_id AND v.visit_start_datetime < c.chart_time AND v.visit_end_datetime > c.chart_time""",
)
def join_visit_overlap(spark, sf_dir):
    held = members.with_visit(cohort(spark, sf_dir), hospital.visit_occurrence(spark, sf_dir))
    return held.select(*KEYS, "visit_occurrence_id")


@query(
    "join_dictionary",
    """SELECT m.measurement_id, t.concept_name, t.family FROM measurement m
       JOIN concept t ON t.concept_id = m.measurement_concept_id
       JOIN visit_occurrence v ON v.visit_occurrence_id = m.visit_occurrence_id
       JOIN concept a ON a.concept_id = v.visit_concept_id JOIN concept b ON b.concept_id = v.visit_source_concept_id""",
)
def join_dictionary(spark, sf_dir):
    concept = hospital.concept(spark)
    named = feats.name_concepts(hospital.measurement(spark, sf_dir), concept)
    visits = members.known_concepts(hospital.visit_occurrence(spark, sf_dir), concept).select("visit_occurrence_id")
    return named.join(visits, "visit_occurrence_id").select("measurement_id", "concept_name", "family")


@query(
    "join_window",
    """SELECT micro_specimen_id, person_id, measurement_id, concept_name, family, measurement_datetime, value_as_number
       FROM long""",
)
def join_window(spark, sf_dir):
    return long(spark, sf_dir).select(
        *KEYS, "measurement_id", "concept_name", "family", "measurement_datetime", "value_as_number"
    )


VISIT_WINDOW_SQL = """SELECT m.visit_occurrence_id, m.measurement_id, t.concept_name, t.family, m.measurement_datetime,
    m.value_as_number FROM measurement m JOIN concept t ON t.concept_id = m.measurement_concept_id
    JOIN visit_occurrence v ON v.visit_occurrence_id = m.visit_occurrence_id
    WHERE m.value_as_number IS NOT NULL
      AND ((t.family = 'vital' AND m.measurement_datetime > v.visit_start_datetime - INTERVAL '24' HOUR
            AND m.measurement_datetime < v.visit_start_datetime + INTERVAL '48' HOUR)
        OR (t.family = 'lab' AND m.measurement_datetime > v.visit_start_datetime - INTERVAL '24' HOUR
            AND m.measurement_datetime < v.visit_start_datetime + INTERVAL '72' HOUR))"""


def visit_long(spark, sf_dir):
    who = members.visit_cohort(hospital.visit_occurrence(spark, sf_dir)).withColumnRenamed("intime", "anchor_time")
    return feats.window_measurements(
        hospital.measurement(spark, sf_dir), hospital.concept(spark), who, {"vital": (24, 48), "lab": (24, 72)},
        keys=["visit_occurrence_id"], on="visit_occurrence_id",
        concept_ids=hospital.VITAL_IDS + hospital.LAB_IDS,
    )


@query("join_window_visits", VISIT_WINDOW_SQL)
def join_window_visits(spark, sf_dir):
    return visit_long(spark, sf_dir).select(
        "visit_occurrence_id", "measurement_id", "concept_name", "family", "measurement_datetime", "value_as_number"
    )


@query(
    "visit_matrix",
    f"""WITH windowed AS ({VISIT_WINDOW_SQL}),
        stats AS (SELECT visit_occurrence_id, {', '.join(f"{STAT_SQL[s].format(n=n)} AS {n}_{s}" for s in feats.STATISTICS for n in COLUMNS)}
          FROM windowed GROUP BY 1 HAVING count(*) FILTER (WHERE family = 'vital') > 0
          AND count(*) FILTER (WHERE family = 'lab') > 0),
        statics AS (SELECT v.visit_occurrence_id, CASE WHEN p.gender_source_value = 'M' THEN 1 ELSE 0 END AS gender,
          CAST(date_part('day', v.visit_end_datetime - v.visit_start_datetime) * 24
            + date_part('hour', v.visit_end_datetime - v.visit_start_datetime) AS BIGINT) AS visit_duration_hrs,
          {_age('v.visit_start_datetime')} AS age, d.death_datetime
          FROM visit_occurrence v JOIN person p ON p.person_id = v.person_id
          JOIN patients pa ON pa.subject_id = CAST(p.person_source_value AS INTEGER)
          LEFT JOIN death d ON d.person_id = v.person_id)
        SELECT s.visit_occurrence_id, gender, visit_duration_hrs, age, death_datetime, {r6(FEATURES)}
        FROM statics s JOIN stats f ON f.visit_occurrence_id = s.visit_occurrence_id""",
)
def visit_matrix(spark, sf_dir):
    """The visit flavour end to end: the same operators under another key."""
    key = ["visit_occurrence_id"]
    visits = hospital.visit_occurrence(spark, sf_dir)
    who = members.visit_cohort(visits)
    wide = feats.feature_stats(visit_long(spark, sf_dir), key, COLUMNS, require=["vital", "lab"])
    statics = members.visit_statics(who, hospital.patients(spark, sf_dir), hospital.person(spark, sf_dir), visits)
    died = members.outcomes(who, hospital.death(spark, sf_dir), key)
    return rounded(feats.matrix(who, wide, died, key, statics), FEATURES)


@query(
    "join_outcome",
    """SELECT c.micro_specimen_id, c.person_id, d.death_datetime FROM cohort c LEFT JOIN death d ON d.person_id = c.person_id""",
)
def join_outcome(spark, sf_dir):
    return members.outcomes(cohort(spark, sf_dir), hospital.death(spark, sf_dir), KEYS)


def statics(spark, sf_dir, one_visit=False, who=None):
    return members.specimen_statics(
        cohort(spark, sf_dir) if who is None else who, hospital.patients(spark, sf_dir), hospital.person(spark, sf_dir),
        hospital.visit_occurrence(spark, sf_dir), hospital.concept(spark), one_visit,
    )


STATICS_SQL = f"""SELECT c.micro_specimen_id, c.person_id, CASE WHEN p.gender_source_value = 'M' THEN 1 ELSE 0 END AS gender,
    CAST(date_part('day', v.visit_end_datetime - v.visit_start_datetime) * 24
      + date_part('hour', v.visit_end_datetime - v.visit_start_datetime) AS BIGINT) AS visit_duration_hrs,
    {_age('c.chart_time')} AS age
    FROM cohort c JOIN person p ON p.person_id = c.person_id
    JOIN patients pa ON pa.subject_id = CAST(p.person_source_value AS INTEGER)
    JOIN visit_occurrence v ON v.person_id = p.person_id AND v.visit_start_datetime < c.chart_time
      AND v.visit_end_datetime > c.chart_time
    JOIN concept a ON a.concept_id = v.visit_concept_id JOIN concept b ON b.concept_id = v.visit_source_concept_id"""


@query("statics", STATICS_SQL)
def statics_query(spark, sf_dir):
    return statics(spark, sf_dir)


@query("cohort", "SELECT micro_specimen_id, person_id, chart_time, intime FROM cohort")
def cohort_query(spark, sf_dir):
    return cohort(spark, sf_dir)


@query(
    "join_matrix",
    f"""WITH statics AS ({STATICS_SQL})
        SELECT s.micro_specimen_id, s.person_id, gender, visit_duration_hrs, age, c.chart_time AS anchor_time,
          death_datetime, {r6(FEATURES)}
        FROM cohort c JOIN statics s ON s.micro_specimen_id = c.micro_specimen_id AND s.person_id = c.person_id
        JOIN features f ON f.micro_specimen_id = c.micro_specimen_id AND f.person_id = c.person_id
        LEFT JOIN death d ON d.person_id = c.person_id""",
)
def join_matrix(spark, sf_dir):
    who = cut_lineage(anchored(spark, sf_dir))
    died = members.outcomes(who, hospital.death(spark, sf_dir), KEYS)
    rows = feats.window_measurements(hospital.measurement(spark, sf_dir), hospital.concept(spark), who, WINDOWS)
    wide = feats.feature_stats(rows, KEYS, COLUMNS, require=list(WINDOWS))
    whole = feats.matrix(who.drop("chart_time"), wide, died, KEYS, statics(spark, sf_dir, who=who))
    return rounded(whole, FEATURES)


@query(
    "join_suffix_merge",
    f"""SELECT p.person_id, CASE WHEN gender_source_value = 'M' THEN 1 ELSE 0 END AS gender, death_datetime,
        {', '.join(f"{STAT_SQL[s].format(n=n)} AS {n}_{s}" for s in ('min', 'max', 'first', 'last') for n in COLUMNS)}
        FROM person p JOIN death d ON d.person_id = p.person_id JOIN measurement m ON m.person_id = p.person_id
        JOIN concept t ON t.concept_id = m.measurement_concept_id
        WHERE m.value_as_number IS NOT NULL AND t.family IN ('vital', 'lab') GROUP BY 1, 2, 3""",
)
def join_suffix_merge(spark, sf_dir):
    """Frames with equal column names per statistic, suffixed and merged on the person."""
    rows = feats.name_concepts(hospital.measurement(spark, sf_dir), hospital.concept(spark))
    rows = rows.where(F.col("family").isin("vital", "lab"))
    frames = []
    for s in ("min", "max", "first", "last"):
        plain = feats.feature_stats(rows, ["person_id"], COLUMNS, (s,)).withColumnsRenamed(
            {f"{c}_{s}": c for c in COLUMNS}
        )
        frames.append(encode.add_suffix(plain, f"_{s}", ["person_id"]))
    people = hospital.person(spark, sf_dir).select(
        "person_id", encode.encode_binary("gender_source_value", "M").alias("gender")
    )
    return encode.merge_on([people, hospital.death(spark, sf_dir), *frames], "person_id")


@query(
    "join_label",
    """SELECT m.micro_specimen_id, m.person_id, c.chart_time FROM matrix m
       JOIN cohort c ON c.micro_specimen_id = m.micro_specimen_id AND c.person_id = m.person_id""",
)
def join_label(spark, sf_dir):
    return matrix(spark, sf_dir).select(*KEYS).join(cohort(spark, sf_dir).drop("intime"), KEYS)


@query(
    "cohort_by_codes",
    """SELECT person_id, EXISTS (SELECT 1 FROM events e WHERE e.user_id = person_id AND e.event_type IN ('error', 'purchase'))
       AS has_code FROM person""",
)
def cohort_by_codes(spark, sf_dir):
    people = hospital.person(spark, sf_dir).select("person_id")
    diagnoses = hospital.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("person_id"), F.col("event_type").alias("code")
    )
    codes = ["error", "purchase"]
    having = members.members_with_codes(people, diagnoses, "person_id", "code", codes)
    lacking = members.members_without_codes(people, diagnoses, "person_id", "code", codes)
    return having.withColumn("has_code", F.lit(True)).unionByName(lacking.withColumn("has_code", F.lit(False)))
