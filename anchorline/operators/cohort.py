"""Who is studied and around which time: cohort, static attributes, outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from anchorline.functions.encode import encode_binary
from anchorline.functions.times import age_at, first_time, whole_hours_between
from anchorline.operators.intervals import point_in_interval_join

# fixed values: specimen type kept, organism code left out, age limit
BLOOD_CULTURE = "BLOOD CULTURE"
EXCLUDED_ORGANISM = 90760
ADULT_AGE = 18


def positive_cultures(
    micro: DataFrame, specimen_type: str = BLOOD_CULTURE, excluded_organism: int = EXCLUDED_ORGANISM
) -> DataFrame:
    """Cultures of the type with a named organism; a null organism code is dropped by the ``!=``."""
    return micro.where(
        (F.col("spec_type_desc") == specimen_type)
        & (F.col("org_itemid") != excluded_organism)
        & F.col("org_name").isNotNull()
    )


def earliest_times(cultures: DataFrame) -> DataFrame:
    return cultures.groupBy("subject_id", "micro_specimen_id").agg(
        F.min("chartdate").alias("chartdate"), F.min("charttime").alias("charttime")
    )


def known_people(patients: DataFrame, person: DataFrame) -> DataFrame:
    """Patients with their person; the person's source key is text and may not be a number."""
    people = person.select(
        F.expr("try_cast(person_source_value AS int)").cast("long").alias("subject_id"),
        "person_id",
        "gender_source_value",
    )
    return patients.join(people, "subject_id")


def with_identity(rows: DataFrame, patients: DataFrame, person: DataFrame) -> DataFrame:
    """Subject -> patient -> person."""
    return rows.join(known_people(patients, person), "subject_id")


def with_stay(rows: DataFrame, admissions: DataFrame, icustays: DataFrame, at: str, slack_days: int = 0) -> DataFrame:
    """Left join to the admission holding the time, then to the unit stay holding it, ends included."""

    def widen(frame: DataFrame, start: str, end: str) -> DataFrame:
        slack = F.make_dt_interval(days=F.lit(slack_days))
        return frame.withColumns({start: F.col(start) - slack, end: F.col(end) + slack})

    admitted = point_in_interval_join(
        rows,
        widen(admissions.select("subject_id", "hadm_id", "admittime", "dischtime"), "admittime", "dischtime"),
        ["subject_id"], at, "admittime", "dischtime", closed=True, how="left",
    )
    stays = icustays.select("hadm_id", F.col("intime").alias("__in"), F.col("outtime").alias("__out"), "intime")
    staying = point_in_interval_join(
        admitted, widen(stays, "__in", "__out"), ["hadm_id"], at, "__in", "__out", closed=True, how="left"
    )
    return staying.drop("__in", "__out")


def adults(rows: DataFrame, at: str, min_age: int = ADULT_AGE) -> DataFrame:
    return rows.where(age_at(at, "anchor_year", "anchor_age") > min_age)


def specimen_cohort(
    micro: DataFrame,
    patients: DataFrame,
    person: DataFrame,
    admissions: DataFrame,
    icustays: DataFrame,
    min_age: int = ADULT_AGE,
    specimen_type: str = BLOOD_CULTURE,
    excluded_organism: int = EXCLUDED_ORGANISM,
) -> DataFrame:
    """One row per positive specimen of an adult, with its time and the start of its unit stay."""
    cultures = earliest_times(positive_cultures(micro, specimen_type, excluded_organism))
    known = adults(with_identity(cultures, patients, person), "chartdate", min_age)
    timed = known.withColumn("chart_time", first_time("charttime", "chartdate"))
    return with_stay(timed, admissions, icustays, "chart_time").select(
        "micro_specimen_id", "person_id", "chart_time", "intime"
    )


def visit_cohort(visits: DataFrame) -> DataFrame:
    return visits.select("visit_occurrence_id", "person_id", F.col("visit_start_datetime").alias("intime"))


def with_anchor(cohort: DataFrame, anchor: str = "micro") -> DataFrame:
    """The one time that windows and labels are measured from; members without it are dropped."""
    source = {"micro": "chart_time", "admission": "intime"}[anchor]
    return cohort.withColumn("anchor_time", F.col(source)).where(F.col("anchor_time").isNotNull())


def members_with_codes(members: DataFrame, diagnoses: DataFrame, key: str, code: str, codes: Sequence[str]) -> DataFrame:
    """Members having any of the diagnosis codes."""
    return members.join(diagnoses.where(F.col(code).isin(list(codes))).select(key), key, "left_semi")


def members_without_codes(
    members: DataFrame, diagnoses: DataFrame, key: str, code: str, codes: Sequence[str]
) -> DataFrame:
    return members.join(diagnoses.where(F.col(code).isin(list(codes))).select(key), key, "left_anti")


def with_visit(cohort: DataFrame, visits: DataFrame, at: str = "chart_time", one_visit: bool = False) -> DataFrame:
    """Visits strictly holding the time. Overlapping visits give several rows unless ``one_visit``
    keeps the earliest (smallest id on a tie)."""
    spans = visits.select("person_id", "visit_occurrence_id", "visit_start_datetime", "visit_end_datetime")
    joined = point_in_interval_join(
        cohort, spans, ["person_id"], at, "visit_start_datetime", "visit_end_datetime", closed=False
    )
    if not one_visit:
        return joined
    keys = cohort.columns
    first = F.min(F.struct("visit_start_datetime", "visit_occurrence_id", "visit_end_datetime")).alias("__v")
    return joined.groupBy(*keys).agg(first).select(*keys, "__v.*")


def known_concepts(visits: DataFrame, concept: DataFrame) -> DataFrame:
    """Visits whose concept ids are both in the dictionary."""
    ids = concept.select("concept_id").distinct()
    for c in ("visit_concept_id", "visit_source_concept_id"):
        visits = visits.join(ids.withColumnRenamed("concept_id", c), c, "left_semi")
    return visits


def _static_columns(keys: Sequence[str], at: Column | str) -> list[Column]:
    return [
        *[F.col(k) for k in keys],
        encode_binary("gender_source_value", "M").alias("gender"),
        whole_hours_between("visit_start_datetime", "visit_end_datetime").alias("visit_duration_hrs"),
        age_at(at, "anchor_year", "anchor_age").alias("age"),
    ]


def specimen_statics(
    cohort: DataFrame,
    patients: DataFrame,
    person: DataFrame,
    visits: DataFrame,
    concept: DataFrame | None = None,
    one_visit: bool = False,
) -> DataFrame:
    """Gender, length of the visit holding the specimen, and age at the specimen."""
    if concept is not None:
        visits = known_concepts(visits, concept)
    members = cohort.select("micro_specimen_id", "person_id", "chart_time")
    described = members.join(known_people(patients, person), "person_id")
    held = with_visit(described, visits, "chart_time", one_visit)
    return held.select(*_static_columns(["micro_specimen_id", "person_id"], "chart_time"))


def visit_statics(cohort: DataFrame, patients: DataFrame, person: DataFrame, visits: DataFrame) -> DataFrame:
    spans = visits.select("visit_occurrence_id", "person_id", "visit_start_datetime", "visit_end_datetime")
    held = cohort.select("visit_occurrence_id").join(spans, "visit_occurrence_id")
    held = held.join(known_people(patients, person), "person_id")
    return held.select(*_static_columns(["visit_occurrence_id"], "visit_start_datetime"))


def outcomes(cohort: DataFrame, death: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The death time of every member, null for survivors."""
    return cohort.join(death.select("person_id", "death_datetime"), "person_id", "left").select(*keys, "death_datetime")
