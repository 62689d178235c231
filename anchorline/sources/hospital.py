"""Hospital-shaped tables derived from ``events`` and ``customer``, as FIXTURES.md part B defines them.

The remainders below say what the synthetic hospital looks like (who died, which visit had a unit
stay, which culture is negative). The queries add none of their own and read all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from anchorline.sources.schemas import fields

# fixed values: concept id, name, family
CONCEPTS = [
    (1, "click", "vital"),
    (2, "view", "vital"),
    (3, "purchase", "lab"),
    (4, "error", "lab"),
    (5, "signup", "other"),
]
VITAL_IDS = [1, 2]
LAB_IDS = [3, 4]
NAMES = {"vital": ["click", "view"], "lab": ["purchase", "error"]}


# known schemas spare the job that would read them from a file footer
SCHEMAS = {
    "events": fields(
        "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    ),
    "customer": fields(
        "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def concept(spark: SparkSession) -> DataFrame:
    """The dictionary as a local relation, whose known size lets the planner choose the join."""
    rows = ", ".join(f"({number}, '{name}', '{family}')" for number, name, family in CONCEPTS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(concept_id, concept_name, family)")


def _visit_id() -> F.Column:
    return F.col("user_id") * 10 + F.floor((F.dayofmonth("ts") - 1) / F.lit(5.0))


def _concept_id() -> F.Column:
    out = F.lit(5)
    for number, name, _ in CONCEPTS[:4]:
        out = F.when(F.col("event_type") == name, F.lit(number)).otherwise(out)
    return out


def visit_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .groupBy(_visit_id().alias("visit_occurrence_id"), F.col("user_id").alias("person_id"))
        .agg(
            F.min("ts").alias("visit_start_datetime"),
            F.max("ts").alias("visit_end_datetime"),
            F.min(_concept_id()).alias("visit_concept_id"),
            F.max(_concept_id()).alias("visit_source_concept_id"),
        )
    )


def admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visit_occurrence(spark, sf_dir).select(
        F.col("person_id").alias("subject_id"),
        F.col("visit_occurrence_id").alias("hadm_id"),
        F.col("visit_start_datetime").alias("admittime"),
        F.col("visit_end_datetime").alias("dischtime"),
    )


def icustays(spark: SparkSession, sf_dir: str) -> DataFrame:
    visits = visit_occurrence(spark, sf_dir)
    return visits.where(F.col("visit_occurrence_id") % 3 != 0).select(
        F.col("visit_occurrence_id").alias("hadm_id"),
        (F.col("visit_start_datetime") + F.expr("INTERVAL '2' HOUR")).alias("intime"),
        F.col("visit_end_datetime").alias("outtime"),
    )


def measurement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("measurement_id"),
        F.col("user_id").alias("person_id"),
        _visit_id().alias("visit_occurrence_id"),
        F.col("ts").alias("measurement_datetime"),
        _concept_id().alias("measurement_concept_id"),
        F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("value_as_number"),
    )


def micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.col("event_id")
    return (
        table(spark, sf_dir, "events")
        .where(F.col("event_type") == "signup")
        .select(
            event.alias("micro_specimen_id"),
            F.col("user_id").alias("subject_id"),
            F.date_trunc("day", F.col("ts")).cast("timestamp_ntz").alias("chartdate"),
            F.when(event % 5 != 0, F.col("ts")).alias("charttime"),
            F.when(event % 13 == 0, "URINE").otherwise("BLOOD CULTURE").alias("spec_type_desc"),
            F.when(event % 17 == 0, F.lit(90760)).otherwise(80000 + event % 9).cast("int").alias("org_itemid"),
            F.when(event % 7 != 0, "ORG").alias("org_name"),
        )
    )


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("subject_id"), F.lit(2020).alias("anchor_year"), (10 + key % 70).cast("int").alias("anchor_age")
    )


def person(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("person_id"),
        key.cast("string").alias("person_source_value"),
        F.when(key % 2 == 0, "M").otherwise("F").alias("gender_source_value"),
        F.col("c_mktsegment").alias("ethnicity"),
    )


def death(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .where(F.col("user_id") % 4 == 0)
        .groupBy(F.col("user_id").alias("person_id"))
        .agg((F.max("ts") + F.expr("INTERVAL '1' DAY")).alias("death_datetime"))
    )
