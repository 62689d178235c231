"""Column types of the source tables and of the matrix."""

from __future__ import annotations

from pyspark.sql import types as T

from anchorline.operators.features import STATISTICS
from anchorline.sources.concepts import LAB_COLUMNS, VITAL_COLUMNS

TYPES = {
    "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(),
    "timestamp_ntz": T.TimestampNTZType(),
}


def fields(text: str) -> T.StructType:
    """``"a long, b string"`` as a schema, without needing a session."""
    pairs = [part.split() for part in text.split(",")]
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in pairs])


MICROBIOLOGY = fields(
    "micro_specimen_id long, subject_id long, chartdate timestamp_ntz, charttime timestamp_ntz, "
    "spec_type_desc string, org_itemid int, org_name string"
)
PATIENTS = fields("subject_id long, anchor_year int, anchor_age int")
PERSON = fields(
    "person_id long, person_source_value string, gender_source_value string, ethnicity string"
)
ADMISSIONS = fields("subject_id long, hadm_id long, admittime timestamp_ntz, dischtime timestamp_ntz")
ICU_STAYS = fields("hadm_id long, intime timestamp_ntz, outtime timestamp_ntz")
VISITS = fields(
    "visit_occurrence_id long, person_id long, visit_start_datetime timestamp_ntz, "
    "visit_end_datetime timestamp_ntz, visit_concept_id int, visit_source_concept_id int"
)
MEASUREMENT = fields(
    "measurement_id long, person_id long, visit_occurrence_id long, measurement_concept_id int, "
    "measurement_datetime timestamp_ntz, value_as_number double, unit_source_value string"
)
CONCEPT = fields("concept_id int, concept_name string, family string")
DEATH = fields("person_id long, death_datetime timestamp_ntz")
SCORES = fields(
    "run_id string, target_start int, target_end int, model string, fold int, metric string, value double"
)


def matrix_schema(keys: tuple[str, ...] = ("micro_specimen_id", "person_id")) -> T.StructType:
    """Keys, length of visit, gender, every (statistic, column) feature, and the death time."""
    schema = T.StructType([T.StructField(k, T.LongType()) for k in keys])
    schema = schema.add("visit_duration_hrs", "double").add("gender", "int")
    for columns in (VITAL_COLUMNS, LAB_COLUMNS):
        for statistic in STATISTICS:
            for column in columns.values():
                schema = schema.add(f"{column}_{statistic}", "double")
    return schema.add("death_datetime", "timestamp_ntz")
