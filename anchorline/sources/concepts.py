"""Concept lists of the clinical sources: which ids are read and which names become columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

# fixed values: measurement concept ids of vitals
VITAL_CONCEPT_IDS = [
    3027018,
    21492239, 3004249,
    21492240, 3012888,
    3027598, 21492241,
    1175625, 3024171, 3007469,
    3020891,
    40762499,
    3016335,
    3009094,
    3008223,
]

# fixed values: measurement concept ids of labs
LAB_CONCEPT_IDS = [
    3047181, 3013290, 3024561, 3024629, 3008939, 3012501, 3005456, 3010421, 3014576, 3031147,
    3024128, 3000905, 3016723, 3022217, 3019550, 3000285, 3000963, 3018672, 3024929, 3013682,
    3004501, 3018572, 3027315, 3016293, 3023103, 3037278, 3003282, 3023314, 3013466,
]

FAMILIES = {"vital": VITAL_CONCEPT_IDS, "lab": LAB_CONCEPT_IDS}


def with_families(concept: DataFrame, families: Mapping[str, Sequence[int]] = FAMILIES) -> DataFrame:
    """The dictionary's id, name and family of the listed ids. A dictionary of the common model has no families; an id
    listed twice belongs to the family named first."""
    family = F.lit(None).cast("string")
    for name, ids in reversed(list(families.items())):
        family = F.when(F.col("concept_id").isin(list(ids)), F.lit(name)).otherwise(family)
    named = concept.select("concept_id", "concept_name", family.alias("family"))
    return named.where(F.col("family").isNotNull())


# fixed values: vitals concept name -> column
VITAL_COLUMNS = {
    "Body temperature": "temp",
    "Heart rate": "heartrate",
    "Breath rate setting Ventilator": "breath_rate_vent",
    "Breath rate spontaneous": "breath_rate_spon",
    "Respiratory rate": "resp_rate",
    "Oxygen saturation in Arterial blood by Pulse oximetry": "oxygen",
    "Systolic blood pressure": "sysbp",
    "Diastolic blood pressure": "diabp",
    "Mean blood pressure": "meanbp",
    "Systolic blood pressure by Noninvasive": "sysbp_ni",
    "Diastolic blood pressure by Noninvasive": "diabp_ni",
    "Mean blood pressure by Noninvasive": "meanbp_ni",
    "Glasgow coma score motor": "gcs_motor",
    "Glasgow coma score verbal": "gcs_verbal",
    "Glasgow coma score eye opening": "gcs_eye",
}

# fixed values: labs concept name -> column
LAB_COLUMNS = {
    "Potassium [Moles/volume] in Serum or Plasma": "potassium",
    "Chloride [Moles/volume] in Serum or Plasma": "chloride",
    "Glucose [Mass/volume] in Serum or Plasma": "glucose",
    "Sodium [Moles/volume] in Serum or Plasma": "sodium",
    "Bicarbonate [Moles/volume] in Serum or Plasma": "bicarbonate",
    "Hemoglobin [Mass/volume] in Blood": "hemoglobin",
    "Creatinine [Mass/volume] in Serum or Plasma": "creatinine",
}

# fixed values: column prefixes of the CSV form of the matrix
CSV_VITALS = ["heartrate", "sysbp", "diabp", "meanbp", "resprate", "tempc", "spo2", "gcseye", "gcsverbal", "gcsmotor"]
CSV_LABS = [
    "chloride_serum", "creatinine", "sodium_serum", "hemoglobin", "platelet_count", "urea_nitrogen",
    "glucose_serum", "bicarbonate", "potassium_serum", "anion_gap", "leukocytes_blood_manual", "hematocrit",
]
