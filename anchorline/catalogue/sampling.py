"""Samples, splits, folds and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from anchorline.catalogue.base import KEYS, labelled, long, query
from anchorline.operators import labels
from anchorline.sources import hospital

ID = ["micro_specimen_id"]
RANKED_SQL = """SELECT micro_specimen_id, target, row_number() OVER (ORDER BY md5(concat(CAST(micro_specimen_id AS VARCHAR), '42')),
    micro_specimen_id) AS r, count(*) OVER () AS n FROM labelled"""
CLASS_RANKED_SQL = """SELECT micro_specimen_id, target, row_number() OVER (PARTITION BY target
    ORDER BY md5(concat(CAST(micro_specimen_id AS VARCHAR), '42')), micro_specimen_id) AS r FROM labelled"""


@query("sample_n", f"SELECT micro_specimen_id, target FROM ({RANKED_SQL}) WHERE r <= 500")
def sample_n(spark, sf_dir):
    return labels.sample_n(labelled(spark, sf_dir).select(*ID, "target"), 500, ID)


RATIO_SQL = f"""WITH sizes AS (SELECT ratio, CAST(split_part(ratio, '_', 1) AS INTEGER) AS share,
      (SELECT count(*) FILTER (WHERE target) FROM labelled) AS positives
      FROM (VALUES {', '.join(f"('{r}')" for r in labels.CLASS_RATIOS)}) AS t(ratio)),
    wanted AS (SELECT ratio, CASE WHEN share < 70 THEN floor(positives * share / (100 - share)) ELSE 15 * share END AS neg,
      CASE WHEN share < 70 THEN positives ELSE least(positives, 1500 - 15 * share) END AS pos FROM sizes),
    drawn AS (SELECT ratio, micro_specimen_id, target FROM ({CLASS_RANKED_SQL}) JOIN wanted
      ON (target AND r <= pos) OR (NOT target AND r <= neg))"""


def class_ratio_samples(spark, sf_dir):
    rows = labelled(spark, sf_dir).select(*ID, "target").persist()
    positives = rows.where("target").count()
    return labels.sample_class_ratio(rows, labels.class_sizes(positives), ID)


@query("sample_class_ratio", f"{RATIO_SQL} SELECT ratio, micro_specimen_id, target FROM drawn")
def sample_class_ratio(spark, sf_dir):
    return class_ratio_samples(spark, sf_dir).select("ratio", *ID, "target")


@query("split_train_test", f"SELECT micro_specimen_id, r <= ceil(0.2 * n) AS is_test FROM ({RANKED_SQL})")
def split_train_test(spark, sf_dir):
    return labels.split_train_test(labelled(spark, sf_dir).select(*ID), 0.2, ID)


@query("stratified_folds", f"SELECT micro_specimen_id, target, CAST(r % 5 AS INTEGER) AS fold FROM ({CLASS_RANKED_SQL})")
def stratified_folds(spark, sf_dir):
    return labels.stratified_folds(labelled(spark, sf_dir).select(*ID, "target"), "target", ID)


@query(
    "union_all",
    "SELECT micro_specimen_id, person_id, concept_name, value_as_number FROM long WHERE family = 'vital' "
    "UNION ALL SELECT micro_specimen_id, person_id, concept_name, value_as_number FROM long WHERE family = 'lab'",
)
def union_all(spark, sf_dir):
    rows = long(spark, sf_dir)
    parts = [rows.where(F.col("family") == f).select(*KEYS, "concept_name", "value_as_number") for f in hospital.NAMES]
    return parts[0].unionByName(parts[1])
