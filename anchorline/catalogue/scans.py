"""Scans and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from anchorline.catalogue.base import KEYS, long, query, rounded, scored
from anchorline.functions.metrics import METRICS, score_table, scores_long
from anchorline.functions.times import parse_time
from anchorline.operators.labels import stratified_folds
from anchorline.sources import hospital, tables
from anchorline.sources.schemas import fields
from anchorline.session import cut_lineage, scratch_path


@query("scan_table", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def scan_table(spark, sf_dir):
    return tables.scan_table(spark, f"{sf_dir}/events.parquet", ["event_id", "ts", "user_id", "event_type", "value", "props"])


CSV_TYPES = fields("event_id long, user_id long, event_type string, value double, taken_at timestamp_ntz")


@query(
    "scan_csv",
    "SELECT event_id, user_id, event_type, value, CAST(date_trunc('second', ts) AS TIMESTAMP) AS taken_at FROM events",
)
def scan_csv(spark, sf_dir):
    path = scratch_path(spark, "csv")
    events = hospital.table(spark, sf_dir, "events")
    tables.write_csv(
        events.select(
            F.col("event_id").alias("Unnamed: 0"), "event_id", "user_id", "event_type", "value", F.col("ts").alias("taken_at")
        ),
        path,
    )
    return tables.scan_csv(spark, path, CSV_TYPES)


@query(
    "parse_timestamps",
    "SELECT event_id, strptime(strftime(ts, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS parsed FROM events",
)
def parse_timestamps(spark, sf_dir):
    text = hospital.table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("t"))
    return text.select("event_id", parse_time("t").alias("parsed"))


@query(
    "write_table",
    "SELECT measurement_id, micro_specimen_id, person_id, concept_name, measurement_datetime, value_as_number, family FROM long",
)
def write_table(spark, sf_dir):
    rows = long(spark, sf_dir).select(
        "measurement_id", "micro_specimen_id", "person_id", "concept_name", "measurement_datetime",
        "value_as_number", "family",
    )
    stored = tables.write_table(rows, scratch_path(spark, "long"), ["family"])
    return stored.withColumn("family", F.col("family").cast("string"))


@query(
    "append_rows",
    """SELECT CAST(person_id AS BIGINT) AS person_id, CAST(value_as_number AS DOUBLE) AS value_as_number, concept_name
       FROM long WHERE family IN ('vital', 'lab')""",
)
def append_rows(spark, sf_dir):
    path = scratch_path(spark, "appended")
    schema = fields("person_id long, value_as_number double, concept_name string")
    rows = long(spark, sf_dir)
    for family in hospital.NAMES:
        stored = tables.append_rows(rows.where(F.col("family") == family), path, schema)
    return stored


@query("write_csv", "SELECT micro_specimen_id, person_id, concept_name, value_as_number FROM long")
def write_csv(spark, sf_dir):
    path = scratch_path(spark, "matrix")
    rows = long(spark, sf_dir).select(*KEYS, "concept_name", "value_as_number")
    tables.write_csv(rows, path)
    return tables.scan_csv(spark, path, rows.schema)


def event_scores(spark, sf_dir):
    """Fold scores of the model-free predictions: one 'model' per event type."""
    folded = cut_lineage(stratified_folds(scored(spark, sf_dir), "y", ["event_id"]))
    return scores_long(score_table(folded, ["model", "fold"]), ["model", "fold"], METRICS)


# fold scores in SQL
FOLD_SCORES = """
folded AS (SELECT model, y, p, row_number() OVER (PARTITION BY y ORDER BY md5(concat(CAST(event_id AS VARCHAR), '42')), event_id) % 5 AS fold FROM scored),
cells AS (SELECT model, fold, p, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM folded GROUP BY 1, 2, 3),
runs AS (SELECT model, fold, p, pos, neg,
  CAST(sum(pos) OVER (PARTITION BY model, fold ORDER BY p DESC) AS DOUBLE) AS tp,
  CAST(sum(neg) OVER (PARTITION BY model, fold ORDER BY p DESC) AS DOUBLE) AS fp,
  CAST(sum(pos) OVER (PARTITION BY model, fold) AS DOUBLE) AS np,
  CAST(sum(neg) OVER (PARTITION BY model, fold) AS DOUBLE) AS nn FROM cells),
ranked AS (SELECT model, fold, sum(pos * (nn - fp + neg / 2.0)) / (max(np) * max(nn)) AS auroc,
  sum(pos / np * (tp / (tp + fp))) AS average_precision FROM runs GROUP BY 1, 2),
points AS (SELECT model, fold, p, ((tp * (nn - fp) - fp * (np - tp))
    / nullif(sqrt((tp + fp) * (tp + (np - tp)) * ((nn - fp) + fp) * ((nn - fp) + (np - tp))), 0) + 1.0) / 2.0 AS mcc,
  2.0 * tp / (2.0 * tp + fp + (np - tp)) AS f1 FROM runs),
ends AS (SELECT model, fold, min(mcc) AS low, max(mcc) AS high FROM points GROUP BY 1, 2),
best AS (SELECT q.model, q.fold, low, high, max(p) AS peak FROM points q JOIN ends e
  ON q.model = e.model AND q.fold = e.fold AND q.mcc = e.high GROUP BY 1, 2, 3, 4),
ranges AS (SELECT q.model, q.fold, p >= peak AS upper, least(coalesce(floor((mcc - low) / nullif((high - low) / 100.0, 0)), 0), 99) AS bin,
  avg(sqrt(power(mcc - 1.0, 2) + power(f1 - 1.0, 2))) AS d
  FROM points q JOIN best b ON q.model = b.model AND q.fold = b.fold WHERE mcc IS NOT NULL GROUP BY 1, 2, 3, 4),
curved AS (SELECT model, fold, 1.0 - avg(d) / sqrt(2.0) AS mcc_f1 FROM ranges GROUP BY 1, 2),
counted AS (SELECT model, fold, CAST(count(*) FILTER (WHERE y = 1 AND p >= 0.5) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE y = 0 AND p >= 0.5) AS DOUBLE) AS fp,
  CAST(count(*) FILTER (WHERE y = 0 AND p < 0.5) AS DOUBLE) AS tn, CAST(count(*) FILTER (WHERE y = 1 AND p < 0.5) AS DOUBLE) AS fn FROM folded GROUP BY 1, 2),
wide AS (SELECT c.model, c.fold, (tp + tn) / (tp + fp + tn + fn) AS accuracy,
  (tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2.0 AS balanced_accuracy,
  coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f1, r.auroc, r.average_precision, m.mcc_f1
  FROM counted c JOIN ranked r ON r.model = c.model AND r.fold = c.fold
  JOIN curved m ON m.model = c.model AND m.fold = c.fold),
tidy AS (SELECT model, fold, 'accuracy' AS metric, accuracy AS value FROM wide
  UNION ALL SELECT model, fold, 'balanced_accuracy', balanced_accuracy FROM wide
  UNION ALL SELECT model, fold, 'f1', f1 FROM wide
  UNION ALL SELECT model, fold, 'auroc', auroc FROM wide
  UNION ALL SELECT model, fold, 'average_precision', average_precision FROM wide
  UNION ALL SELECT model, fold, 'mcc_f1', mcc_f1 FROM wide)
"""


@query(
    "score_store",
    f"""WITH {FOLD_SCORES} SELECT 'events' AS run_id, CAST(0 AS INTEGER) AS target_start, CAST(7 AS INTEGER) AS target_end,
        model, CAST(fold AS INTEGER) AS fold, metric, round(value, 6) AS value FROM tidy""",
)
def score_store(spark, sf_dir):
    scores = event_scores(spark, sf_dir).select(
        F.lit("events").alias("run_id"), F.lit(0).alias("target_start"), F.lit(7).alias("target_end"),
        "model", "fold", "metric", "value",
    )
    return rounded(tables.store_scores(scores, scratch_path(spark, "scores")), ["value"])
