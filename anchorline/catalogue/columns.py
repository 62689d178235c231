"""Projections, filters and scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from anchorline.catalogue.base import (
    COLUMNS, FEATURES, KEYS, _age, cohort, features, labelled, matrix, query, r6, rounded, scored,
)
from anchorline.catalogue.scans import FOLD_SCORES, event_scores
from anchorline.functions import encode, times
from anchorline.operators import cohort as members, features as feats, labels
from anchorline.sources import hospital


@query(
    "filter_positive_cultures",
    "SELECT * FROM micro WHERE spec_type_desc = 'BLOOD CULTURE' AND org_itemid <> 90760 AND org_name IS NOT NULL",
)
def filter_positive_cultures(spark, sf_dir):
    return members.positive_cultures(hospital.micro(spark, sf_dir))


@query(
    "filter_concepts",
    "SELECT * FROM measurement WHERE measurement_concept_id IN (1, 2, 3, 4) AND value_as_number IS NOT NULL",
)
def filter_concepts(spark, sf_dir):
    wanted = hospital.VITAL_IDS + hospital.LAB_IDS
    return feats.filter_concepts(hospital.measurement(spark, sf_dir), wanted)


@query(
    "filter_window",
    """SELECT m.measurement_id, m.visit_occurrence_id, m.measurement_datetime FROM measurement m
       JOIN visit_occurrence v ON v.visit_occurrence_id = m.visit_occurrence_id
       WHERE m.measurement_datetime > v.visit_start_datetime - INTERVAL '24' HOUR
         AND m.measurement_datetime < v.visit_start_datetime + INTERVAL '48' HOUR""",
)
def filter_window(spark, sf_dir):
    visits = hospital.visit_occurrence(spark, sf_dir).select("visit_occurrence_id", "visit_start_datetime")
    start = "visit_start_datetime"
    inside = times.strictly_between(
        "measurement_datetime", times.plus_hours(start, -24), times.plus_hours(start, 48)
    )
    rows = hospital.measurement(spark, sf_dir).join(visits, "visit_occurrence_id").where(inside)
    return rows.select("measurement_id", "visit_occurrence_id", "measurement_datetime")


@query(
    "anchor_choice",
    """SELECT 'micro' AS anchor, micro_specimen_id, person_id, chart_time AS anchor_time FROM cohort WHERE chart_time IS NOT NULL
       UNION ALL SELECT 'admission', micro_specimen_id, person_id, intime FROM cohort WHERE intime IS NOT NULL""",
)
def anchor_choice(spark, sf_dir):
    who = cohort(spark, sf_dir)
    parts = [
        members.with_anchor(who, a).select(F.lit(a).alias("anchor"), *KEYS, "anchor_time")
        for a in ("micro", "admission")
    ]
    return parts[0].unionByName(parts[1])


def _aged(spark, sf_dir):
    cultures = members.earliest_times(members.positive_cultures(hospital.micro(spark, sf_dir)))
    return members.with_identity(cultures, hospital.patients(spark, sf_dir), hospital.person(spark, sf_dir))


_AGED_SQL = f"""SELECT c.micro_specimen_id, c.subject_id, {_age('c.chartdate')} AS age
    FROM cultures c JOIN patients pa ON pa.subject_id = c.subject_id"""


@query("derive_age", _AGED_SQL)
def derive_age(spark, sf_dir):
    age = times.age_at("chartdate", "anchor_year", "anchor_age").alias("age")
    return _aged(spark, sf_dir).select("micro_specimen_id", "subject_id", age)


@query("filter_adults", f"SELECT * FROM ({_AGED_SQL}) WHERE age > 18")
def filter_adults(spark, sf_dir):
    age = times.age_at("chartdate", "anchor_year", "anchor_age").alias("age")
    return members.adults(_aged(spark, sf_dir), "chartdate").select("micro_specimen_id", "subject_id", age)


@query("coalesce_time", "SELECT micro_specimen_id, coalesce(charttime, chartdate) AS chart_time FROM micro")
def coalesce_time(spark, sf_dir):
    return hospital.micro(spark, sf_dir).select(
        "micro_specimen_id", times.first_time("charttime", "chartdate").alias("chart_time")
    )


@query(
    "stay_duration_hours",
    """SELECT visit_occurrence_id, CAST(date_part('day', visit_end_datetime - visit_start_datetime) * 24
       + date_part('hour', visit_end_datetime - visit_start_datetime) AS BIGINT) AS visit_duration_hrs
       FROM visit_occurrence""",
)
def stay_duration_hours(spark, sf_dir):
    hours = times.whole_hours_between("visit_start_datetime", "visit_end_datetime").alias("visit_duration_hrs")
    return hospital.visit_occurrence(spark, sf_dir).select("visit_occurrence_id", hours)


@query("encode_binary", "SELECT person_id, CASE WHEN gender_source_value = 'M' THEN 1 ELSE 0 END AS gender FROM person")
def encode_binary(spark, sf_dir):
    return hospital.person(spark, sf_dir).select(
        "person_id", encode.encode_binary("gender_source_value", "M").alias("gender")
    )


SEGMENTS = ["MACHINERY", "BUILDING", "AUTOMOBILE", "HOUSEHOLD", "FURNITURE", "UNKNOWN"]


@query(
    "one_hot",
    "SELECT person_id, "
    + ", ".join(f"CASE WHEN ethnicity = '{s}' THEN 1 ELSE 0 END AS ethnicity_{s}" for s in SEGMENTS)
    + " FROM person",
)
def one_hot(spark, sf_dir):
    people = hospital.person(spark, sf_dir).select("person_id", "ethnicity")
    return encode.one_hot(people, "ethnicity", {s: f"ethnicity_{s}" for s in SEGMENTS})


@query(
    "rename_suffix",
    "SELECT micro_specimen_id, person_id, "
    + ", ".join(f"round({c}_avg, 6) AS {c}_mean_value" for c in COLUMNS)
    + " FROM features",
)
def rename_suffix(spark, sf_dir):
    averages = features(spark, sf_dir, ["avg"])
    short = averages.select(*KEYS, *[F.round(f"{c}_avg", 6).alias(c) for c in COLUMNS])
    return encode.add_suffix(short, "_mean_value", KEYS)


@query("sanitize_names", "SELECT user_id, max(value) AS maxvalue FROM events GROUP BY user_id")
def sanitize_names(spark, sf_dir):
    widest = hospital.table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("value").alias("max [value]%"))
    return encode.sanitize_names(widest)


@query(
    "drop_columns",
    f"SELECT {r6(FEATURES)} FROM labelled",
)
def drop_columns(spark, sf_dir):
    rows = labelled(spark, sf_dir).drop(*KEYS, "anchor_time", "death_datetime", "target")
    return rounded(rows, FEATURES)


def _views() -> dict[str, list[str]]:
    return feats.feature_views(FEATURES, hospital.NAMES)


@query(
    "feature_views",
    " UNION ALL ".join(
        f"""SELECT '{view}' AS view_name, {len(cols)} AS n_columns, CAST({' + '.join(f'count({c})' for c in cols)} AS BIGINT) AS n_values,
            round({' + '.join(f'coalesce(sum({c}), 0)' for c in cols)}, 3) AS total FROM matrix"""
        for view, cols in _views().items()
    ),
)
def feature_views(spark, sf_dir):
    views = _views()
    rows = matrix(spark, sf_dir)
    sums = rows.agg(*[F.count(c).alias(f"n_{c}") for c in FEATURES], *[F.sum(c).alias(f"s_{c}") for c in FEATURES])
    report = F.array(
        *[
            F.struct(
                F.lit(view).alias("view_name"),
                F.lit(len(cols)).alias("n_columns"),
                sum((F.col(f"n_{c}") for c in cols), F.lit(0)).alias("n_values"),
                F.round(sum((F.coalesce(f"s_{c}", F.lit(0.0)) for c in cols), F.lit(0.0)), 3).alias("total"),
            )
            for view, cols in views.items()
        ]
    )
    return sums.select(F.inline(report))


_LABEL_SQL = "death_datetime > anchor_time + INTERVAL '{s}' DAY AND death_datetime < anchor_time + INTERVAL '{e}' DAY"


@query(
    "fill_target",
    f"SELECT micro_specimen_id, death_datetime IS NULL AS no_death, coalesce({_LABEL_SQL.format(s=0, e=30)}, false) AS target FROM matrix",
)
def fill_target(spark, sf_dir):
    rows = labels.label_outcome(matrix(spark, sf_dir), 0, 30)
    return rows.select("micro_specimen_id", F.col("death_datetime").isNull().alias("no_death"), "target")


@query("label_outcome", "SELECT micro_specimen_id, person_id, anchor_time, target FROM labelled")
def label_outcome(spark, sf_dir):
    return labelled(spark, sf_dir).select(*KEYS, "anchor_time", "target")


@query(
    "label_before",
    "SELECT micro_specimen_id, coalesce(death_datetime < anchor_time + INTERVAL '7' DAY, false) AS target FROM matrix",
)
def label_before(spark, sf_dir):
    return labels.label_before(matrix(spark, sf_dir), 7).select("micro_specimen_id", "target")


@query(
    "label_multi_target",
    " UNION ALL ".join(
        f"SELECT micro_specimen_id, {s} AS start_days, {e} AS end_days, coalesce({_LABEL_SQL.format(s=s, e=e)}, false) AS target FROM matrix"
        for s, e in labels.target_spans(labels.TARGETS)
    ),
)
def label_multi_target(spark, sf_dir):
    return labels.label_targets(matrix(spark, sf_dir)).select("micro_specimen_id", "start_days", "end_days", "target")


@query(
    "censor_early_deaths",
    """SELECT micro_specimen_id, anchor_time, death_datetime FROM matrix
       WHERE death_datetime IS NULL OR death_datetime >= anchor_time + INTERVAL '72' HOUR""",
)
def censor_early_deaths(spark, sf_dir):
    hours = 72
    return labels.censor_early(matrix(spark, sf_dir), hours).select("micro_specimen_id", "anchor_time", "death_datetime")


@query("binarize_probability", "SELECT event_id, CASE WHEN p < 0.5 THEN 0 ELSE 1 END AS predicted FROM scored")
def binarize_probability(spark, sf_dir):
    return scored(spark, sf_dir).select("event_id", encode.binarize("p").alias("predicted"))


@query(
    "rowwise_max",
    f"SELECT micro_specimen_id, round(greatest({', '.join(FEATURES)}), 6) AS highest FROM features",
)
def rowwise_max(spark, sf_dir):
    return features(spark, sf_dir).select("micro_specimen_id", F.round(encode.rowwise_max(FEATURES), 6).alias("highest"))


@query(
    "parse_ratio_label",
    """SELECT event_id, CAST(split_part(concat(CAST(user_id AS VARCHAR), '_', CAST(event_id AS VARCHAR)), '_', 1) AS INTEGER)
       AS ratio FROM events""",
)
def parse_ratio_label(spark, sf_dir):
    text = F.concat_ws("_", F.col("user_id").cast("string"), F.col("event_id").cast("string"))
    return hospital.table(spark, sf_dir, "events").select("event_id", labels.ratio_column(text).alias("ratio"))


@query(
    "filter_in_list",
    f"""WITH {FOLD_SCORES} SELECT model, fold, metric, round(value, 6) AS value, model IN ('view', 'click') AS listed FROM tidy
        WHERE model IN ('view', 'click') OR model NOT IN ('view', 'click', 'error')""",
)
def filter_in_list(spark, sf_dir):
    scores = event_scores(spark, sf_dir)
    listed = F.col("model").isin("view", "click")
    rest = ~F.col("model").isin("view", "click", "error")
    return rounded(scores.where(listed | rest).withColumn("listed", listed), ["value"])


@query(
    "filter_range",
    f"""WITH {FOLD_SCORES} SELECT model, round(avg(value), 6) AS average FROM tidy WHERE metric = 'accuracy'
        GROUP BY model HAVING avg(value) > 0.6 AND avg(value) < 0.95""",
)
def filter_range(spark, sf_dir):
    scores = event_scores(spark, sf_dir).where(F.col("metric") == "accuracy")
    means = scores.groupBy("model").agg(F.avg("value").alias("average"))
    return rounded(means.where((F.col("average") > 0.6) & (F.col("average") < 0.95)), ["average"])
