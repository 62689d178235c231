"""Tiny frames for the bounds, gaps and ties that whole tables do not show."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from anchorline.functions import encode, metrics
from anchorline.operators import cohort as members, features as feats, labels, quality, scaling
from anchorline.operators.intervals import point_in_interval_join
from anchorline.sources import tables
from anchorline.session import scratch_path

T0 = dt.datetime(2024, 1, 10, 12)
HOUR = dt.timedelta(hours=1)
KEYS = ["micro_specimen_id", "person_id"]
MEASURE = (
    "measurement_id long, person_id long, measurement_datetime timestamp_ntz, measurement_concept_id int, "
    "value_as_number double"
)
LONG = (
    "micro_specimen_id long, person_id long, measurement_id long, measurement_datetime timestamp_ntz, "
    "family string, concept_name string, value_as_number double"
)


def concept(spark):
    return spark.createDataFrame([(1, "hr", "vital"), (2, "na", "lab")], "concept_id int, concept_name string, family string")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_window_bounds_are_open_and_per_family(spark):
    who = spark.createDataFrame([(7, 1, T0)], "micro_specimen_id long, person_id long, anchor_time timestamp_ntz")
    times = [-24, -23, 71, 72]
    data = [(i, 1, T0 + h * HOUR, 1, 1.0) for i, h in enumerate(times)]
    data += [(10 + i, 1, T0 + h * HOUR, 2, 1.0) for i, h in enumerate([-3, -2, 1, 2])]
    data += [(20, 1, T0, 1, None), (21, 2, T0, 1, 1.0)]
    measured = spark.createDataFrame(data, MEASURE)
    out = feats.window_measurements(measured, concept(spark), who, {"vital": (24, 72), "lab": (3, 2)})
    assert rows(out, "measurement_id") == [(1,), (2,), (11,), (12,)]
    salted = feats.window_measurements(measured, concept(spark), who, {"vital": (24, 72), "lab": (3, 2)}, salts=4)
    assert rows(salted, "measurement_id") == [(1,), (2,), (11,), (12,)]


def test_stay_bounds_are_closed_and_left_rows_stay(spark):
    points = spark.createDataFrame(
        [(1, 5, T0), (2, 5, T0 + 300 * HOUR), (3, 5, T0 + 301 * HOUR), (4, 6, T0), (5, 5, None)],
        "id long, k long, at timestamp_ntz",
    )
    spans = spark.createDataFrame([(5, T0, T0 + 300 * HOUR, "a")], "k long, s timestamp_ntz, e timestamp_ntz, name string")
    out = point_in_interval_join(points, spans, ["k"], "at", "s", "e", closed=True, how="left", slot_hours=24)
    assert sorted((r.id, r.k, r.name) for r in out.collect()) == [
        (1, 5, "a"), (2, 5, "a"), (3, 5, None), (4, 6, None), (5, 5, None)
    ]


def test_null_anchor_is_dropped(spark):
    who = spark.createDataFrame(
        [(1, 1, T0, None), (2, 1, T0, T0)], "micro_specimen_id long, person_id long, chart_time timestamp_ntz, intime timestamp_ntz"
    )
    assert members.with_anchor(who, "admission").count() == 1
    assert members.with_anchor(who, "micro").count() == 2


def test_overlapping_visits(spark):
    who = spark.createDataFrame([(1, 1, T0)], "micro_specimen_id long, person_id long, chart_time timestamp_ntz")
    visits = spark.createDataFrame(
        [(11, 1, T0 - 5 * HOUR, T0 + HOUR), (12, 1, T0 - 9 * HOUR, T0 + HOUR), (13, 1, T0, T0 + HOUR)],
        "visit_occurrence_id long, person_id long, visit_start_datetime timestamp_ntz, visit_end_datetime timestamp_ntz",
    )
    assert rows(members.with_visit(who, visits), "visit_occurrence_id") == [(11,), (12,)]
    assert rows(members.with_visit(who, visits, one_visit=True), "visit_occurrence_id") == [(12,)]


def test_age_limit_is_strict_and_person_key_may_be_text(spark):
    cultures = spark.createDataFrame(
        [(1, 100, dt.datetime(2024, 1, 1)), (2, 101, dt.datetime(2024, 1, 1))],
        "subject_id long, micro_specimen_id long, chartdate timestamp_ntz",
    )
    patients = spark.createDataFrame([(1, 2024, 18), (2, 2024, 19)], "subject_id long, anchor_year int, anchor_age int")
    person = spark.createDataFrame(
        [(1, "1", "M"), (2, "2", "F"), (3, "n/a", "F")], "person_id long, person_source_value string, gender_source_value string"
    )
    known = members.with_identity(cultures, patients, person)
    assert rows(members.adults(known, "chartdate"), "subject_id") == [(2,)]


def test_statistics_of_one_value_and_first_last_with_gaps(spark):
    data = [
        (1, 1, 1, T0, "vital", "hr", None),
        (1, 1, 3, T0 + HOUR, "vital", "hr", 6.0),
        (1, 1, 2, T0 + HOUR, "vital", "hr", 5.0),
        (1, 1, 4, T0, "lab", "na", 140.0),
        (2, 1, 5, T0, "vital", "hr", 1.0),
    ]
    wide = feats.feature_stats(spark.createDataFrame(data, LONG), KEYS, {"hr": "hr", "na": "na"}, require=["vital", "lab"])
    found = wide.collect()
    assert len(found) == 1 and found[0].micro_specimen_id == 1
    assert (found[0].hr_first, found[0].hr_last, found[0].na_sd) == (5.0, 6.0, None)
    unfused = feats.feature_stats_unfused(
        spark.createDataFrame(data, LONG), KEYS, {"vital": {"hr": "hr"}, "lab": {"na": "na"}}
    )
    assert [r.asDict() for r in unfused.select(sorted(unfused.columns)).collect()] == [
        r.asDict() for r in wide.select(sorted(unfused.columns)).collect()
    ]


def test_outliers(spark):
    def frame(values):
        return spark.createDataFrame([("c", float(v)) for v in values], "concept_name string, value_as_number double")

    assert quality.reject_vitals_outliers(frame([5, 5, 5, 5])).count() == 0
    assert quality.reject_vitals_outliers(frame([5])).count() == 0
    kept = quality.reject_labs_outliers(frame([*range(20), 999999]))
    assert kept.count() == 20 and kept.agg(F.max("value_as_number")).first()[0] == 19.0
    assert quality.reject_vitals_outliers(frame([*range(50), 10000])).count() == 50


def test_labels_are_open_windows(spark):
    day = dt.timedelta(days=1)
    data = [(1, T0, T0 + 7 * day), (2, T0, T0 + 6 * day), (3, T0, None), (4, T0, T0)]
    df = spark.createDataFrame(data, "id long, anchor_time timestamp_ntz, death_datetime timestamp_ntz")
    assert rows(labels.label_outcome(df, 0, 7).where("target"), "id") == [(2,)]
    many = labels.label_targets(df, [7, (6, 8)])
    assert rows(many.where("target"), "id", "start_days") == [(1, 6), (2, 0)]
    assert rows(labels.censor_early(df, 24), "id") == [(1,), (2,), (3,)]


def test_scaling_and_names(spark):
    df = spark.createDataFrame([(1, 2.0, 1.0), (2, 2.0, 3.0), (3, None, None)], "id long, a double, b double")
    out = {r.id: r for r in scaling.standard_scale_all_but(df, "id").collect()}
    assert (out[1].a, out[1].b, out[2].b, out[3].a) == (0.0, -1.0, 1.0, None)
    assert rows(scaling.minmax_scale(df, ["b"]).where("id < 3"), "b") == [(0.0,), (1.0,)]
    with pytest.raises(ValueError):
        encode.sanitize_names(df.select(F.col("a").alias("x y"), F.col("b").alias("x-y")))


def test_matrix_validation(spark):
    ok = spark.createDataFrame([(1.0, 2.0), (None, 3.0)], "a double, b double")
    assert quality.validate_matrix(ok, ["a", "b"]) and not quality.validate_matrix(ok, ["b"])
    with pytest.raises(ValueError):
        quality.validate_matrix(ok.withColumn("a", F.lit(float("inf"))), ["a"])
    with pytest.raises(ValueError):
        quality.validate_matrix(ok.withColumn("a", F.lit(None).cast("double")), ["a"])
    with pytest.raises(ValueError):
        quality.validate_matrix(ok, ["a"], fitted=["a", "b"])


def test_metrics_with_ties(spark):
    df = spark.createDataFrame([("m", 1, 0.5), ("m", 0, 0.5), ("m", 1, 0.9), ("m", 0, 0.1)], "model string, y int, p double")
    scored = metrics.score_table(df, ["model"]).first()
    assert scored.auroc == pytest.approx(0.875)
    assert scored.average_precision == pytest.approx(5 / 6)
    assert scored.accuracy == pytest.approx(0.75) and scored.f1 == pytest.approx(0.8)
    hard = metrics.score_table(df.withColumn("p", encode.binarize("p").cast("double")), ["model"]).first()
    assert hard.average_precision == pytest.approx(2 / 3)


def test_perfect_scores_have_the_best_curve(spark):
    df = spark.createDataFrame([("m", i % 2, 0.9 if i % 2 else 0.1) for i in range(10)], "model string, y int, p double")
    points = metrics.mcc_f1_curve(metrics.thresholds(df, ["model"]), ["model"])
    assert metrics.mcc_f1(points, ["model"]).first().mcc_f1 == pytest.approx(1.0)


def test_samples_and_folds(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 10 == 0).alias("target"))
    assert labels.sample_n(df, 37, ["id"]).count() == 37
    assert labels.sample_n(df, 5000, ["id"]).count() == 1000
    assert rows(labels.sample_n(df, 37, ["id"]), "id") == rows(labels.sample_n(df.repartition(7), 37, ["id"]), "id")
    sizes = labels.stratified_folds(df, "target", ["id"]).groupBy("target", "fold").count()
    assert {r["count"] for r in sizes.collect() if r.target} == {20}
    assert labels.split_train_test(df, 0.2, ["id"]).where("is_test").count() == 200
    drawn = labels.sample_class_ratio(df, {"a": (50, 50), "b": (90, 10)}, ["id"]).groupBy("ratio", "target").count()
    assert {(r.ratio, r.target, r["count"]) for r in drawn.collect()} == {
        ("a", True, 50), ("a", False, 50), ("b", True, 10), ("b", False, 90)
    }
    assert labels.class_sizes(447)["65_35"] == (830, 447) and labels.class_sizes(447)["90_10"] == (1350, 150)


def test_scores_are_replaced_when_a_run_is_stored_again(spark):
    path = scratch_path(spark, "scores")

    def part(run, value):
        return spark.createDataFrame(
            [(run, 0, 7, "lr", 0, "f1", value)],
            "run_id string, target_start int, target_end int, model string, fold int, metric string, value double",
        )

    tables.store_scores(part("a", 0.1), path)
    tables.store_scores(part("b", 0.2), path)
    assert rows(tables.store_scores(part("a", 0.3), path), "run_id", "value") == [("a", 0.3), ("b", 0.2)]


def test_csv_drops_index_columns(spark):
    path = scratch_path(spark, "csv")
    spark.createDataFrame([("0", "1", "2.5")], "`Unnamed: 0` string, id string, v string").write.csv(path, header=True)
    assert tables.scan_csv(spark, path).columns == ["id", "v"]
