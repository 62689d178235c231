"""Resumable sweeps, stored choices, label anchors and families by concept id."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from anchorline.catalogue import run_queries
from anchorline.operators import models
from anchorline.plans import ledger, runs
from anchorline.plans.sweeps import window_runs
from anchorline.sources import concepts, tables

SF = "/root/testdata/sf0.001"
LR = runs.Suite(logistic=models.logistic({"C": [1.0]}), models=("lr",), folds=2)
FEATURES = ["a_max", "b_max"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    dead = rng.random(120) < 0.4
    start = pd.Timestamp("2024-01-01")
    data = pd.DataFrame({"id": range(120), "a_max": dead + 0.3 * rng.normal(size=120), "b_max": rng.normal(size=120)})
    data["anchor_time"] = start
    data["chart_time"] = start + pd.Timedelta(days=20)
    data["death_datetime"] = [start + pd.Timedelta(days=3 if d else 22) for d in dead]
    return spark.createDataFrame(data).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("anchor_time", "chart_time", "death_datetime")})


def test_a_sweep_runs_what_is_missing(spark, rows, tmp_path):
    path, made = str(tmp_path / "scores"), []

    def setting(name):
        def make():
            made.append(name)
            return rows, FEATURES

        return make

    run = lambda names, targets: ledger.sweep(spark, {n: setting(n) for n in names}, ["id"], {"x": ["a", "b"]}, path, targets, LR)
    assert run(["r1", "r2"], [7]).select("run_id").distinct().count() == 2 and sorted(made) == ["r1", "r2"]
    before = {tuple(r) for r in tables.load_scores(spark, path).collect()}
    assert run(["r1", "r2", "r3"], [7]).select("run_id").distinct().count() == 3 and made[2:] == ["r3"]
    after = {tuple(r) for r in tables.load_scores(spark, path).collect()}
    assert before <= after and tables.stored_runs(spark, path) == {("r1", 0, 7), ("r2", 0, 7), ("r3", 0, 7)}
    run(["r1"], [7, 14])
    assert made[3:] == ["r1"] and ("r1", 0, 14) in tables.stored_runs(spark, path)
    assert tables.stored_runs(spark, str(tmp_path / "none")) == set()


def test_choices_are_stored_and_used_again(spark, rows, tmp_path, monkeypatch):
    path = str(tmp_path / "choices")
    labelled = rows.withColumn("target", F.col("death_datetime") < F.col("chart_time"))
    suite = runs.Suite(
        boosted=models.boosted({}, maxIter=2), stages=[{"maxDepth": [1, 2], "positiveWeight": [0.4]}, {"maxIter": [2, 3]}],
        logistic=models.logistic({"C": [1.0, 0.1]}), models=("xgb", "lr_min"), n_select=1, folds=2,
    )
    scores, selected = runs.run_model_suite(labelled, ["id"], FEATURES, {"x_max": FEATURES}, suite, path)
    known = tables.load_choices(spark, path)
    assert selected == ["a_max"] == known["selection"] and set(known["settings/xgb"]) == {"maxDepth", "positiveWeight", "maxIter"}
    assert {r["model"] for r in scores.select("model").distinct().collect()} == {"xgb", "lr_min"}
    monkeypatch.setattr(models, "tune_grid", None)
    monkeypatch.setattr(models, "select_forward", None)
    again, _ = runs.run_model_suite(labelled, ["id"], FEATURES, {"x_max": FEATURES}, suite, path)
    assert sorted(map(str, again.collect())) == sorted(map(str, scores.collect()))


def test_outcomes_count_from_the_label_anchor(spark, rows, tmp_path, monkeypatch):
    seen = {}
    monkeypatch.setattr(runs, "run_model_suite", lambda df, *a: (seen.setdefault("n", df.where("target").count()), 1 / 0))
    for anchor, died in (("anchor_time", rows.where(F.col("death_datetime") < F.lit(datetime.datetime(2024, 1, 8))).count()), ("chart_time", None)):
        seen.clear()
        with pytest.raises(ZeroDivisionError):
            runs.run_all_targets(rows, ["id"], FEATURES, {"x": ["a", "b"]}, "r", str(tmp_path / anchor), [7], LR, label_anchor=anchor)
        assert seen["n"] == (died if died is not None else rows.count() - rows.where("death_datetime < chart_time").count())


def test_families_by_id(spark):
    dictionary = spark.createDataFrame([(3004249, "Systolic"), (3019550, "Sodium"), (1, "Other"), (None, "x")], "concept_id int, concept_name string")
    found = {tuple(r) for r in concepts.with_families(dictionary).collect()}
    assert found == {(3004249, "Systolic", "vital"), (3019550, "Sodium", "lab")}
    assert concepts.with_families(dictionary.limit(0)).count() == 0


def test_one_window_alone_and_among_others(spark):
    """The matrix of a run does not depend on the runs made with it."""
    sources = run_queries.sources(spark, SF)
    many = runs.specimen_matrices(sources, window_runs("micro"), columns=run_queries.FAMILY_COLUMNS)
    one = runs.specimen_matrix(sources, (24, 96), (24, 96), columns=run_queries.FAMILY_COLUMNS)
    some = many.where(F.col("run_id") == "micro_vb_24_va_96_lb_24_la_96").select(one.columns)
    assert sorted(map(str, some.collect())) == sorted(map(str, one.collect())) and one.count() > 0
    assert {"gender", "age", "chart_time"} <= set(one.columns)


def test_setting_families(spark, rows):
    sizes = ledger.size_settings(rows, FEATURES, [10, 50], ["id"], "m")
    assert {n: make()[0].count() for n, make in sizes.items()} == {"m_n_10": 10, "m_n_50": 50}
    holes = rows.withColumn("b_max", F.when(F.col("id") % 2 == 0, F.col("b_max")))
    kept = {n: make()[1] for n, make in ledger.missingness_settings(holes, FEATURES, [20, 60], "id", "m", [("impute", "mean")]).items()}
    assert kept == {"m_missing_20": ["a_max"], "m_missing_60": FEATURES}
    scaled = ledger.scaling_settings(rows, FEATURES, ["minmax", "none"], "id", "m")
    low, high = scaled["m_scale_minmax"]()[0].agg(F.min("a_max"), F.max("a_max")).first()
    assert (low, high) == (0.0, 1.0)
