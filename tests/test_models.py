"""Models, stacking, tuning and whole runs on a small frame with one telling feature: what must hold for every fit."""

from unittest.mock import MagicMock

import numpy as np
import pytest
from pyspark.sql import functions as F

from anchorline.functions.metrics import METRICS, score_table, scores_long
from anchorline.operators import labels, models, stacking
from anchorline.operators.perceptron import minimised, passed
from anchorline.plans.runs import Suite, run_all_targets, run_model_suite

FEATURES = ["noise_a", "noise_b", "telling", "noise_c"]
VIEWS = {"left": ["noise_a", "telling"], "right": ["noise_b", "noise_c"]}
FAMILIES = [
    models.boosted({"maxDepth": [2], "positiveWeight": [0.4]}, maxIter=3), models.logistic({"C": [1.0]}),
    models.boosted_2({"maxDepth": [2], "positiveWeight": [0.3]}, maxIter=3), models.perceptron(3, maxIter=15),
]
SETTINGS = {"xgb": {"maxDepth": 2, "positiveWeight": 0.4}, "lgbm": {"maxDepth": 2, "positiveWeight": 0.3}, "lr": {"C": 1.0}}


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(160):
        telling = float(rng.normal())
        rows.append((i, i % 11, *[float(v) for v in rng.normal(size=2)], telling, float(rng.normal()), bool(telling + 0.1 * rng.normal() > 0.4)))
    return spark.createDataFrame(rows, "id long, who long, noise_a double, noise_b double, telling double, noise_c double, target boolean")


@pytest.fixture(scope="module")
def frame(table):
    return models.model_frame(table, ["id"], FEATURES).persist()


@pytest.mark.parametrize("family", FAMILIES, ids=lambda f: f.name)
def test_fits_give_probabilities_and_learn(frame, family):
    model = models.fit(frame, FEATURES, family, SETTINGS.get(family.name, {}))
    rows = model.transform(frame).select("label", models.positive_probability().alias("p")).collect()
    assert len(rows) == 160 and all(0 <= r["p"] <= 1 for r in rows)
    assert np.mean([r["p"] for r in rows if r["label"]]) > np.mean([r["p"] for r in rows if not r["label"]])


def test_frame_is_folded_evenly(frame):
    sizes = {(r["label"], r["fold"]): r["count"] for r in frame.groupBy("label", "fold").count().collect()}
    for label in (0.0, 1.0):
        mine = [n for (y, _), n in sizes.items() if y == label]
        assert len(mine) == 5 and max(mine) - min(mine) <= 1


def test_every_row_is_scored_once_out_of_fold(frame):
    scored = models.out_of_fold(frame, FEATURES, FAMILIES[1], {"C": 1.0}, ["id"]).collect()
    assert sorted(r["id"] for r in scored) == list(range(160)) and all(0 <= r["p"] <= 1 for r in scored)


def test_cross_validated_scores_are_those_of_the_predictions(frame):
    stored = models.out_of_fold(frame, FEATURES, FAMILIES[1], {"C": 1.0}, ["id"])
    expected = scores_long(score_table(stored, ["fold"]), ["fold"], METRICS).collect()
    got = models.cross_validate(frame, FEATURES, FAMILIES[1], {"C": 1.0}).collect()
    assert {(r["fold"], r["metric"]): pytest.approx(r["value"]) for r in expected} == {(r["fold"], r["metric"]): r["value"] for r in got}


def test_selection_finds_the_telling_feature_first(frame):
    chosen = models.select_forward(frame, FEATURES, n_select=2, max_depth=3)
    assert chosen[0]["feature"] == "telling" and [c["step"] for c in chosen] == [1, 2]
    assert len(models.select_forward(frame, FEATURES[:2], n_select=25, max_depth=2)) == 2


def test_selection_over_all_rows_chooses_as_on_few(spark, frame, monkeypatch):
    """Rows that stay on the executors, their nodes split by sums or not, give the choices and scores of a tree grown whole."""
    few = models.select_forward(frame, FEATURES, n_select=3, max_depth=6)
    monkeypatch.setattr(models, "DRIVER_ROWS", 50)
    for node_rows in (None, 30):
        found = models.select_forward(frame, FEATURES, n_select=3, max_depth=6, node_rows=node_rows)
        assert [c["feature"] for c in found] == [c["feature"] for c in few]
        assert [c["score"] for c in found] == pytest.approx([c["score"] for c in few])


def test_selection_sees_every_row(spark):
    """A feature that tells of less than one row in a thousand is still worth more than noise."""
    n = 30_000
    x = spark.range(n).select(
        "id", (F.col("id") % 5).cast("int").alias("fold"), ((F.col("id") * 7919) % 101).cast("double").alias("noise"),
        F.when(F.col("id") % 1500 < 5, F.col("id") % 1500 + 1.0).otherwise(0.0).alias("rare"),
    )
    rows = x.withColumn("label", F.when(F.col("rare") > 0, 1.0).otherwise(0.0))
    found = models.select_forward(rows, ["noise", "rare"], n_select=1, max_depth=5)
    assert found == [{"step": 1, "feature": "rare", "score": 1.0}]
    noise = models.select_forward(rows, ["noise"], n_select=1, max_depth=1)
    assert noise[0]["score"] == pytest.approx(1 - 5 / 1500)


def test_tuned_settings_are_the_best_of_their_table(spark, frame):
    best, tried = models.tune_grid(frame, FEATURES, models.logistic({"C": [1.0, 0.0001]}))
    rows = models.search_table(spark, tried).collect()
    assert len(rows) == 2 and best["C"] == 1.0
    stages = [{"maxDepth": [1, 2], "positiveWeight": [0.4]}, {"maxIter": [2, 4]}]
    best, tried = models.tune_staged(frame, FEATURES, models.boosted({}, maxIter=2), stages)
    assert set(best) >= {"maxDepth", "positiveWeight", "maxIter"} and models.search_table(spark, tried).count() == 4


def test_perceptrons_of_many_rows_take_the_same_steps(spark, frame, monkeypatch):
    """Fitted with matrix products in tasks, a perceptron ends where MLlib's does, but for rounding."""
    family = models.perceptron(7, maxIter=12)
    rows = frame.repartition(3, "id").persist()
    usual = models.fit(rows, FEATURES, family)
    monkeypatch.setattr(models, "MATRIX_PRODUCTS", 0)
    monkeypatch.setattr(models.Family, "spread", lambda self, df, *a: df)
    other = models.fit(rows, FEATURES, family)
    assert list(other.stages[1].weights) == pytest.approx(list(usual.stages[1].weights), abs=1e-8)
    said = [{r["id"]: r["p"] for r in m.transform(rows).select("id", models.positive_probability().alias("p")).collect()} for m in (usual, other)]
    assert said[1] == pytest.approx(said[0], abs=1e-8)


def test_a_perceptron_settles_where_the_loss_is_least():
    rng = np.random.default_rng(0)
    spread = np.exp(rng.uniform(-2, 2, 12))
    found = minimised(lambda x: (float((spread * (x - 3) ** 2).sum() + 1), 2 * spread * (x - 3)), rng.normal(size=12), 200, 1e-12)
    assert found == pytest.approx(np.full(12, 3.0), abs=1e-4)
    x, y = rng.normal(size=(9, 4)), rng.integers(0, 2, 9)
    weights, share = rng.normal(size=4 * 3 + 3 + 3 * 2 + 2), np.full(9, 1 / 9)
    loss, gradient = passed(weights, [4, 3, 2], x, y, share)
    for j in range(len(weights)):
        step = np.eye(len(weights))[j] * 1e-6
        slope = (passed(weights + step, [4, 3, 2], x, y, share)[0] - passed(weights - step, [4, 3, 2], x, y, share)[0]) / 2e-6
        assert gradient[j] == pytest.approx(slope, abs=1e-6)


def test_stacking_columns_and_rows(frame):
    split = labels.split_train_test(frame, 0.5, ["id"]).persist()
    out = stacking.stack_first_level(split, VIEWS, FAMILIES, SETTINGS, ["id"])
    assert set(out.columns) == {"id", "label"} | {f"{f.name}_{v}" for f in FAMILIES for v in VIEWS}
    rows = out.collect()
    assert sorted(r["id"] for r in rows) == sorted(r["id"] for r in split.where("is_test").collect())
    assert all(0 <= r[f"{f.name}_{v}"] <= 1 for r in rows for f in FAMILIES for v in VIEWS)


def small_suite():
    boosted, logistic, boosted_2, perceptron = FAMILIES
    return Suite(
        boosted, boosted_2, logistic, perceptron, models.perceptron(2, maxIter=10), n_select=1, select_depth=3,
        test_fraction=0.5, folds=3,
    )


def test_suite_scores_ten_models(table):
    scores, selected = run_model_suite(table, ["id"], FEATURES, VIEWS, small_suite())
    assert selected == ["telling"]
    rows = scores.collect()
    assert len({r["model"] for r in rows}) == 10 and len(rows) == 10 * 3 * len(METRICS)
    assert all(r["value"] is None or -1e-9 <= r["value"] <= 1 + 1e-9 for r in rows)


def test_suite_queries_run_as_published(monkeypatch):
    """All target windows, whole grids, all picks and all iterations."""
    from anchorline.catalogue import model_queries

    asked = {}
    monkeypatch.setattr(model_queries, "prepared", lambda spark, sf_dir: MagicMock())
    monkeypatch.setattr(model_queries, "scratch_path", lambda spark, name: name)
    monkeypatch.setattr(model_queries, "run_model_suite", lambda *a: asked.setdefault("suite", a[4:]) and (None, None))
    monkeypatch.setattr(model_queries, "run_all_targets", lambda *a, **options: asked.setdefault("targets", options))
    model_queries.run_model_suite_query(None, "")
    model_queries.run_all_targets_query(None, "")
    assert asked["suite"] == (Suite(),)
    assert asked["targets"] == {"suite": Suite(), "censor_hours": 0}
    published = Suite()
    assert published.boosted.grid == models.BOOSTED_GRID and published.n_select == models.SELECTED_FEATURES
    assert [f.fixed["maxIter"] for f in published.single(False).values()] == [100, 100, 100, 300]


def test_stacks_fit_the_published_models(monkeypatch):
    """All iterations and layers, at settings of the published grids."""
    from anchorline.catalogue import model_queries

    asked = {}
    monkeypatch.setattr(model_queries, "frame", lambda spark, sf_dir: None)
    monkeypatch.setattr(model_queries.labels, "split_train_test", lambda *a: MagicMock())
    monkeypatch.setattr(model_queries.stacking, "stack_first_level", lambda rows, views, *a: asked.update(zip(("families", "settings"), a)))
    model_queries.stack_first_level(None, "")
    assert asked["families"] == [models.boosted(), models.logistic(), models.boosted_2(), models.perceptron()]
    for family in asked["families"]:
        chosen = asked["settings"].get(family.name, {})
        assert set(chosen) == set(family.grid) and all(chosen[n] in tried for n, tried in family.grid.items())


def test_rerun_of_a_target_replaces_its_scores(spark, table, tmp_path):
    at = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))
    dead = F.when(F.col("target"), at + F.expr("INTERVAL 3 DAY"))
    names = {f: f"{f}_max" for f in FEATURES}
    rows = table.withColumn("anchor_time", at).withColumn("death_datetime", dead).drop("target").withColumnsRenamed(names)
    views = {"vital": ["noise_a", "telling"], "lab": ["noise_b", "noise_c"]}
    for _ in range(2):
        stored = run_all_targets(rows, ["id"], list(names.values()), views, "run", str(tmp_path / "scores"), targets=[7], suite=small_suite())
    assert stored.count() == 10 * 3 * len(METRICS)
    assert {(r["target_start"], r["target_end"]) for r in stored.select("target_start", "target_end").distinct().collect()} == {(0, 7)}


def test_batch_scores_are_stored(frame, tmp_path):
    model = models.fit(frame, FEATURES, FAMILIES[1], {"C": 1.0})
    stored = models.batch_score(model, frame, ["id"], str(tmp_path / "batch"))
    assert stored.count() == 160 and set(stored.columns) == {"id", "p"}


def test_a_fit_uses_the_cores_its_rows_are_worth(spark):
    columns = [f"c{j}" for j in range(24)]
    rows = spark.range(60_000).select("id", *[F.rand(j).alias(c) for j, c in enumerate(columns)])
    cores = spark.sparkContext.defaultParallelism
    sized = models.fit_sized(rows.repartition(16), 24)
    assert sized.rdd.getNumPartitions() == min(cores, 3) and sized.count() == 60_000
    assert models.fit_sized(rows.limit(100), 24).rdd.getNumPartitions() == 1
    one = sized.coalesce(1)
    assert models.perceptron().spread(one, 24, 60_000).rdd.getNumPartitions() == cores
    assert models.perceptron(10).spread(one, 24, 60_000).rdd.getNumPartitions() == 1
    assert models.logistic().spread(one, 24, 60_000).rdd.getNumPartitions() == 1


def test_first_level_rows_are_sized_for_fits(spark, monkeypatch):
    """However many partitions a shuffle left, the fits of small training rows run one task each."""
    seen, sized = [], stacking.fit_sized
    monkeypatch.setattr(stacking, "fit_sized", lambda df, width: seen.append(sized(df, width)) or seen[-1])
    rows = spark.range(200).select(F.rand(1).alias("noise_a"), F.rand(2).alias("telling"), (F.col("id") % 2).cast("double").alias("label"))
    stacking.fit_first_level(rows.repartition(16), {"left": ["noise_a", "telling"]}, [models.logistic()], {"lr": {"C": 1.0}})
    assert len(seen) == 1 and seen[0].rdd.getNumPartitions() == 1


def test_grid_search_holds_the_rows_once(spark, monkeypatch):
    """No copy of the rows per fold, the scores of plain fits, and folds that must all be there."""
    rows = spark.createDataFrame([(float(i % 7), float(i % 3), float(i % 7 > 3), i % 3) for i in range(210)], "a double, b double, label double, fold int")
    held = []
    kind = type(rows)
    persist, cache = kind.persist, kind.cache
    monkeypatch.setattr(kind, "persist", lambda df, *a: held.append(df) or persist(df, *a))
    monkeypatch.setattr(kind, "cache", lambda df: held.append(df) or cache(df))
    family = models.logistic({"C": [1.0, 1e-6]})
    best, tried = models.tune_grid(rows, ["a", "b"], family, k=3, parallelism=2)
    assert len(held) == 1 and best == {"C": 1.0}
    for candidate in tried:
        right = []
        for fold in range(3):
            estimator = family.estimator(candidate["settings"], 2, 140)
            data = models.assemble(["a", "b"]).transform(rows)
            found = estimator.fit(data.where(F.col("fold") != fold)).transform(data.where(F.col("fold") == fold))
            right.append(found.select(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0])
        assert candidate["score"] == pytest.approx(sum(right) / 3)
    with pytest.raises(ValueError):
        models.tune_grid(rows.where("fold < 2"), ["a", "b"], family, k=3)
