"""Binary classifiers on the matrix: fitting, selection, tuning and out-of-fold scoring with MLlib."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import product
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import TaskContext, cloudpickle
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.util import inheritable_thread_target

from anchorline.functions.metrics import METRICS, score_table, scores_long
from anchorline.operators import all_rows
from anchorline.operators.labels import stratified_folds
from anchorline.operators.perceptron import fit_perceptron
from anchorline.operators.trees import coded, edges_of, grow
from anchorline.session import cut_lineage

# executors need no copy of this package: what runs in tasks is sent along
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# fixed values: search grids
BOOSTED_GRID = {"maxDepth": [6, 9, 12], "positiveWeight": [0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4]}
BOOSTED_2_GRID = {"maxDepth": [6, 9, 12], "positiveWeight": [0.1, 0.15, 0.2, 0.25, 0.3]}
LOGISTIC_GRID = {"C": [100.0, 10.0, 1.0, 0.1, 0.01]}
# fixed values: staged search, each stage keeping the winners of the earlier ones
BOOSTED_STAGES = [
    {"maxDepth": list(range(1, 10)), "positiveWeight": [0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4]},
    {"maxIter": list(range(50, 250, 10))},
    {"minInstancesPerNode": list(range(1, 10))},
    {"minInfoGain": [0.0, 0.1, 0.2, 0.3, 0.4]},
    {
        "subsamplingRate": [i / 10 for i in range(1, 10)],
        "featureSubsetStrategy": [str(i / 10) for i in range(1, 10)],
    },
]
SELECTED_FEATURES = 25
MLP_ALL, MLP_SELECTED = 200, 50


def in_threads(spark: SparkSession, jobs: Sequence[Callable[[], object]], parallelism: int) -> list:
    """Run driver-side job launches side by side; the work itself is Spark's."""
    if not jobs:
        return []
    pool = ThreadPool(min(parallelism, len(jobs)))
    try:
        return pool.map(inheritable_thread_target(spark)(lambda job: job()), jobs)
    finally:
        pool.close()


def model_frame(
    df: DataFrame, ids: Sequence[str], features: Sequence[str], target: str = "target", k: int = 5, seed: int = 42
) -> DataFrame:
    """Ids, features, ``label`` as a double and stratified ``fold``, in partitions sized for fitting."""
    rows = df.select(*ids, *features, F.col(target).cast("int").cast("double").alias("label"))
    return fit_sized(stratified_folds(cut_lineage(rows), "label", ids, k, seed), len(features))


TASK_CELLS = 1 << 19  # numbers a task of a fit is worth starting for
TASK_PRODUCTS = 1 << 26  # the same in products of a row and a weight, of which a perceptron has tens of thousands


def fit_sized(df: DataFrame, width: int, part_bytes: int = 32 << 20) -> DataFrame:
    """Stored rows in as many partitions as there are cores, if each then holds TASK_CELLS numbers, and in more if they
    would hold over 32 MB. A fit runs one small job per iteration, so on little data the number of tasks, and not the
    data, would set its time; on much data the cores do. The rows are stored before they are counted, so nothing
    upstream runs twice."""
    stored = cut_lineage(df)
    cells = stored.count() * width
    cores = df.sparkSession.sparkContext.defaultParallelism
    return stored.coalesce(max(1, min(cores, -(-cells // TASK_CELLS)), -(-cells * 8 // part_bytes)))


def with_weights(df: DataFrame, weights: Sequence[float]) -> DataFrame:
    """One row-weight column per positive-class weight, so that a grid can choose between them."""
    return df.withColumns({weight_column(w): F.when(F.col("label") == 1.0, float(w)).otherwise(1.0) for w in weights})


def weight_column(weight: float) -> str:
    return f"weight_{weight}".replace(".", "_")


def assemble(features: Sequence[str], output: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=output)


@dataclass
class Family:
    """How to build an estimator from named settings; ``grid`` is searched, ``fixed`` is not.

    ``positiveWeight`` weighs the positive rows. ``C`` is the inverse penalty of the logistic loss
    summed over rows, which MLlib states per row: regParam = 1 / (C * rows).
    """

    name: str
    grid: Mapping[str, Sequence] = field(default_factory=dict)
    fixed: Mapping[str, object] = field(default_factory=dict)

    def estimator(self, settings: Mapping[str, object], width: int, rows: int) -> Estimator:
        options = {**self.fixed, **settings}
        columns = {"featuresCol": "features", "labelCol": "label"}
        weight = options.pop("positiveWeight", None)
        if weight is not None:
            columns["weightCol"] = weight_column(weight)
        if self.name == "lr":
            penalty = 1.0 / (options.pop("C", 1.0) * max(1, rows))
            return LogisticRegression(
                regParam=penalty, elasticNetParam=0.0, standardization=False, **columns, **options
            )
        if self.name == "mlp":
            hidden = options.pop("hidden", MLP_ALL)
            return MultilayerPerceptronClassifier(layers=[width, hidden, hidden, 2], **columns, **options)
        return GBTClassifier(**columns, **options)

    def spread(self, df: DataFrame, width: int, rows: int) -> DataFrame:
        """The rows for a fit. A perceptron meets every row with all its weights, so that rows which fill one partition
        may be work for all cores; they are dealt anew once, as the fit holds what it reads."""
        if self.name != "mlp":
            return df
        hidden = self.fixed.get("hidden", MLP_ALL)
        products = rows * (width * hidden + hidden * hidden + 2 * hidden)
        parts = min(df.sparkSession.sparkContext.defaultParallelism, products // TASK_PRODUCTS)
        return df.repartition(parts) if parts > max(1, df.rdd.getNumPartitions()) else df

    def weights(self) -> list[float]:
        listed = [*self.grid.get("positiveWeight", [])]
        if "positiveWeight" in self.fixed:
            listed.append(self.fixed["positiveWeight"])
        return listed


def logistic(grid=LOGISTIC_GRID, **fixed) -> Family:
    return Family("lr", grid, {"maxIter": 100, **fixed})


def boosted(grid=BOOSTED_GRID, **fixed) -> Family:
    return Family("xgb", grid, {"maxIter": 100, "stepSize": 0.3, "seed": 1, **fixed})


def boosted_2(grid=BOOSTED_2_GRID, **fixed) -> Family:
    return Family(
        "lgbm", grid, {"maxIter": 100, "stepSize": 0.1, "minInstancesPerNode": 20, "maxBins": 255, "seed": 1, **fixed}
    )


def perceptron(hidden: int = MLP_ALL, **fixed) -> Family:
    return Family("mlp", {}, {"hidden": hidden, "maxIter": 300, "seed": 1, **fixed})


def positive_probability() -> Column:
    return vector_to_array("probability")[1]


MATRIX_PRODUCTS = 1 << 31  # of a row and a weight; from so many on a perceptron's pass is worth a job with Python tasks


def fitted(estimator: Estimator, df: DataFrame, rows: int) -> Model:
    """The estimator's model; of a perceptron with much work by ``fit_perceptron``, which does the same in less time."""
    if isinstance(estimator, MultilayerPerceptronClassifier):
        layers = estimator.getLayers()
        if rows * sum(a * b for a, b in zip(layers, layers[1:])) >= MATRIX_PRODUCTS:
            return fit_perceptron(estimator, df)
    return estimator.fit(df)


def fit(df: DataFrame, features: Sequence[str], family: Family, settings: Mapping[str, object] | None = None) -> PipelineModel:
    """Fit one model on all rows given."""
    rows = df.count() if family.name in ("lr", "mlp") else 0
    settings = dict(settings or {})
    weighted = with_weights(family.spread(df, len(features), rows), [*family.weights(), *[v for k, v in settings.items() if k == "positiveWeight"]])
    stage = assemble(features)
    return PipelineModel([stage, fitted(family.estimator(settings, len(features), rows), stage.transform(weighted), rows)])


def candidates(grid: Mapping[str, Sequence]) -> list[dict[str, object]]:
    """All combinations, the last setting varying fastest."""
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def tune_grid(
    df: DataFrame, features: Sequence[str], family: Family, k: int = 5, parallelism: int = 4, settled=None
) -> tuple[dict[str, object], list[dict[str, object]]]:
    """Mean accuracy over the folds per combination; the best, the first listed on a tie, and all of them.

    The rows are held once: a fit takes all folds but one from them and is judged on that one, without a copy per fold.
    """
    settled = dict(settled or {})
    tried = candidates(family.grid)
    sizes = {r["fold"]: r["count"] for r in df.groupBy("fold").count().collect()}
    rows = sum(sizes.values())
    if set(sizes) != set(range(k)) or k < 2:
        raise ValueError(f"folds must be 0 to {k - 1}, none of them empty: {list(sizes)}")
    weights = {w for c in tried for n, w in {**family.fixed, **settled, **c}.items() if n == "positiveWeight"}
    data = assemble(features).transform(with_weights(df, sorted(weights))).select(
        "features", "label", "fold", *[weight_column(w) for w in sorted(weights)]
    ).persist()
    estimators = [family.estimator({**settled, **c}, len(features), rows * (k - 1) // k) for c in tried]
    judge = MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy")

    def job(fold: int, estimator: Estimator) -> Callable[[], float]:
        def run() -> float:
            model = estimator.fit(data.where(F.col("fold") != fold))
            return judge.evaluate(model.transform(data.where(F.col("fold") == fold)))

        return run

    found = in_threads(df.sparkSession, [job(fold, e) for fold in range(k) for e in estimators], parallelism)
    scores = np.mean(np.reshape(found, (k, len(tried))), axis=0).tolist()
    data.unpersist()
    results = [{"candidate": i, "settings": c, "score": s} for i, (c, s) in enumerate(zip(tried, scores))]
    best = max(results, key=lambda r: (r["score"], -r["candidate"]))
    return {**settled, **best["settings"]}, results


def tune_staged(
    df: DataFrame, features: Sequence[str], family: Family, stages=BOOSTED_STAGES, k: int = 5, parallelism: int = 4
) -> tuple[dict[str, object], list[dict[str, object]]]:
    """Search stage after stage, fixing the winners of the earlier ones."""
    settled: dict[str, object] = {}
    history = []
    for number, grid in enumerate(stages):
        settled, results = tune_grid(df, features, Family(family.name, grid, family.fixed), k, parallelism, settled)
        history += [{"stage": number, **r} for r in results]
    return settled, history


def search_table(spark: SparkSession, results: Sequence[Mapping[str, object]]) -> DataFrame:
    """The tried combinations, one row each, ranked; the list is as long as the grid."""
    ordered = sorted(results, key=lambda r: (r.get("stage", 0), -r["score"], r["candidate"]))
    rows, place = [], {}
    for r in ordered:
        stage = r.get("stage", 0)
        place[stage] = place.get(stage, 0) + 1
        text = ", ".join(f"{n}={v}" for n, v in r["settings"].items())
        rows.append((stage, r["candidate"], text, float(r["score"]), place[stage]))
    return spark.createDataFrame(rows, "stage int, candidate int, settings string, score double, rank int")


def out_of_fold(
    df: DataFrame,
    features: Sequence[str],
    family: Family,
    settings: Mapping[str, object] | None = None,
    ids: Sequence[str] = (),
    k: int = 5,
    parallelism: int = 4,
    preparation: Callable[[DataFrame], Callable[[DataFrame], DataFrame]] | None = None,
) -> DataFrame:
    """Every row scored by the model that did not see its fold: ids, fold, y, p.

    ``preparation`` is fitted on the training rows of each fold and returns what prepares rows, so that no scale and no
    filled gap knows of the fold's own rows.
    """

    def job(fold: int) -> Callable[[], DataFrame]:
        def run() -> DataFrame:
            train, test = df.where(F.col("fold") != fold), df.where(F.col("fold") == fold)
            if preparation:
                ready = preparation(train)
                train, test = cut_lineage(ready(train)), ready(test)
            model = fit(train, features, family, settings)
            held = model.transform(test)
            return held.select(*ids, "fold", F.col("label").cast("int").alias("y"), positive_probability().alias("p"))

        return run

    parts = in_threads(df.sparkSession, [job(f) for f in range(k)], parallelism)
    return reduce(DataFrame.unionByName, parts)


def cross_validate(
    df: DataFrame, features: Sequence[str], family: Family, settings=None, k: int = 5, parallelism: int = 4
) -> DataFrame:
    """Tidy scores: fold, metric, value."""
    scored = out_of_fold(df, features, family, settings, (), k, parallelism)
    return scores_long(score_table(scored, ["fold"]), ["fold"], METRICS)


DRIVER_ROWS = 20_000  # a forward selection's trees on more rows than these are grown over rows that stay on the executors
SELECTED = "g int, block long, codes binary, label binary, fold binary"
RIGHT = "tree int, right long, tested long"


def _trials_on_few(df: DataFrame, features: list[str], max_depth: int, seed: int, rows: int) -> tuple[Callable, Callable]:
    """How trials, trees of (candidate, fold, columns), are judged on the ``rows`` rows with the least hash of the row and ``seed``,
    which go to the tasks once: found rows of (trial, share of right answers). Second, what ends it."""
    spark = df.sparkSession
    draw = F.xxhash64(*features, "label", F.lit(seed))
    held_rows = df.select(*features, "label", "fold").orderBy(draw, *features).limit(rows).toPandas()
    values = held_rows[features].to_numpy(dtype=float)
    codes = np.column_stack([coded(values[:, j], edges_of(values[:, j])) for j in range(values.shape[1])])
    classes, label = np.unique(held_rows["label"].to_numpy(), return_inverse=True)
    held = spark.sparkContext.broadcast((codes, label, np.eye(len(classes))[label], held_rows["fold"].to_numpy()))

    def judge(wanted: list[tuple[int, int, list[int]]]) -> list[tuple[int, float]]:
        def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            all_codes, truth, flags, folds = held.value
            for batch in batches:
                for trial in batch["id"]:
                    _, fold, columns = wanted[trial]
                    some, test = all_codes[:, columns], folds == fold
                    if not test.all() and test.any():
                        tree = grow(some[~test], flags[~test], np.ones(int((~test).sum())), max_depth)
                        right = np.argmax(tree.predict(some[test]), axis=1) == truth[test]
                        yield pd.DataFrame({"trial": [trial], "score": [float(right.mean())]})

        slices = min(len(wanted), 2 * spark.sparkContext.defaultParallelism)
        return spark.range(0, len(wanted), 1, slices).mapInPandas(go, "trial int, score double").collect()

    return judge, held.destroy


def _trials_on_all(df: DataFrame, features: list[str], max_depth: int, seed: int, n: int, node_rows: int | None) -> tuple[Callable, Callable]:
    """The same on all ``n`` rows, which stay on the executors in blocks."""
    spark, width = df.sparkSession, len(features)
    rows = cut_lineage(df.select(F.lit(0).alias("g"), *[F.col(c).cast("double").alias(c) for c in features], F.col("label").cast("double"), "fold"))
    edges = all_rows.cuts_of(rows, features, 1, "g")[0]
    classes = np.unique(np.array([r[0] for r in rows.select("label").distinct().collect()], float))
    parts = max(spark.sparkContext.defaultParallelism, -(-n // (32 * all_rows.BLOCK_ROWS)))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for first in range(0, len(batch), all_rows.BLOCK_ROWS):
                some = batch.iloc[first : first + all_rows.BLOCK_ROWS]
                codes = np.column_stack([coded(some[c].to_numpy(float), e) for c, e in zip(features, edges)])
                label = np.searchsorted(classes, some["label"].to_numpy(float)).astype(np.int32)
                fold = some["fold"].to_numpy(float)
                yield pd.DataFrame({"g": [0], "block": [number], "codes": [codes.tobytes()], "label": [label.tobytes()], "fold": [fold.tobytes()]})
                number += 1

    packed = rows if rows.rdd.getNumPartitions() >= parts else rows.repartition(parts)
    blocks = cut_lineage(packed.mapInPandas(pack, SELECTED))

    def look(block) -> tuple[np.ndarray, np.ndarray]:
        label = np.frombuffer(block.label, np.int32)
        return np.frombuffer(block.codes, np.uint8).reshape(-1, width), (label[:, None] == np.arange(len(classes))).astype(np.uint8)

    def judge(wanted: list[tuple[int, int, list[int]]]) -> list[tuple[int, float]]:
        def draw(block, trial: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            _, fold, columns = wanted[trial]
            test = np.frombuffer(block.fold, float) == fold
            return np.array(columns), (~test).astype(np.uint8), test

        def compare(block: pd.DataFrame, said: pd.DataFrame) -> pd.DataFrame:
            truth, out = np.frombuffer(block["label"].iloc[0], np.int32) if len(block) else np.zeros(0, np.int32), []
            for trial, places, values in zip(said["tree"], said["places"], said["answers"]):
                at = np.frombuffer(places, np.int32)
                told = np.argmax(np.frombuffer(values, float).reshape(len(at), -1), axis=1)
                out.append((trial, int((told == truth[at]).sum()), len(at)))
            return pd.DataFrame(out, columns=["tree", "right", "tested"])

        shape = (max(len(w[2]) for w in wanted), len(classes))
        said = all_rows.answers(blocks, {0: list(range(len(wanted)))}, {0: n}, look, draw, shape, max_depth, None, seed, node_rows, np.uint8)
        found = blocks.groupBy("g", "block").cogroup(said.groupBy("g", "block")).applyInPandas(compare, RIGHT)
        sums = found.groupBy("tree").agg(F.sum("right").alias("right"), F.sum("tested").alias("tested")).collect()
        return [(r["tree"], r["right"] / r["tested"]) for r in sums]

    return judge, lambda: None


def select_forward(
    df: DataFrame,
    features: Sequence[str],
    n_select: int = SELECTED_FEATURES,
    k: int = 5,
    max_depth: int = 30,
    seed: int = 1,
    fit_rows: int | None = None,
    node_rows: int | None = None,
) -> list[dict[str, object]]:
    """Add, one at a time, the feature that gives a decision tree the best mean fold accuracy.

    The first listed feature wins ties. All trials of a step, a tree per candidate and fold, are grown side by side in
    tasks, in at most 255 steps a column, on all rows: up to DRIVER_ROWS rows go to the tasks once, more of them stay on the
    executors, where nodes of more than ``node_rows`` rows (NODE_ROWS by default) are split by sums over all tasks. ``fit_rows`` asks
    for trials on that many rows, those with the least hash of the row and ``seed``. Every row needs all features.
    """
    features = list(features)
    n = df.count()
    if fit_rows is None and n > DRIVER_ROWS:
        judge, end = _trials_on_all(df, features, max_depth, seed, n, node_rows)
    else:
        judge, end = _trials_on_few(df, features, max_depth, seed, fit_rows or DRIVER_ROWS)
    chosen: list[dict[str, object]] = []
    taken: list[int] = []
    for step in range(min(n_select, len(features))):
        left = [j for j in range(len(features)) if j not in taken]
        wanted = [(j, fold, [*taken, j]) for j in left for fold in range(k)]
        means: dict[int, float] = {}
        for trial, score in sorted(judge(wanted)):
            means[wanted[trial][0]] = means.get(wanted[trial][0], 0.0) + score / k
        best = max(left, key=lambda j: (means.get(j, 0.0), -j))
        taken.append(best)
        chosen.append({"step": step + 1, "feature": features[best], "score": means.get(best, 0.0)})
    end()
    return chosen


def batch_score(model: Model, df: DataFrame, ids: Sequence[str], path: str) -> DataFrame:
    """Score all rows, store ids and probabilities, and read them back."""
    scored = model.transform(df).select(*ids, positive_probability().alias("p"))
    scored.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
