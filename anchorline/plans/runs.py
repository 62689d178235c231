"""Whole runs: from source tables to a matrix, from a matrix to stored scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from anchorline.functions.metrics import METRICS, score_table, scores_long
from anchorline.operators import cohort as members, features as feats, impute, labels, models, quality, scaling, stacking
from anchorline.plans.sweeps import run_name
from anchorline.session import cut_lineage
from anchorline.sources import concepts, tables

SPECIMEN_KEYS = ("micro_specimen_id", "person_id")
CLINICAL_COLUMNS = {"vital": concepts.VITAL_COLUMNS, "lab": concepts.LAB_COLUMNS}


@dataclass
class Sources:
    """The source tables of a specimen run."""

    micro: DataFrame
    patients: DataFrame
    person: DataFrame
    admissions: DataFrame
    icustays: DataFrame
    visits: DataFrame
    measurement: DataFrame
    concept: DataFrame
    death: DataFrame


def specimen_matrices(
    sources: Sources,
    runs: Mapping[str, feats.Windows],
    anchor: str = "micro",
    columns: Mapping[str, Mapping[str, str]] = CLINICAL_COLUMNS,
    concept_ids: Sequence[int] | None = None,
    one_visit: bool = True,
    out: str | None = None,
) -> DataFrame:
    """The matrices of many windows, told apart by ``run_id``: cohort, windowed measurements without outliers, six
    statistics each, statics and outcome.

    All runs share one scan and one join of the measurements; outliers are judged within a run. The windowed rows are
    written to ``out`` by run, or checkpointed: they are read for the outlier limits and again for the features, and
    the join that makes them is the dearest step. A dictionary without families gets them from the concept lists.
    """
    keys = list(SPECIMEN_KEYS)
    dictionary = sources.concept if "family" in sources.concept.columns else concepts.with_families(sources.concept)
    who = members.specimen_cohort(
        sources.micro, sources.patients, sources.person, sources.admissions, sources.icustays
    )
    # four later steps start from the cohort, so it is made once
    anchored = cut_lineage(members.with_anchor(who, anchor))
    rows = feats.sweep_windows(sources.measurement, dictionary, anchored, runs, concept_ids=concept_ids)
    if out:
        stored = tables.write_table(rows, f"{out}/long", ["run_id"])
        rows = stored.where(F.col("run_id").isin(list(runs)))
    else:
        rows = cut_lineage(rows)
    by = ["run_id", "concept_name"]
    kept = quality.reject_vitals_outliers(rows.where(F.col("family") == "vital"), by=by).unionByName(
        quality.reject_labs_outliers(rows.where(F.col("family") == "lab"), by=by)
    )
    names = {name: column for family in columns.values() for name, column in family.items()}
    wide = feats.feature_stats(kept, ["run_id", *keys], names, require=["vital", "lab"])
    statics = members.specimen_statics(
        anchored, sources.patients, sources.person, sources.visits, sources.concept, one_visit
    )
    died = members.outcomes(anchored, sources.death, keys)
    return feats.matrix(anchored, wide, died, keys, statics)


def specimen_matrix(
    sources: Sources, vitals: tuple[int, int] = (48, 48), labs: tuple[int, int] = (72, 72), anchor: str = "micro", **options
) -> DataFrame:
    """The matrix of one pair of windows; see ``specimen_matrices`` for the options."""
    run = {run_name(anchor, vitals, labs): {"vital": vitals, "lab": labs}}
    return specimen_matrices(sources, run, anchor, **options).drop("run_id")


# the two published orders of preparation; both are lists of (step, argument)
SCALE_THEN_IMPUTE = (("scale", "standard"), ("impute", "forest"))
IMPUTE_THEN_SCALE = (("coverage", 25), ("impute", "forest"), ("anomalies", "z"), ("impute", "mean"), ("scale", "standard"))


def prepare(
    df: DataFrame, key: str, columns: Sequence[str], steps: Sequence[tuple[str, object]] = SCALE_THEN_IMPUTE, **options
) -> tuple[DataFrame, list[str]]:
    """Apply the steps in order; return the frame and the columns that are left."""
    imputers = {
        "mean": impute.impute_mean,
        "median": impute.impute_median,
        "forest": lambda d, c: impute.impute_forest(d, c, **options),
        "knn": lambda d, c: impute.impute_knn(d, key, c, **options),
        "chained": lambda d, c: impute.impute_chained(d, c, **options),
        "em": lambda d, c: impute.impute_em(d, c, **options),
    }
    columns = list(columns)
    for step, argument in steps:
        if step == "coverage":
            df = quality.drop_low_coverage(df, columns, argument)
            columns = [c for c in columns if c in df.columns]
        elif step == "scale":
            df = scaling.scale(df, columns, argument)
        elif step == "impute":
            df = imputers[argument](df, columns)
        elif step == "anomalies":
            df = quality.correct_anomalies(df, columns, argument)
        else:
            raise ValueError(f"unknown step {step}")
    return df, columns


@dataclass
class Suite:
    """Families and effort of a model run; the defaults are the published grids."""

    boosted: models.Family = field(default_factory=models.boosted)
    boosted_2: models.Family = field(default_factory=models.boosted_2)
    logistic: models.Family = field(default_factory=models.logistic)
    perceptron: models.Family = field(default_factory=models.perceptron)
    perceptron_selected: models.Family = field(default_factory=lambda: models.perceptron(models.MLP_SELECTED))
    n_select: int = models.SELECTED_FEATURES
    select_from: Sequence[str] | None = None
    select_depth: int = 30
    test_fraction: float = 0.2
    folds: int = 5
    parallelism: int = 8
    models: Sequence[str] | None = None  # names of the models to run; all if None
    stages: Sequence[Mapping[str, Sequence]] | None = None  # tunes boosted trees stage after stage instead of by their grid

    def wants(self, *names: str) -> bool:
        return self.models is None or any(n in self.models for n in names)

    def single(self, selected: bool) -> dict[str, models.Family]:
        return {
            "xgb": self.boosted,
            "lr": self.logistic,
            "lgbm": self.boosted_2,
            "mlp": self.perceptron_selected if selected else self.perceptron,
        }


ENSEMBLES = ("xgb_ensemble", "lr_ensemble")


def _tuned(df: DataFrame, features: Sequence[str], family: models.Family, suite: Suite) -> dict[str, object]:
    if suite.stages and family.name == "xgb":
        return models.tune_staged(df, features, family, suite.stages, suite.folds, suite.parallelism)[0]
    options = models.candidates(family.grid) if family.grid else [{}]
    if len(options) == 1:
        return options[0]
    return models.tune_grid(df, features, family, suite.folds, suite.parallelism)[0]


def run_model_suite(
    df: DataFrame, ids: Sequence[str], features: Sequence[str], views: Mapping[str, Sequence[str]], suite: Suite,
    choices: str | None = None,
) -> tuple[DataFrame, list[str]]:
    """Tidy out-of-fold scores (model, fold, metric, value) of ``suite_predictions``, scored in one go, and the selection."""
    predictions, selected = suite_predictions(df, ids, features, views, suite, choices)
    return score_predictions(predictions, ["model", "fold"]), selected


def score_predictions(predictions: DataFrame, group: Sequence[str]) -> DataFrame:
    return scores_long(score_table(predictions, list(group)), list(group), METRICS)


def suite_predictions(
    df: DataFrame, ids: Sequence[str], features: Sequence[str], views: Mapping[str, Sequence[str]], suite: Suite,
    choices: str | None = None,
) -> tuple[DataFrame, list[str]]:
    """Up to ten models on one labelled, prepared frame: four families on all and on selected features, and
    two stacked ones. Returns the out-of-fold predictions of all models, checkpointed, and the selection.

    First-level settings are tuned on the training part only, on the first view. With ``choices``, a folder, the selected features and
    tuned settings are stored there as soon as they are found, and a run that finds them there uses them.
    """
    spark = df.sparkSession
    frame = models.model_frame(df, ids, features, k=suite.folds).persist()
    known = tables.load_choices(spark, choices) if choices else {}
    made = [frame]

    def chosen(name: str, find) -> object:
        if name not in known:
            known[name] = find()
            if choices:
                tables.store_choice(spark, choices, name, known[name])
        return known[name]

    def select() -> list[str]:
        found = models.select_forward(frame, list(suite.select_from or features), suite.n_select, suite.folds, suite.select_depth)
        return [c["feature"] for c in found]

    parts: list[DataFrame] = []

    def add(name: str, rows: DataFrame, columns: Sequence[str], family: models.Family) -> None:
        settings = chosen(f"settings/{name}", lambda: _tuned(rows, columns, family, suite))
        scored = models.out_of_fold(rows, columns, family, settings, ids, suite.folds, suite.parallelism)
        parts.append(scored.withColumn("model", F.lit(name)))

    selected: list[str] = []
    for name, family in suite.single(False).items():
        if suite.wants(name):
            add(name, frame, features, family)
    for name, family in suite.single(True).items():
        if suite.wants(f"{name}_min"):
            selected = selected or list(chosen("selection", select))
            add(f"{name}_min", frame, selected, family)

    if suite.wants(*ENSEMBLES):
        split = labels.split_train_test(frame, suite.test_fraction, ids).persist()
        train = split.where(~F.col("is_test"))
        first_view = next(iter(views.values()))
        boosted = chosen("settings/first_boosted", lambda: _tuned(train, first_view, suite.boosted, suite))
        logistic = chosen("settings/first_lr", lambda: _tuned(train, first_view, suite.logistic, suite))
        stacked = stacking.stack_first_level(
            split, views, list(suite.single(False).values()), {"xgb": boosted, "lgbm": boosted, "lr": logistic}, ids, suite.parallelism
        )
        outputs = [c for c in stacked.columns if c not in (*ids, "label")]
        second = models.fit_sized(labels.stratified_folds(stacked, "label", ids, suite.folds), len(outputs)).persist()
        made += [split, second]
        for name, family in zip(ENSEMBLES, (suite.boosted, suite.logistic), strict=True):
            if suite.wants(name):
                add(name, second, outputs, family)

    predictions = cut_lineage(reduce(DataFrame.unionByName, parts))
    for cached in made:
        cached.unpersist()
    return predictions, selected


def run_all_targets(
    prepared: DataFrame,
    ids: Sequence[str],
    features: Sequence[str],
    families: Mapping[str, Sequence[str]],
    run_id: str,
    path: str,
    targets: Sequence[int | tuple[int, int]] = labels.TARGETS,
    suite: Suite | None = None,
    censor_hours: int | None = None,
    label_anchor: str = "anchor_time",
    resume: bool = False,
) -> DataFrame:
    """Label, model and store the scores of every target window; a target rerun replaces its scores.

    ``censor_hours`` drops members who died before the observation window ended. Outcomes are counted from
    ``label_anchor``, which need not be the time that the windows lie around. With ``resume`` targets whose scores are
    stored are left alone, and selected features and tuned settings, stored beside the scores by run and target, are
    used again.
    """
    spark = prepared.sparkSession
    rows = labels.censor_early(prepared, censor_hours) if censor_hours is not None else prepared
    rows = cut_lineage(rows)
    views = {name: cols for name, cols in feats.feature_views(features, families).items() if cols}
    done = tables.stored_runs(spark, path) if resume else set()
    for start, end in labels.target_spans(targets):
        if (run_id, start, end) in done:
            continue
        labelled = labels.label_outcome(rows, start, end, label_anchor)
        choices = f"{path}-choices/{run_id}/{start}-{end}" if resume else None
        scores, _ = run_model_suite(labelled, ids, features, views, suite or Suite(), choices)
        tables.store_scores(
            scores.withColumns(
                {"run_id": F.lit(run_id), "target_start": F.lit(start), "target_end": F.lit(end)}
            ),
            path,
        )
    return tables.load_scores(spark, path)
