"""Resumable sweeps: every setting gets a matrix, a preparation and models, and its scores are stored by run and target.

The stored scores are the ledger. A sweep that is started again runs what is missing: settings whose scores are all there
are skipped before their rows are made.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from threading import Lock

from pyspark.sql import DataFrame, SparkSession, functions as F

from anchorline.operators import features as feats, labels, quality
from anchorline.operators.models import in_threads
from anchorline.plans.runs import (
    CLINICAL_COLUMNS, SCALE_THEN_IMPUTE, SPECIMEN_KEYS, Sources, Suite, prepare, score_predictions, specimen_matrices,
    suite_predictions,
)
from anchorline.session import cut_lineage
from anchorline.sources import tables

Setting = Callable[[], tuple[DataFrame, list[str]]]
Targets = Sequence[int | tuple[int, int]]


def missing_runs(spark: SparkSession, path: str, run_ids: Sequence[str], targets: Targets) -> list[str]:
    """The runs of which a target's scores are not stored yet."""
    done = tables.stored_runs(spark, path)
    return [r for r in run_ids if any((r, s, e) not in done for s, e in labels.target_spans(targets))]


def sweep(
    spark: SparkSession,
    settings: Mapping[str, Setting],
    ids: Sequence[str],
    families: Mapping[str, Sequence[str]],
    path: str,
    targets: Targets = labels.TARGETS,
    suite: Suite | None = None,
    censor_hours: int | None = None,
    label_anchor: str = "anchor_time",
    side_by_side: int = 4,
    scored_at_once: int = 16,
) -> DataFrame:
    """The stored scores of all settings. A setting, by run id, makes its prepared rows and names its feature columns when it
    is run; see ``run_all_targets`` for censoring, anchor and stored choices.

    Settings are submitted ``side_by_side``: a fit runs many small jobs, and the waits of one setting are filled by the
    others. The predictions of ``scored_at_once`` settings are scored and stored together.
    """
    done = tables.stored_runs(spark, path)
    spans = labels.target_spans(targets)

    def job(run_id: str) -> Callable[[], list[DataFrame]]:
        def run() -> list[DataFrame]:
            rows, columns = settings[run_id]()
            rows = cut_lineage(labels.censor_early(rows, censor_hours) if censor_hours is not None else rows)
            views = {name: cols for name, cols in feats.feature_views(columns, families).items() if cols}
            out = []
            for start, end in spans:
                if (run_id, start, end) not in done:
                    labelled = labels.label_outcome(rows, start, end, label_anchor)
                    choices = f"{path}-choices/{run_id}/{start}-{end}"
                    found, _ = suite_predictions(labelled, ids, columns, views, suite or Suite(), choices)
                    named = {"run_id": F.lit(run_id), "target_start": F.lit(start), "target_end": F.lit(end)}
                    out.append(found.select("model", "fold", "y", "p").withColumns(named))
            return out

        return run

    missing = missing_runs(spark, path, list(settings), targets)
    for a in range(0, len(missing), scored_at_once):
        made = in_threads(spark, [job(r) for r in missing[a : a + scored_at_once]], side_by_side)
        predictions = cut_lineage(reduce(DataFrame.unionByName, [p for some in made for p in some]))
        group = ["run_id", "target_start", "target_end", "model", "fold"]
        tables.store_scores(score_predictions(predictions, group), path)
    wanted = F.col("run_id").isin(list(settings))
    return tables.load_scores(spark, path).where(wanted)


def prepared_runs(
    sources: Sources,
    runs: Mapping[str, feats.Windows],
    steps: Sequence[tuple[str, object]] = SCALE_THEN_IMPUTE,
    columns: Mapping[str, Mapping[str, str]] = CLINICAL_COLUMNS,
    anchor: str = "micro",
    out: str | None = None,
    **options,
) -> dict[str, Setting]:
    """Per window run its prepared matrix. The matrices of all runs are made together, when the first of them is asked for."""
    made: list[DataFrame] = []
    making = Lock()
    names = [f"{c}_{s}" for s in feats.STATISTICS for family in columns.values() for c in family.values()]

    def setting(run_id: str) -> Setting:
        def make() -> tuple[DataFrame, list[str]]:
            with making:
                if not made:
                    made.append(cut_lineage(specimen_matrices(sources, runs, anchor, columns, out=out)))
            rows = made[0].where(F.col("run_id") == run_id).drop("run_id")
            return prepare(rows, SPECIMEN_KEYS[0], names, steps, **options)

        return make

    return {run_id: setting(run_id) for run_id in runs}


def run_windows(
    sources: Sources,
    runs: Mapping[str, feats.Windows],
    families: Mapping[str, Sequence[str]],
    path: str,
    targets: Targets = labels.TARGETS,
    suite: Suite | None = None,
    steps: Sequence[tuple[str, object]] = SCALE_THEN_IMPUTE,
    columns: Mapping[str, Mapping[str, str]] = CLINICAL_COLUMNS,
    anchor: str = "micro",
    censor_hours: int | None = None,
    label_anchor: str = "anchor_time",
    **options,
) -> DataFrame:
    """From source tables to the stored scores of every window run and target: one scan and one join for all windows that
    are still missing, then preparation and models run by run."""
    spark = sources.measurement.sparkSession
    open_runs = {r: runs[r] for r in missing_runs(spark, path, list(runs), targets)}
    if open_runs:
        settings = prepared_runs(sources, open_runs, steps, columns, anchor, f"{path}-work", **options)
        sweep(spark, settings, SPECIMEN_KEYS, families, path, targets, suite, censor_hours, label_anchor)
    return tables.load_scores(spark, path).where(F.col("run_id").isin(list(runs)))


def size_settings(rows: DataFrame, columns: Sequence[str], sizes: Sequence[int], ids: Sequence[str], name: str) -> dict[str, Setting]:
    """Samples of every size, drawn in one pass; a smaller sample is part of a larger one."""
    samples = cut_lineage(labels.sample_sizes(rows, sizes, ids))
    take = lambda n: lambda: (samples.where(F.col("sample_size") == n).drop("sample_size"), list(columns))
    return {f"{name}_n_{n}": take(n) for n in sizes}


def ratio_settings(
    rows: DataFrame, columns: Sequence[str], ratios: Sequence[str], ids: Sequence[str], name: str, target: tuple[int, int] = (0, 7), total: int = 1500
) -> dict[str, Setting]:
    """Samples of every class ratio of one target, drawn in one pass."""
    labelled = cut_lineage(labels.label_outcome(rows, *target))
    positives = labelled.where("target").count()
    drawn = cut_lineage(labels.sample_class_ratio(labelled, labels.class_sizes(positives, total, ratios), ids))
    take = lambda r: lambda: (drawn.where(F.col("ratio") == r).drop("ratio", "target"), list(columns))
    return {f"{name}_ratio_{r}": take(r) for r in ratios}


def missingness_settings(
    rows: DataFrame, columns: Sequence[str], thresholds: Sequence[float], key: str, name: str, steps: Sequence[tuple[str, object]]
) -> dict[str, Setting]:
    """The columns that each threshold keeps, from one coverage report; thresholds that keep none are left out."""
    report = cut_lineage(quality.coverage(rows, columns))
    kept = {t: set(quality.columns_kept(report, t)) for t in thresholds}
    take = lambda t: lambda: prepare(rows, key, [c for c in columns if c in kept[t]], steps)
    return {f"{name}_missing_{t}": take(t) for t in thresholds if kept[t]}


def scaling_settings(
    rows: DataFrame, columns: Sequence[str], scalings: Sequence[str], key: str, name: str, steps: Sequence[tuple[str, object]] = (("impute", "mean"),)
) -> dict[str, Setting]:
    """Every scaling, followed by the same steps."""
    take = lambda how: lambda: prepare(rows, key, columns, [("scale", how), *steps])
    return {f"{name}_scale_{how}": take(how) for how in scalings}
