"""Two-level models: every family on every feature view, then a model on their probabilities."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from anchorline.operators.models import Family, assemble, fit_sized, fitted, in_threads, with_weights


def fit_first_level(
    train: DataFrame,
    views: Mapping[str, Sequence[str]],
    families: Sequence[Family],
    settings: Mapping[str, Mapping[str, object]],
    parallelism: int = 8,
) -> dict[tuple[str, str], Model]:
    """One model per family and view, all on the same cached training rows, which every fit reads once per iteration."""
    train = fit_sized(train, len({c for columns in views.values() for c in columns}))
    weights = {float(w) for f in families for w in f.weights()}
    weights |= {float(s["positiveWeight"]) for s in settings.values() if "positiveWeight" in s}
    rows = train.count()
    wide = with_weights(train, sorted(weights))
    for name, columns in views.items():
        wide = assemble(columns, f"view_{name}").transform(wide)
    wide = wide.persist()

    def job(family: Family, view: str) -> Callable[[], Model]:
        def run() -> Model:
            estimator = family.estimator(settings.get(family.name, {}), len(views[view]), rows)
            return fitted(estimator.setFeaturesCol(f"view_{view}"), wide, rows)

        return run

    pairs = [(f, v) for f in families for v in views]
    models = in_threads(train.sparkSession, [job(f, v) for f, v in pairs], parallelism)
    wide.unpersist()
    return {(f.name, v): m for (f, v), m in zip(pairs, models)}


def first_level_outputs(
    df: DataFrame, views: Mapping[str, Sequence[str]], models: Mapping[tuple[str, str], Model], keep: Sequence[str]
) -> DataFrame:
    """The probability of every first-level model as a column: one narrow pass, no joins by id."""
    wide = df
    for name, columns in views.items():
        wide = assemble(columns, f"view_{name}").transform(wide)
    outputs = []
    for number, ((family, view), model) in enumerate(models.items()):
        named = model.copy()
        named.setFeaturesCol(f"view_{view}").setPredictionCol(f"__class_{number}")
        named.setProbabilityCol(f"__p_{number}").setRawPredictionCol(f"__raw_{number}")
        wide = named.transform(wide).drop(f"__class_{number}", f"__raw_{number}")
        outputs.append(vector_to_array(F.col(f"__p_{number}"))[1].alias(f"{family}_{view}"))
    return wide.select(*keep, *outputs)


def stack_first_level(
    df: DataFrame,
    views: Mapping[str, Sequence[str]],
    families: Sequence[Family],
    settings: Mapping[str, Mapping[str, object]],
    ids: Sequence[str],
    parallelism: int = 8,
) -> DataFrame:
    """Fit on rows not marked ``is_test``; return ids, label and all probabilities of the test rows.

    The result is checkpointed: the second level reads it many times.
    """
    models = fit_first_level(df.where(~F.col("is_test")), views, families, settings, parallelism)
    outputs = first_level_outputs(df.where("is_test"), views, models, [*ids, "label"])
    return fit_sized(outputs, len(models))
