"""Preparations fitted on some rows and applied to others, and scorers that are saved and loaded with them.

What a step learned (moments, constants, means and covariances, regressions, ranges, kept columns) is a few numbers per
column. It is stored as a table with a row per step, so a scorer needs nothing but its folder.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from anchorline.operators import models, quality, scaling
from anchorline.operators.impute.chained import Chain, fit_chained
from anchorline.operators.impute.em import Gaussian, fit_em
from anchorline.operators.impute.grouped import Start
from anchorline.operators.impute.simple import Constants, fit_mean, fit_median, fit_mode

FITS: dict[str, Callable] = {"mean": fit_mean, "median": fit_median, "mode": fit_mode, "em": fit_em, "chained": fit_chained}
STATE = "position int, step string, state string"


@dataclass
class Kept:
    """Attributes that a coverage limit removed."""

    dropped: list[str]

    def apply(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.dropped)


@dataclass
class Ranges:
    """Accepted range per column; values outside become null."""

    limits: dict[str, tuple[float | None, float | None]]

    def apply(self, df: DataFrame) -> DataFrame:
        def kept(c: str):
            low, high = self.limits.get(c, (None, None))
            return F.col(c) if low is None else F.when(F.col(c).between(F.lit(low), F.lit(high)), F.col(c)).alias(c)

        return df.select(*[kept(c) for c in df.columns])


def _start(state: dict) -> Start:
    return Start(*(np.array(state[k]) for k in ("rows", "known", "centre", "scale")))


def _start_state(start: Start) -> dict:
    return {k: getattr(start, k).tolist() for k in ("rows", "known", "centre", "scale")}


def _state(step: object) -> tuple[str, dict]:
    """Kind and plain numbers of a fitted step."""
    if isinstance(step, Constants):
        return "constants", {"columns": step.columns, "found": {c: step.found.get((0, c)) for c in step.columns}}
    if isinstance(step, Gaussian):
        return "gaussian", {
            "columns": step.columns, "start": _start_state(step.start), "means": step.means.tolist(), "covariances": step.covariances.tolist()
        }
    if isinstance(step, Chain):
        return "chain", {"columns": step.columns, "start": _start_state(step.start), "rounds": [w.tolist() for w in step.rounds.get(0, [])]}
    if isinstance(step, scaling.Scaling):
        return "scaling", {"how": step.how, "columns": step.columns, "fitted": step.fitted}
    if isinstance(step, Ranges):
        return "ranges", {"limits": step.limits}
    return "kept", {"dropped": step.dropped}


def _step(kind: str, state: dict) -> object:
    if kind == "constants":
        return Constants(state["columns"], None, [None], {(0, c): v for c, v in state["found"].items()})
    if kind == "gaussian":
        return Gaussian(state["columns"], None, [None], _start(state["start"]), np.array(state["means"]), np.array(state["covariances"]))
    if kind == "chain":
        return Chain(state["columns"], None, [None], _start(state["start"]), {0: [np.array(w) for w in state["rounds"]]})
    if kind == "scaling":
        return scaling.Scaling(**state)
    if kind == "ranges":
        return Ranges({c: tuple(v) for c, v in state["limits"].items()})
    return Kept(state["dropped"])


@dataclass
class Preparation:
    """Fitted steps in order, and the columns that they leave."""

    steps: list[object]
    columns: list[str]

    def apply(self, df: DataFrame) -> DataFrame:
        """Rows as the fitted steps prepare them, whether the fit saw them or not. Narrow."""
        for step in self.steps:
            df = step.apply(df) if hasattr(step, "apply") else step.fill(df)
        return df

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, *(lambda s: (s[0], json.dumps(s[1])))(_state(step))) for i, step in enumerate(self.steps)]
        rows.append((len(rows), "columns", json.dumps({"columns": self.columns})))
        spark.createDataFrame(rows, STATE).coalesce(1).write.mode("overwrite").parquet(path)


def load_preparation(spark: SparkSession, path: str) -> Preparation:
    *steps, last = spark.read.parquet(path).orderBy("position").collect()
    return Preparation([_step(r["step"], json.loads(r["state"])) for r in steps], json.loads(last["state"])["columns"])


def fit_preparation(train: DataFrame, columns: Sequence[str], steps: Sequence[tuple[str, object]], **options) -> Preparation:
    """Fit the steps of ``prepare`` on ``train``, each on what the earlier ones made of it.

    Steps that keep rows instead of numbers (nearest neighbours, forests) have no such form and are refused.
    """
    columns, fitted, rows = list(columns), [], train
    for step, argument in steps:
        if step == "scale":
            fitted.append(scaling.fit_scale(rows, columns, argument))
        elif step == "impute" and argument in FITS:
            fitted.append(FITS[argument](rows, columns, **options))
        elif step == "coverage":
            kept = set(quality.columns_kept(quality.coverage(rows, columns), argument))
            fitted.append(Kept([c for c in columns if c not in kept]))
            columns = [c for c in columns if c in kept]
        elif step == "anomalies":
            bounds = quality.anomaly_bounds(rows, columns, argument).collect()
            fitted.append(Ranges({r["column_name"]: (r["low"], r["high"]) for r in bounds}))
        else:
            raise ValueError(f"no fitted form of {step} {argument}")
        rows = Preparation([fitted[-1]], columns).apply(rows)
    return Preparation(fitted, columns)


@dataclass
class Scorer:
    """A preparation and the model fitted on what it prepares."""

    preparation: Preparation
    model: PipelineModel

    def score(self, df: DataFrame, ids: Sequence[str]) -> DataFrame:
        """Ids and probability of raw rows: one narrow pass."""
        return self.model.transform(self.preparation.apply(df)).select(*ids, models.positive_probability().alias("p"))

    def save(self, spark: SparkSession, path: str) -> None:
        self.preparation.save(spark, f"{path}/preparation")
        self.model.write().overwrite().save(f"{path}/model")


def load_scorer(spark: SparkSession, path: str) -> Scorer:
    return Scorer(load_preparation(spark, f"{path}/preparation"), PipelineModel.load(f"{path}/model"))


def fit_scorer(
    train: DataFrame, columns: Sequence[str], steps: Sequence[tuple[str, object]], family: models.Family, settings=None
) -> Scorer:
    """``train`` has ``label``; only its rows are seen by the steps and the model."""
    preparation = fit_preparation(train, columns, steps)
    return Scorer(preparation, models.fit(preparation.apply(train), preparation.columns, family, settings))
