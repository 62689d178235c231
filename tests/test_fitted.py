"""Preparations and scorers that are fitted, saved, loaded and applied to rows they have not seen."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from anchorline.operators import models
from anchorline.operators.features import feature_views
from anchorline.plans import fitted
from anchorline.plans.runs import prepare
from anchorline.session import cut_lineage
from anchorline.sources import concepts

COLUMNS = ["a", "b", "c"]
ORDERS = [
    (("scale", "standard"), ("impute", "mean")),
    (("coverage", 40), ("impute", "median"), ("anomalies", "z"), ("impute", "mean"), ("scale", "minmax")),
    (("scale", "standard"), ("impute", "em")),
    (("scale", "none"), ("impute", "chained"), ("anomalies", "iqr"), ("impute", "mean")),
]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 3))
    x[:, 1] += x[:, 0]
    x[rng.random(x.shape) < [0.1, 0.2, 0.6]] = np.nan
    x[5, 0] = 40.0
    data = pd.DataFrame(x, columns=COLUMNS).assign(id=range(150), label=(np.nan_to_num(x[:, 0]) > 0).astype(float))
    df = spark.createDataFrame(data).withColumn("fold", (F.col("id") % 3).cast("int"))
    return cut_lineage(df.select("id", "label", "fold", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in COLUMNS]))


def values(df, columns):
    return [[r[c] for c in columns] for r in sorted(df.collect(), key=lambda r: r.id)]


@pytest.mark.parametrize("steps", ORDERS)
def test_saved_steps_give_the_same_values(spark, rows, tmp_path, steps):
    train = rows.where("id < 100")
    ready = fitted.fit_preparation(train, COLUMNS, steps)
    whole, kept = prepare(train, "id", COLUMNS, steps)
    assert ready.columns == kept
    flat = lambda df: np.array(values(df, kept), float)
    assert flat(ready.apply(train)) == pytest.approx(flat(whole), abs=1e-9, nan_ok=True)
    ready.save(spark, str(tmp_path / "p"))
    loaded = fitted.load_preparation(spark, str(tmp_path / "p"))
    assert loaded.columns == kept and values(loaded.apply(rows), kept) == values(ready.apply(rows), kept)
    # what a row becomes does not depend on the rows beside it
    alone = loaded.apply(rows.where("id = 120"))
    assert values(alone, kept) == [v for i, v in enumerate(values(ready.apply(rows), kept)) if i == 120]


def test_steps_without_a_fitted_form_are_refused(rows):
    for name in ("forest", "knn"):
        with pytest.raises(ValueError):
            fitted.fit_preparation(rows, COLUMNS, [("impute", name)])


def test_scorer_round_trip(spark, rows, tmp_path):
    scorer = fitted.fit_scorer(rows.where("id < 100"), COLUMNS, ORDERS[0], models.logistic(), {"C": 1.0})
    scorer.save(spark, str(tmp_path / "s"))
    loaded = fitted.load_scorer(spark, str(tmp_path / "s"))
    assert values(loaded.score(rows, ["id"]), ["id", "p"]) == values(scorer.score(rows, ["id"]), ["id", "p"])


def test_folds_do_not_leak(rows):
    """Changing a fold's own rows changes neither the scale nor the model that score the other rows of that fold."""
    prepared = lambda train: fitted.fit_preparation(train, COLUMNS, ORDERS[0]).apply
    run = lambda df: {r.id: r.p for r in models.out_of_fold(df, COLUMNS, models.logistic(), {"C": 1.0}, ["id"], 3, 3, prepared).collect()}
    changed = rows.withColumn("a", F.when(F.col("id") == 3, 1e6).otherwise(F.col("a")))
    before, after = run(rows), run(changed)
    same = [i for i in before if i % 3 == 0 and i != 3]
    assert [before[i] for i in same] == pytest.approx([after[i] for i in same]) and before[3] != after[3]


def test_views_of_the_file_form():
    columns = [f"{c}_{s}" for c in concepts.CSV_VITALS[:2] + concepts.CSV_LABS[:1] for s in ("max", "min", "avg", "stddev", "first", "last")]
    views = feature_views(columns, {"vital": concepts.CSV_VITALS, "lab": concepts.CSV_LABS})
    assert views["vital_sd"] == ["heartrate_stddev", "sysbp_stddev"] and views["lab_sd"] == ["chloride_serum_stddev"]
    assert sum(map(len, views.values())) == len(columns)
