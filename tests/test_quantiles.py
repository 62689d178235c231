"""Exact quantiles by brackets: same answers as sorting, few rows moved, and brackets that miss."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from anchorline.functions import ordered
from anchorline.functions.ordered import CELL, bracketed_counts, exact_quantiles
from anchorline.session import cut_lineage

ASKED = {"q3": 0.75, "low": 0.0, "median": 0.5, "high": 0.9999, "top": 1.0}


def groups():
    rng = np.random.default_rng(6)
    return {
        "many": rng.normal(size=9000), "copies": np.repeat([1.0, 2.0, 3.0], [3000, 4000, 1000]), "few": np.array([5.0, 1.0, 4.0]),
        "one": np.array([7.0]), None: rng.integers(0, 50, 3000).astype(float), "tail": np.concatenate([np.zeros(4000), [1e9, -1e9]]),
    }


@pytest.fixture(scope="module")
def long(spark):
    rows = [(g, float(v)) for g, values in groups().items() for v in values] + [("many", None), ("empty", None)]
    return cut_lineage(spark.createDataFrame(rows, "g string, v double").repartition(5))


@pytest.mark.parametrize("sample", [10**6, 2000, 60])
def test_exact_whatever_the_sample(long, sample):
    got = {r["g"]: r for r in exact_quantiles(long, ["g"], "v", ASKED, sample_values=sample).collect()}
    assert set(got) == set(groups())
    for g, values in groups().items():
        for name, p in ASKED.items():
            assert got[g][name] == pytest.approx(np.quantile(values, p), abs=1e-9)


def test_groups_whose_brackets_miss_are_counted_again(long, monkeypatch):
    """Brackets of no width hold hardly any quantile: the counts show it, and the answer stays exact."""
    monkeypatch.setattr(ordered, "DEVIATIONS", 0.0)
    monkeypatch.setattr(ordered, "SPARE", 0)
    got = {r["g"]: r["median"] for r in exact_quantiles(long, ["g"], "v", {"median": 0.5}, sample_values=300).collect()}
    assert got == pytest.approx({g: np.median(v) for g, v in groups().items()})


def test_few_values_are_moved(spark):
    """Three quartiles of many values: under 5 % of them leave their task, and the rest as a few numbers."""
    df = cut_lineage(spark.range(2_000_000).select(F.rand(3).alias("value"), F.lit(1).alias("g")).repartition(4))
    rows = df.select(F.struct("g").alias(CELL), "value")
    brackets = ordered._brackets(rows.sample(0.1, 7), [0.25, 0.5, 0.75])
    counts = bracketed_counts(rows, brackets, 3)
    assert counts.agg(F.sum("n")).first()[0] == 2_000_000 and counts.count() < 0.05 * 2_000_000
