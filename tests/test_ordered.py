"""Ranks, running totals and quantiles against plain Python, with one group holding most rows."""

import random

import numpy as np
import pytest

from anchorline.functions.ordered import (
    hash_ranks, quantiles_of_counts, row_numbers, running_sums, value_counts, with_order_bucket,
)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    rows = [("hot" if i % 3 else f"g{i % 7}", int(i), float(rng.integers(0, 300))) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "g string, id long, v double").repartition(5)


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("buckets", [4, 256])
def test_running_sums(data, descending, buckets):
    rows, df = data
    counts = value_counts(df, ["g"], "v")
    out = running_sums(counts, ["g"], "value", {"cum": "n"}, descending, buckets).collect()
    for r in out:
        mine = [v for g, _, v in rows if g == r.g]
        assert r.cum == sum(1 for v in mine if (v >= r.value if descending else v <= r.value))
        assert r.cum_total == len(mine)


def test_row_numbers(data):
    rows, df = data
    out = row_numbers(with_order_bucket(df, "v", 16), ["g"], ["v", "id"], "rn").collect()
    order = {}
    for g in {r[0] for r in rows}:
        for n, (_, i, _) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1])), 1):
            order[i] = n
    assert {r.id: r.rn for r in out} == order


def test_hash_ranks_limit_is_the_head_of_the_full_ranking(data):
    _, df = data
    full = {r.id: r["rank"] for r in hash_ranks(df, ["id"], 1, ["g"]).collect()}
    head = {r.id: r["rank"] for r in hash_ranks(df, ["id"], 1, ["g"], at_most=25).collect()}
    assert head == {i: n for i, n in full.items() if n <= 25}


def test_quantiles(data):
    rows, df = data
    out = quantiles_of_counts(value_counts(df, ["g"], "v"), ["g"], {"a": 0.25, "b": 0.9999, "c": 1.0})
    for r in out.collect():
        mine = [v for g, _, v in rows if g == r.g]
        assert (r.a, r.b, r.c) == pytest.approx(tuple(np.quantile(mine, [0.25, 0.9999, 1.0])))


def test_rows_with_null_groups_or_ids_stay(spark):
    from anchorline.operators import labels

    rows = [(i if i % 5 else None, (i % 2 == 0) if i % 7 else None, float(i % 9)) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, target boolean, v double")
    folds = labels.stratified_folds(df, "target", ["id"]).collect()
    assert len(folds) == 100
    for kind in (True, False, None):
        sizes = [sum(1 for r in folds if r["target"] is kind and r["fold"] == f) for f in range(5)]
        assert max(sizes) - min(sizes) <= 1
    assert labels.sample_n(df, 100, ["id"]).count() == 100 and labels.sample_n(df, 60, ["id"]).count() == 60
    assert labels.split_train_test(df, 0.3, ["id"]).where("is_test").count() == 30
    counts = df.groupBy("target", "v").agg({"*": "count"}).withColumnRenamed("count(1)", "n")
    totals = {r["target"]: r["cum_total"] for r in running_sums(counts, ["target"], "v", {"cum": "n"}).collect()}
    assert totals == {k: sum(1 for r in rows if r[1] is k) for k in (True, False, None)}


def test_ids_are_told_apart(spark):
    df = spark.createDataFrame([(1, 23), (12, 3)], "a long, b long")
    from anchorline.functions.ordered import with_hash_bucket

    assert with_hash_bucket(df, ["a", "b"], 1).select("__hash").distinct().count() == 2


def test_one_instant_covers_many_cells(spark, monkeypatch):
    """A third of the rows share one instant of one group; they are numbered right, and no cell holds many of them."""
    import datetime

    from pyspark.sql import functions as F

    from anchorline.functions import ordered

    rng = random.Random(4)
    start = datetime.datetime(2024, 1, 1)
    times = [start + datetime.timedelta(hours=500 if rng.random() < 0.33 else rng.randint(0, 1000)) for _ in range(6000)]
    rows = [(i, "g" if rng.random() < 0.9 else None, t) for i, t in enumerate(times)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, g string, at timestamp_ntz").repartition(3)
    bucketed = ordered.with_tie_bucket(df, "at", "id")
    largest = bucketed.groupBy(ordered.BUCKET).count().agg(F.max("count")).first()[0]
    assert largest < 200
    got = {r["id"]: r["rn"] for r in ordered.row_numbers(bucketed, ["g"], ["at", "id"], "rn").collect()}
    expected = {}
    for g in ("g", None):
        for n, (_, i) in enumerate(sorted((t, i) for i, own, t in rows if own == g), 1):
            expected[i] = n
    assert got == expected
    assert ordered.with_tie_bucket(df.limit(0), "at", "id").count() == 0
    one = spark.createDataFrame([(i, start) for i in range(500)], "id long, at timestamp_ntz")
    assert ordered.with_tie_bucket(one, "at", "id").select(ordered.BUCKET).distinct().count() > 20
