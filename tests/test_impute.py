"""Imputers on small matrices: exact answers where they are defined, invariants elsewhere."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from anchorline.catalogue import preparation
from anchorline.operators import impute
from anchorline.operators.impute import chained, em, grouped, knn
from anchorline.operators.impute.compare import hide_cells
from anchorline.operators.impute.grouped import GROUP
from anchorline.session import cut_lineage

COLUMNS = ["a", "b", "c", "d"]


def matrix(n=120, seed=5, missing=0.2, copies=40):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, 2))
    x = np.column_stack([base[:, 0], base[:, 0] + 0.1 * rng.normal(size=n), base[:, 1], base.sum(axis=1)])
    x[rng.random(x.shape) < missing] = np.nan
    x[:copies] = x[0]
    return x


def frame(spark, x):
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double").repartition(4)


def back(df):
    return np.array(
        [[np.nan if r[c] is None else r[c] for c in COLUMNS] for r in sorted(df.collect(), key=lambda r: r.id)]
    )


def brute_knn(x, k):
    out, mean = x.copy(), np.nanmean(x, axis=0)
    for i, j in zip(*np.where(np.isnan(x))):
        found = []
        for o in range(len(x)):
            both = ~np.isnan(x[i]) & ~np.isnan(x[o])
            if not np.isnan(x[o, j]) and both.any():
                found.append((x.shape[1] * ((x[i] - x[o])[both] ** 2).sum() / both.sum(), o))
        near = [x[o, j] for _, o in sorted(found)[:k]]
        out[i, j] = np.mean(near) if near else mean[j]
    return out


@pytest.mark.parametrize("leaf_rows,part_rows,probe", [(256, 4096, 4), (8, 4, 1), (8, 16, 3)])
def test_knn_is_exact_in_many_leaves_and_with_copies(spark, leaf_rows, part_rows, probe):
    x = matrix()
    x[60] = np.nan
    got = back(impute.impute_knn(frame(spark, x), "id", COLUMNS, k=5, leaf_rows=leaf_rows, part_rows=part_rows, probe=probe))
    assert got == pytest.approx(brute_knn(x, 5))


def correlated(n, d, factors, missing, seed, noise=0.2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, factors)) @ rng.normal(size=(factors, d)) + noise * rng.normal(size=(n, d))
    x = x / x.std(axis=0)
    x[rng.random(x.shape) < missing] = np.nan
    return x


def wide_frame(spark, x, **more):
    d = x.shape[1]
    data = pd.DataFrame(x, columns=[f"c{j}" for j in range(d)]).assign(id=np.arange(len(x)), **more)
    return spark.createDataFrame(data).select([F.when(~F.isnan(c), F.col(c)).alias(c) if c.startswith("c") else F.col(c) for c in data.columns])


def test_knn_visits_few_leaves(spark):
    """With gaps in 16.6 % of the cells a row meets less than a fifth of the units, and no bound hides a neighbour."""
    x = correlated(3000, 24, 2, 0.166, 1, 0.1)
    columns = [f"c{j}" for j in range(24)]
    base = cut_lineage(wide_frame(spark, x).select(F.lit(0).alias(GROUP), "id", *columns))
    index = knn.build_index(base, columns, 1, leaf_rows=32)
    queries = index.queries()
    visited = lambda df: df.agg(F.sum(F.size("units"))).first()[0]
    probed = visited(index.visits(queries, True))
    found = cut_lineage(knn._best(index.search(queries, True, 5), 5))
    rest = visited(index.visits(index.limited(queries, found, 5), False))
    assert (probed + rest) / (queries.count() * index.count) < 0.2
    units = knn.Units(*index.units.value)
    placed = index.placed.toPandas()
    y, unit = placed[columns].to_numpy(float), placed["unit"].to_numpy()
    for i in range(0, 3000, 300):
        bounds = units.lower_bounds(0, y[i : i + 1])[0]
        both = ~np.isnan(y[i]) & ~np.isnan(y)
        distance = 24 * np.where(both, (y - y[i]) ** 2, 0).sum(axis=1) / np.maximum(both.sum(axis=1), 1)
        assert (bounds[unit][both.any(axis=1)] <= distance[both.any(axis=1)]).all()


def test_knn_copies_a_row_to_few_shelves(spark):
    """Where bounds skip nothing, a row is sent to no more shelves, and a donor to no more blocks, than SHELVES and one."""
    x = np.random.default_rng(3).normal(size=(4000, 6))
    x[np.random.default_rng(4).random(x.shape) < 0.2] = np.nan
    columns = [f"c{j}" for j in range(6)]
    base = cut_lineage(wide_frame(spark, x).select(F.lit(0).alias(GROUP), "id", *columns))
    index = knn.build_index(base, columns, 1, leaf_rows=64, part_rows=64)
    queries = index.queries()
    most = queries.count() * (knn.SHELVES + 1)
    assert index.visits(queries, False).count() <= most and index.blocks <= knn.SHELVES and index.shelves <= knn.SHELVES + 1


def test_knn_with_large_numbers_and_ties(spark):
    """Columns far from zero, on a coarse grid, so that many donors are equally far."""
    rng = np.random.default_rng(8)
    x = 1e6 + rng.integers(0, 3, size=(150, 4)).astype(float)
    x[rng.random(x.shape) < 0.25] = np.nan
    got = back(impute.impute_knn(frame(spark, x), "id", COLUMNS, k=5, leaf_rows=16, part_rows=8, probe=1))
    assert got == pytest.approx(brute_knn(x, 5), rel=1e-12)


def versions(spark, xs):
    """Several tables in one frame, told apart by ``v``; ids repeat."""
    parts = [frame(spark, x).withColumn("v", F.lit(v)) for v, x in xs.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@pytest.mark.parametrize("method", ["mean", "median", "knn", "em", "chained", "forest"])
def test_versions_of_a_table_are_filled_apart(spark, method):
    """Filling many versions at once gives what filling each of them alone gives."""
    xs = {None: matrix(60, 1, 0.2, 10), "b": matrix(50, 2, 0.3, 5), "a": matrix(40, 3, 0.0, 5)}
    fills = {
        "mean": impute.impute_mean, "median": impute.impute_median, "em": lambda d, c, **o: impute.impute_em(d, c, max_rounds=4, **o),
        "chained": lambda d, c, **o: impute.impute_chained(d, c, max_rounds=3, **o),
        "knn": lambda d, c, **o: impute.impute_knn(d, "id", c, leaf_rows=8, **o),
        "forest": lambda d, c, **o: impute.impute_forest(d, c, max_rounds=2, trees=3, **o),
    }
    together = cut_lineage(fills[method](versions(spark, xs), COLUMNS, by="v"))
    for v, x in xs.items():
        got = back(together.where(F.col("v").eqNullSafe(F.lit(v))))
        assert got[~np.isnan(x)] == pytest.approx(x[~np.isnan(x)]) and not np.isnan(got).any()
        if method != "forest":  # its trees are seeded by the version's number
            assert got == pytest.approx(back(fills[method](frame(spark, x), COLUMNS)), rel=1e-6, abs=1e-8)


def test_simple_fills(spark):
    x = matrix()
    df = frame(spark, x)
    gone = np.isnan(x)
    assert back(impute.impute_mean(df, COLUMNS)) == pytest.approx(np.where(gone, np.nanmean(x, axis=0), x))
    assert back(impute.impute_median(df, COLUMNS)) == pytest.approx(np.where(gone, np.nanmedian(x, axis=0), x))
    modes = spark.createDataFrame([(1, 2.0), (2, 1.0), (3, 2.0), (4, 1.0), (5, None)], "id long, a double")
    assert impute.impute_mode(modes, ["a"]).where("id = 5").first().a == 1.0


def dense_em(x, rounds, ridge=1e-8):
    """The same model, row by row."""
    centre, scale = np.nanmean(x, axis=0), np.nanstd(x, axis=0)
    z = (x - centre) / scale
    mean, cov = np.zeros(x.shape[1]), np.eye(x.shape[1]) * (1 + ridge)

    def row(v):
        gone, extra, out = np.isnan(v), np.zeros_like(cov), v.copy()
        if gone.any():
            here = ~gone
            gain = cov[np.ix_(gone, here)] @ np.linalg.pinv(cov[np.ix_(here, here)])
            out[gone] = mean[gone] + gain @ (v[here] - mean[here])
            extra[np.ix_(gone, gone)] = cov[np.ix_(gone, gone)] - gain @ cov[np.ix_(here, gone)]
        return out, extra

    for _ in range(rounds):
        pairs = [row(v) for v in z]
        full, extra = np.array([p[0] for p in pairs]), sum(p[1] for p in pairs)
        mean = full.mean(axis=0)
        away = full - mean
        cov = (away.T @ away + extra) / len(z) + ridge * np.eye(len(mean))
    return np.array([row(v)[0] for v in z]) * scale + centre


def dense_chain(x, rounds, ridge=1e-9):
    centre, scale = np.nanmean(x, axis=0), np.nanstd(x, axis=0)
    z, gone = (x - centre) / scale, np.isnan(x)
    now, n = np.where(gone, 0.0, z), len(x)
    for _ in range(rounds):
        guess = now.copy()
        for j in np.flatnonzero(gone.any(axis=0)):
            whole = np.column_stack([np.ones(n), np.delete(now, j, axis=1)])
            some = whole[~gone[:, j]]
            weights = np.linalg.solve(some.T @ some + ridge * len(some) * np.eye(some.shape[1]), some.T @ now[~gone[:, j], j])
            guess[gone[:, j], j] = whole[gone[:, j]] @ weights
        now = guess
    return now * scale + centre


@pytest.mark.parametrize("scale", [1.0, 1e6])
@pytest.mark.parametrize("method", ["em", "chained"])
def test_gaussian_fills_equal_a_dense_solution(spark, method, scale, monkeypatch):
    """Also with columns far from zero, sums in many pieces, and merging in two levels."""
    monkeypatch.setattr(grouped, "PIECE", 3)
    monkeypatch.setattr(grouped, "ONE_LEVEL", 1)
    monkeypatch.setattr(grouped, "PART_BYTES", 1500)
    monkeypatch.setattr(chained, "SUM_BYTES", 300)
    x = matrix(n=150, copies=0, missing=0.15) * scale + 1000 * scale
    x[3] = np.nan
    fill, dense = {"em": (impute.impute_em, dense_em), "chained": (impute.impute_chained, dense_chain)}[method]
    with pytest.warns(grouped.NotSettled):
        got = back(fill(frame(spark, x), COLUMNS, max_rounds=3, tolerance=1e-12))
    assert (got - 1000 * scale) / scale == pytest.approx((dense(x, 3) - 1000 * scale) / scale, abs=1e-5)


def test_em_of_a_pattern_per_row(spark):
    """Many columns, and hardly two rows that lack the same cells."""
    x = correlated(1500, 60, 3, 0.16, 2)
    names = [f"c{j}" for j in range(60)]
    out = impute.impute_em(wide_frame(spark, x), names, max_rounds=8).toPandas().sort_values("id")[names].to_numpy()
    truth, gone = correlated(1500, 60, 3, 0.0, 2), np.isnan(x)
    assert out[~gone] == pytest.approx(x[~gone]) and ((out - truth)[gone] ** 2).mean() < 0.1 * (truth[gone] ** 2).mean()


@pytest.mark.parametrize("fit", ["fit_mean", "fit_median", "fit_em", "fit_chained"])
def test_a_fit_fills_rows_it_has_not_seen(spark, fit):
    """Rows of a test fold get what the training rows fix, and large ids and other columns pass unchanged."""
    x = matrix(n=200, copies=0, missing=0.15)
    train, big = frame(spark, x[:150]), 2**60 + 1
    model = getattr(impute, fit)(train, COLUMNS)
    whole = back(model.fill(frame(spark, x)))
    alone = model.fill(frame(spark, x).where("id >= 150").withColumn("id", F.col("id") + big).withColumn("t", F.lit("s")))
    rows = sorted(alone.collect(), key=lambda r: r.id)
    assert [r.id for r in rows] == [big + i for i in range(150, 200)] and {r.t for r in rows} == {"s"}
    assert back(alone) == pytest.approx(whole[150:]) and not np.isnan(whole).any()


def test_forest(spark):
    x = np.array([[1, 2, np.nan], [3, 4, 3], [np.nan, 6, 5], [8, 8, 7]], dtype=float)
    df = spark.createDataFrame(
        [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "id long, a double, b double, c double"
    )
    out = impute.impute_forest(df, ["a", "b", "c"], max_rounds=3, trees=5, max_depth=3)
    got = np.array([[r.a, r.b, r.c] for r in sorted(out.collect(), key=lambda r: r.id)], dtype=float)
    seen = ~np.isnan(x)
    assert out.columns == df.columns and got[seen] == pytest.approx(x[seen])
    assert (got >= np.nanmin(x, axis=0)).all() and (got <= np.nanmax(x, axis=0)).all()


def test_compare_scores_hidden_cells_only(spark):
    x = matrix(n=300, copies=0, missing=0.1)
    df = frame(spark, x)
    methods = {"mean": impute.impute_mean, "chained": impute.impute_chained}
    out = {r.method: r.r2 for r in impute.impute_compare(df, "id", COLUMNS, methods, [0.2]).collect()}
    masked = hide_cells(df, "id", COLUMNS, 0.2)
    truth = np.array([[r[f"__true_{c}"] for c in COLUMNS] for r in sorted(masked.collect(), key=lambda r: r.id)], dtype=float)
    left = back(masked.select("id", *COLUMNS))
    hidden = ~np.isnan(truth)
    assert 0.1 < hidden.sum() / (~np.isnan(x)).sum() < 0.3 and np.isnan(left[hidden]).all()
    guess = np.broadcast_to(np.nanmean(left, axis=0), x.shape)[hidden]
    expected = 1 - ((truth[hidden] - guess) ** 2).sum() / ((truth[hidden] - truth[hidden].mean()) ** 2).sum()
    assert out["mean"] == pytest.approx(expected) and out["chained"] > out["mean"]
    assert masked.where(F.col("a").isNotNull() & F.col("__true_a").isNotNull()).count() == 0


@pytest.mark.parametrize("grown", [1, 10])
def test_forests_fill_rows_outside_the_sample(spark, grown, monkeypatch):
    """Rows beyond ``fit_rows`` are filled by the sample's forests, as are the sample's own rows."""
    x = correlated(400, 4, 1, 0.15, 7, 0.05)
    gone = np.isnan(x)
    names = ["c0", "c1", "c2", "c3"]
    df = wide_frame(spark, x)
    out = impute.impute_forest(df, names, max_rounds=3, trees=grown, fit_rows=150).toPandas().sort_values("id")[names].to_numpy()
    assert not np.isnan(out).any() and out[~gone] == pytest.approx(x[~gone])
    mean = np.nanmean(x, axis=0)
    truth = correlated(400, 4, 1, 0.0, 7, 0.05)
    error = lambda y: ((y - truth)[gone] ** 2).mean()
    assert error(out) < 0.35 * error(np.where(gone, mean, x))


def test_forests_pass_over_the_rows_once_a_round_on_all_cores(spark, monkeypatch):
    """However many columns there are, a round costs all rows one pass, in as many tasks as there are cores."""
    from anchorline.operators.impute import forest

    x = correlated(300, 10, 1, 0.2, 7, 0.05)
    names = [f"c{j}" for j in range(10)]
    stored = []
    monkeypatch.setattr(forest, "cut_lineage", lambda df: stored.append(df) or df.checkpoint())
    out = impute.impute_forest(wide_frame(spark, x).coalesce(1), names, max_rounds=1, trees=1, fit_rows=100)
    assert len(stored) == 2 and out.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert not np.isnan(out.select(*names).toPandas().to_numpy()).any()


@pytest.mark.parametrize("node_rows", [None, 1500])
def test_forests_are_fitted_on_all_rows(spark, node_rows):
    """What only a single row of a larger table tells is learned from it, however nodes are split."""
    rng = np.random.default_rng(4)
    rare = np.repeat(np.arange(0.5, 20.0), 2)
    a = np.concatenate([rng.integers(0, 20, 12_000).astype(float), rare])
    b = np.concatenate([rng.normal(size=12_000), np.tile([1000.0, np.nan], 20)])
    options = {"node_rows": node_rows} if node_rows else {}
    out = impute.impute_forest(wide_frame(spark, np.column_stack([a, b])), ["c0", "c1"], max_rounds=1, trees=30, **options)
    got = out.toPandas().sort_values("id")[["c0", "c1"]].to_numpy()
    seen = ~np.isnan(b)
    assert got[seen, 1] == pytest.approx(b[seen]) and got[:, 0] == pytest.approx(a)
    assert len(got) == len(a) and (got[~seen, 1] > 300).all()


def test_forests_over_all_rows_by_version_and_category(spark, monkeypatch):
    """Versions are filled apart, categories get one of their codes, and other columns stay as they are."""
    from anchorline.operators.impute import forest

    monkeypatch.setattr(forest, "DRIVER_ROWS", 100)
    rng = np.random.default_rng(3)
    kind = rng.integers(0, 3, 400).astype(float)
    x = np.column_stack([kind, kind * 2 + 0.1 * rng.normal(size=400), rng.normal(size=400)])
    x[:80, 0], x[300:320, 1] = np.nan, np.nan
    rows = pd.DataFrame(x, columns=list("abc")).assign(id=range(400), t=np.where(np.arange(400) % 2, "odd", None))
    df = spark.createDataFrame(rows).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in "ab"})
    for node_rows in (None, 64):
        out = impute.impute_forest(df, ["a", "b", "c"], ["a"], max_rounds=2, trees=9, by="t", node_rows=node_rows)
        got = out.toPandas().sort_values("id")
        assert out.columns == df.columns and got["t"].isna().sum() == 200 and not got[["a", "b", "c"]].isna().any().any()
        assert (got["a"].to_numpy() == kind).mean() > 0.97 and abs(got["b"] - kind * 2).max() < 1


def test_forest_of_categories(spark):
    rng = np.random.default_rng(3)
    kind = rng.integers(0, 3, 200).astype(float)
    x = np.column_stack([kind, kind * 2 + 0.1 * rng.normal(size=200), rng.normal(size=200)])
    x[:40, 0] = np.nan
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(id=range(200))).withColumn("a", F.when(~F.isnan("a"), F.col("a")))
    out = impute.impute_forest(df, ["a", "b", "c"], ["a"], max_rounds=2, trees=9).toPandas().sort_values("id")
    assert (out["a"].to_numpy() == kind).mean() > 0.97


def test_published_order_of_the_methods(spark):
    """On correlated columns all methods run over all versions; forests and regressions beat the mean."""
    x = correlated(300, 6, 2, 0.05, 11, 0.1)
    df = wide_frame(spark, x)
    names = [f"c{j}" for j in range(6)]
    methods = {k: m for k, m in preparation.imputers(max_rounds=2, trees=10).items() if k != "knn"}
    methods["knn"] = lambda d, c, by: impute.impute_knn(d, "id", c, by=by)
    rows = impute.impute_compare(df, "id", names, methods, [0.1, 0.3]).collect()
    r2 = {(r.method, r.fraction): r.r2 for r in rows}
    assert len(r2) == 12 and all(r2["forest", f] > r2["mean", f] + 0.2 and r2["chained", f] > r2["mean", f] for f in (0.1, 0.3))


def test_rows_with_patterns_of_their_own_are_solved_together(monkeypatch):
    rng = np.random.default_rng(8)
    z = rng.normal(size=(2000, 10))
    z[rng.random(z.shape) < 0.4] = np.nan
    z[-30:] = np.where(np.arange(10) < 3, np.nan, z[-30:])
    z[-30:, 3:] = 1.0
    z = z[np.lexsort(np.isnan(z).T)]
    mean, cov = rng.normal(size=10), np.cov(rng.normal(size=(40, 10)).T)
    want, extra = z.copy(), np.zeros((10, 10))
    for row in want:
        lacks = np.isnan(row)
        across = np.linalg.solve(cov[np.ix_(~lacks, ~lacks)], cov[np.ix_(~lacks, lacks)])
        extra[np.ix_(lacks, lacks)] += cov[np.ix_(lacks, lacks)] - cov[np.ix_(lacks, ~lacks)] @ across
        row[lacks] = mean[lacks] + (row - mean)[~lacks] @ across
    solved, inverse = [], np.linalg.inv
    precision = inverse(cov)
    monkeypatch.setattr(np.linalg, "inv", lambda a: solved.append(a.shape) or inverse(a))
    got, spread = em.expected(z, mean, precision)
    assert got == pytest.approx(want) and spread == pytest.approx(extra)
    assert len(solved) < 40


@pytest.mark.parametrize("scale,outlier", [(1.0, 1.0), (1e-25, 1e9), (1e30, 1e25), (1.0, 1e40)])
def test_pairs_looked_at_in_singles_lose_no_neighbour(scale, outlier):
    x = matrix(n=400, copies=20) * scale + 5 * scale
    x[7] *= outlier
    near = knn.Nearest(x, np.where(np.isnan(x), np.inf, np.nan), 5)
    for a in range(0, 400, 130):
        near.meet(np.arange(400), x[a : a + 130], np.arange(400)[a : a + 130])
    out = np.array(x)
    found = near.found(np.arange(400)).groupby(["id", "position"])["donor_value"].mean()
    for (i, j), value in found.items():
        out[i, j] = value
    assert out / scale == pytest.approx(brute_knn(x, 5) / scale)


def test_few_donors_are_measured_where_all_units_are_met():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 6))
    x[rng.random(x.shape) < 0.2] = np.nan
    near = knn.Nearest(x[:200], np.where(np.isnan(x[:200]), np.inf, np.nan), 5)
    measured, measure = [], near._measure
    near._measure = lambda r, *rest: (measured.append(len(r)), measure(r, *rest))
    near.meet(np.arange(200), x, np.arange(4000))
    assert sum(measured) < 200 * 4000 * 0.025


def test_the_scores_of_a_method_are_made_in_its_own_thread(spark):
    met = spark.sparkContext.accumulator(0)

    def counted(df, columns, by):
        def go(batches):
            for batch in batches:
                met.add(batch.num_rows)
                yield batch

        return impute.impute_mean(df, columns, by).mapInArrow(go, df.schema)

    scores = impute.impute_compare(frame(spark, matrix(copies=0)), "id", COLUMNS, {"counted": counted}, [0.2])
    assert met.value == 120 and len(scores.collect()) == 1 and met.value == 120
