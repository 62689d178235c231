"""Queries against their SQL in DuckDB. ``ANCHORLINE_ALL=1`` checks every query that has SQL."""

import glob
import math
import os

import duckdb
import pytest

from anchorline.catalogue import QUERIES, SQL
from anchorline.catalogue.base import anchored, labelled, long

SF = "/root/testdata/sf0.001"
KEY_QUERIES = [
    "scan_csv", "join_stay_containment", "join_window", "join_matrix", "feature_stats_all", "sequence_number",
    "reject_outliers_vitals", "sample_class_ratio", "stratified_folds", "metric_mcc_f1", "scores_wide", "sweep_windows",
]
CHECKED = sorted(SQL) if os.environ.get("ANCHORLINE_ALL") else KEY_QUERIES


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        return str(v)
    return f"{float(v):.6g}"


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    result = con.execute(SQL[name])
    names = [d[0] for d in result.description]
    expected = sorted(tuple(cell(dict(zip(names, r))[c]) for c in sorted(names)) for r in result.fetchall())
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    got = sorted(tuple(cell(r[c]) for c in sorted(names)) for r in df.collect())
    assert got == expected


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 110


def test_published_fixture_counts(spark):
    sf = "/root/testdata/sf0.01"
    who, rows = anchored(spark, sf), long(spark, sf)
    assert who.count() == 1340 and who.where("intime IS NOT NULL").count() == 749
    assert rows.count() == 8416 and rows.select("measurement_id").distinct().count() == 4674
    matrix = labelled(spark, sf)
    assert matrix.count() == 1212 and matrix.where("target").count() == 51
