"""What the language stage finds is what the mixture is balanced by."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from anchorline.llm import language, mixing, stages

WORDS = {
    "de": "der und nicht auch wird zwischen straße schön größe wenig über durch gegen jedoch weiter immer".split(),
    "en": "the and with which there about would their through should because between other people these where".split(),
}
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def mixed(spark, tmp_path_factory):
    """900 English and 300 German documents, half of the latter without a label, and their folder with ``labels``."""
    rng, rows = random.Random(3), []
    for i in range(1200):
        known = "de" if i % 4 == 0 else "en"
        text = " ".join(rng.choice(WORDS[known]) for _ in range(160)) + f" {i}"
        rows.append((i, text, None if i % 8 == 0 else known, "web", len(text)))
    folder = str(tmp_path_factory.mktemp("mixed"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 1200, 3)] + [(1, 0, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{folder}/labels.parquet")
    return spark.createDataFrame(rows, COLUMNS).repartition(3), folder


def test_language_stage_tells_the_language(spark, mixed):
    docs, folder = mixed
    out = stages.language_id(spark, docs, folder)
    assert out.schema == docs.schema
    found = {r["doc_id"]: r["lang"] for r in out.collect()}
    assert found == {i: "de" if i % 4 == 0 else "en" for i in range(1200)}


def test_given_languages_stay_unless_the_score_is_sure(spark, mixed):
    docs, _ = mixed
    model = language.fit_language(docs)
    wrong = docs.where("doc_id < 40").withColumn("lang", F.lit("xx"))
    kept = {r["doc_id"]: r["lang"] for r in language.keep_known(wrong, model, lang="lang").collect()}
    scores = {r["doc_id"]: r for r in language.predict_language(wrong, model).collect()}
    assert kept == {i: r["lang_pred"] if r["score"] >= language.SURE else "xx" for i, r in scores.items()}
    model.offset = model.offset * 0
    model.weights = model.weights * 0
    assert {r["lang"] for r in language.keep_known(wrong, model, lang="lang").collect()} == {"xx"}


def test_mixture_balances_what_the_stage_found(spark, mixed):
    docs, folder = mixed
    count = lambda df: Counter("de" if r["doc_id"] % 4 == 0 else "en" for r in stages.mixture(spark, df, folder).collect())
    with_stage, without = count(stages.language_id(spark, docs, folder)), count(docs.drop("lang").selectExpr("doc_id", "text", "'en' AS lang", "source", "n_chars"))
    share = lambda c: c["de"] / sum(c.values())
    assert share(with_stage) > share(without) + 0.03


def test_balance_keeps_the_total():
    factors = mixing.balance({"en": 900.0, "de": 100.0, None: 0.0}, 0.5)
    assert factors == pytest.approx({"en": 0.75 / 0.9, "de": 0.25 / 0.1})
    assert mixing.balance({"en": 5.0, "de": 7.0}, 1.0) == pytest.approx({"en": 1.0, "de": 1.0})
    assert mixing.balance({}, 0.5) == mixing.balance({None: 0.0}, 0.5) == {}
