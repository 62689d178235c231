"""The pipeline, stage by stage against plain versions, and as one run."""

import corpus_pipeline
import pytest

from anchorline.llm import queries
from anchorline.llm.frames import table

from .test_minhash import brute
from .test_tables import coverage, expected_tokens, words

SF = "/root/testdata/sf0.001"


def texts(df):
    return sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of every stage, each written and read again."""
    docs, out = table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        out[name] = (docs, spark.read.parquet(path))
        docs = out[name][1]
    return out


def test_all_but_the_last_return_documents(spark, stages):
    columns = table(spark, SF, "documents").columns
    assert list(stages) == ["language_id", "near_dedup", "decontamination", "mixture", "token_files"]
    assert all(out.columns == columns for name, (_, out) in stages.items() if name != "token_files")


def test_language_keeps_what_has_letters(stages):
    before, after = stages["language_id"]
    assert texts(after) == [(i, t) for i, t in texts(before) if any(c.isalpha() for c in t or "")]


def test_one_document_of_each_group_stays(stages):
    before, after = stages["near_dedup"]
    rows = texts(before)
    kept = {r[0] for r in brute(rows) if r[3]}
    assert texts(after) == [r for r in rows if r[0] in kept] and len(kept) < len(rows)


def test_leaks_go(spark, stages):
    before, after = stages["decontamination"]
    items = [words(r["text"]) for r in table(spark, SF, "benchmark").collect()]
    grams = {tuple(w[j : j + 5]) for w in items for j in range(len(w) - 4)}

    def leaks(text):
        w = words(text)
        if not any(tuple(w[j : j + 5]) in grams for j in range(len(w) - 4)):
            return False
        return any(len(i) >= 5 and coverage(w, i, 5) >= 0.6 * len(i) for i in items)

    assert texts(after) == [r for r in texts(before) if not leaks(r[1])]


def test_mixture_only_repeats_or_drops(spark, stages):
    before, after = stages["mixture"]
    rows, left = texts(before), texts(after)
    assert set(left) <= set(rows) and 0 < len(left)
    toxic = {r["doc_id"] for r in table(spark, SF, "labels").where("toxic = 1").collect()}
    share = lambda some: sum(i in toxic for i, _ in some) / len(some)
    assert share(left) <= share(rows)


def test_token_files_hold_what_is_left(stages):
    before, after = stages["token_files"]
    got = sorted(tuple(r) for r in after.select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == sorted(expected_tokens(texts(before)))


def test_run_and_registration(spark):
    import __spark_entry__ as entry

    numbers = {name.split("_")[0] for name in queries.QUERIES}
    assert numbers == {f"op{n}" for n in range(1, 14)} and set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert corpus_pipeline.run(spark, SF).count() > 0
