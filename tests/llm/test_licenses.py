"""Licence scans: phrases and notices against brute force, altered copies, and edges."""

import random
import re

import pyarrow as pa
import pytest

from anchorline.llm import licenses
from anchorline.llm.frames import table
from .conftest import SF, made_text

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def places(text):
    w = words(text)
    return sorted((i, label) for phrase, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())


def found(rows):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], str(r))
    return sorted(((r["doc_id"], r["n_words"], [(s["first"], s["label"]) for s in r["spans"] if s["base"]]) for r in rows), key=key)


def expected(rows):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], str(r))
    return sorted(((i, len(words(t)), places(t)) for i, t in rows), key=key)


def test_phrases_of_the_test_table(spark):
    docs = table(spark, SF, "documents")
    got = licenses.scan_licenses(docs).collect()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found(got) == expected(rows) and any(r["spans"] for r in got)


def test_edges_and_repeated_phrases(spark, edge_docs, edge_rows, no_docs, monkeypatch):
    monkeypatch.setattr(licenses, "PLACES", 50)
    monkeypatch.setattr(licenses, "SLICE_BYTES", 3000)
    more = [(40, "MIT-License! mit  license\nmit\tlicense"), (41, "mit license " * 3000), (42, "the mit licenses, MİT LICENSE, mité license"),
            (43, "GENERAL public license general public license"), (44, "apache"), (44, "apache license"), (44, "apache license"), (None, "Apache License")]
    docs = edge_docs.select("doc_id", "text", "n").unionByName(spark.createDataFrame([(*r, 1) for r in more], "doc_id long, text string, n int"))
    assert found(licenses.scan_licenses(docs).collect()) == expected([*edge_rows, *more])
    assert licenses.scan_licenses(no_docs).count() == 0
    assert all(not r["spans"] for r in licenses.scan_licenses(docs, []).collect())


def test_altered_notices_are_found_where_they_stand(spark):
    rng = random.Random(3)
    wanted = {"mit": licenses.NOTICES[7][0], "isc": licenses.NOTICES[11][0], "cc-by": licenses.NOTICES[3][0], "cc-by-nc": licenses.NOTICES[5][0]}
    rows, truth = [], {}
    for n, label in enumerate(list(wanted) * 3):
        w = words(wanted[label])
        if label in ("mit", "isc"):
            w[9] = "altered"
            del w[17]
            w[25:25] = ["put", "in"]
        before = made_text(rng, rng.randint(0, 60)).split()
        rows.append((n, " ".join([*before, *w, *made_text(rng, 30).split()])))
        truth[n] = (label, len(before), len(before) + len(w))
    half = words(wanted["mit"])
    rows.append((50, " ".join(half[: len(half) // 2])))
    got = {r["doc_id"]: [(s["label"], s["first"], s["end"]) for s in r["spans"]] for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got.pop(50) == [] and got == {n: [t] for n, t in truth.items()}


@pytest.mark.parametrize("seed", range(5))
def test_common_stretch(seed):
    rng = random.Random(seed)
    a, b = ([rng.choice("abcd") for _ in range(n)] for n in (12, 20))

    def longest(x, y):
        rows = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, p in enumerate(x, 1):
            for j, q in enumerate(y, 1):
                rows[i][j] = rows[i - 1][j - 1] + 1 if p == q else max(rows[i - 1][j], rows[i][j - 1])
        return rows[-1][-1]

    length, first, last = licenses.common_stretch(a, b)
    assert length == longest(a, b) == longest(a, b[first : last + 1])
    assert licenses.Words(pa.array(["Ab-c é", None, ""])).before.tolist() == [0, 3, 3, 3]
