"""Repeated passages of words and bytes against brute force."""

import hashlib
import re

import numpy as np
import pytest

from anchorline.llm import passages, rlz_dedup, suffix_dedup
from anchorline.llm.suffixes import common_prefixes, suffix_array

LAST = float("inf")


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def removed(rows, tokens, span):
    """Flags per row: the definition, window by window."""
    cut = [(LAST if i is None else i, tokens(t)) for i, t in rows]
    least = {}
    for i, w in cut:
        for j in range(len(w) - span + 1):
            key = tuple(w[j : j + span])
            least[key] = min(least.get(key, LAST), i)
    for i, w in cut:
        gone = np.zeros(len(w), bool)
        for j in range(len(w) - span + 1):
            if least[tuple(w[j : j + span])] < i:
                gone[j : j + span] = True
        yield w, gone


def by_words(rows, span):
    for (i, _), (w, gone) in zip(rows, removed(rows, words, span), strict=True):
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        yield i, len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest()


def by_bytes(rows, span):
    for (i, _), (w, gone) in zip(rows, removed(rows, lambda t: (t or "").encode(), span), strict=True):
        kept = bytes(x for x, g in zip(w, gone, strict=True) if not g)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        yield i, len(w), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.fixture(params=[(2 << 20, 64), (20_000, 2)], ids=["few", "many batches, hot anchors"])
def sizes(request, monkeypatch):
    batch, hot = request.param
    monkeypatch.setattr(passages, "BATCH_BYTES", batch)
    monkeypatch.setattr(passages, "BUCKET_BYTES", 2 * batch)
    monkeypatch.setattr(passages, "SHARD_BYTES", batch)
    monkeypatch.setattr(passages, "HOT_BATCHES", hot)


def test_words(edge_docs, edge_rows, sizes):
    got = rlz_dedup.remove_repeated_words(edge_docs)
    assert ordered(got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == ordered(by_words(edge_rows, 50))
    for r in got.collect():
        assert hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"]


def test_bytes(edge_docs, edge_rows, sizes):
    got = suffix_dedup.remove_repeated_bytes(edge_docs)
    assert ordered(got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()) == ordered(by_bytes(edge_rows, 50))


def test_other_spans(spark, edge_rows):
    few = [r for r in edge_rows if len(r[1] or "") < 3000]
    docs = spark.createDataFrame(few, "doc_id long, text string")
    got = rlz_dedup.remove_repeated_words(docs, span=7)
    assert ordered(got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == ordered(by_words(few, 7))
    got = suffix_dedup.remove_repeated_bytes(docs, span=12)
    assert ordered(got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()) == ordered(by_bytes(few, 12))


def test_factors_copy_their_source(spark, edge_rows):
    known = {i: words(t) for i, t in edge_rows if i is not None}
    docs = spark.createDataFrame([r for r in edge_rows if r[0] is not None], "doc_id long, text string")
    factors = rlz_dedup.repeated_factors(docs).collect()
    assert factors
    for f in factors:
        mine = known[f["doc_id"]][f["first_word"] :][: f["n_words"]]
        theirs = known[f["source_doc"]][f["source_word"] :][: f["n_words"]]
        assert f["source_doc"] < f["doc_id"] and f["n_words"] >= 50 and mine == theirs


def test_empty_table(no_docs):
    assert rlz_dedup.remove_repeated_words(no_docs).collect() == []
    assert suffix_dedup.remove_repeated_bytes(no_docs).collect() == []
    assert rlz_dedup.repeated_factors(no_docs).collect() == []


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(0)
    for _ in range(60):
        strings = [rng.integers(97, 97 + rng.integers(1, 4), rng.integers(1, 30)).astype(np.uint8) for _ in range(rng.integers(1, 9))]
        data = np.concatenate([np.append(s, 0) for s in strings]).astype(np.uint8)
        separator = data == 0
        closed = np.cumsum(separator)
        codes = np.where(separator, closed, data.astype(int) + closed[-1] + 1).tolist()
        order = suffix_array(data, separator)
        assert order.tolist() == sorted(range(len(data)), key=lambda i: codes[i:])
        first = np.array([0, *(np.flatnonzero(separator)[:-1] + 1)])
        count = np.array([max(len(s) - 4, 0) for s in strings])
        padded = np.concatenate([data, np.zeros(13, np.uint8)])
        place = np.argsort(order)
        shared = iter(common_prefixes(padded, order, first, count, 5))
        for f, c in zip(first, count, strict=True):
            for i in range(f, f + c):
                before = order[place[i] - 1] if place[i] else None
                size = 0
                while before is not None and size < 5 and padded[i + size] == padded[before + size]:
                    size += 1
                assert next(shared) == size
