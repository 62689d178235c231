"""Near duplicates against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from anchorline.llm import minhash
from anchorline.llm.components import components


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders, shared = defaultdict(list), Counter()
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for who in holders.values():
        shared.update((a, b) for n, a in enumerate(who) for b in who[n + 1 :])
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    for i, t in rows:
        yield (i, len(shingles(t)), None, True) if i is None else (i, len(sets[i]), find(i), find(i) == i)


def test_edges(edge_docs, edge_rows):
    got = minhash.near_duplicates(edge_docs).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute(edge_rows), key=repr)
    left = minhash.drop_near_duplicates(edge_docs)
    assert left.columns == edge_docs.columns
    kept = [r[0] for r in brute(edge_rows) if r[3]]
    assert sorted((r["doc_id"] for r in left.collect()), key=repr) == sorted(kept, key=repr)


def test_chains_of_edits(spark):
    """Groups in which the ends of a chain are no longer alike, and members that are not like the smallest one."""
    rng = random.Random(2)
    rows, number = [], 0
    for _ in range(12):
        text = [str(rng.randint(0, 10**6)) for _ in range(90)]
        for _ in range(rng.randint(1, 9)):
            rows.append((number * 7 % 1009, " ".join(text)))
            number += 1
            text[rng.randrange(90)] = str(rng.randint(0, 10**6))
            if rng.random() < 0.5:
                text[rng.randrange(90)] = str(rng.randint(0, 10**6))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    for n in (3, 40, 700):
        gaps = []
        for _ in range(20):
            pool = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
            a, b = np.unique(pool[: int(1.5 * n)]), np.unique(pool[n // 2 :])
            s = minhash.sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            gaps.append((s[0] == s[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(gaps)) < 0.02 and np.std(gaps) < 0.05


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (5, 5), (200, 90)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 90: 90, 200: 90}


def test_empty_table(no_docs):
    assert minhash.near_duplicates(no_docs).collect() == [] and minhash.drop_near_duplicates(no_docs).collect() == []
