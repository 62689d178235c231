"""The Merkle manifest against a plain tree, in one block and in many."""

import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from anchorline.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(text):
    return sha256(text.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """Levels from the leaves to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest("".join(last[i : i + 2])) for i in range(0, len(last), 2)])
    return levels


def siblings(levels, at):
    out = []
    for level in levels[:-1]:
        out.append(level[at ^ 1] if at ^ 1 < len(level) else "")
        at >>= 1
    return out


def expected(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0], leaf(row)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([h for _, h in sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]) for g in order}
    top = tree([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for at, h in enumerate(trees[g][0]):
            out.append((h, trees[g][-1][0], top[-1][0], digest("".join(siblings(trees[g], at) + siblings(top, k)))))
    return sorted(out)


def made(n, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", None]), rng.choice(["en", "en", "en", "de", "é", "", None]), rng.choice([None, i]), rng.choice(["x" * i, "", None])) for i in range(n)]
    return rows + [(None, "s", "en", 3, "t"), (None, "s", "en", 3, "t"), (5, "s", "en", 3, "u"), (5, "s", "en", 3, "u"), (-9, None, "solo", 1, "é")]


@pytest.mark.parametrize("n,bits", [(60, 10), (150, 2), (97, 1), (1, 3)])
def test_roots_and_proofs(spark, n, bits, monkeypatch):
    rows = made(n, n)
    monkeypatch.setattr(merkle, "ROWS_PER_PART", 20)
    monkeypatch.setattr(merkle.build_manifest, "__defaults__", (bits,))
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("g", F.lit(1)).withColumn("digest", F.lit(2)).withColumn("pos", F.lit(3)).repartition(3)
    proofs = merkle.document_manifest(docs).proofs()
    found = proofs.select("digest", "subroot", "root", merkle.proof_digest().alias("p"), merkle.folded_root(F.col("digest")).alias("f")).collect()
    assert sorted(tuple(r)[:4] for r in found) == expected(rows)
    assert all(r["f"] == r["root"] for r in found)


def test_a_changed_row_no_longer_leads_to_the_root(spark):
    rows = made(80, 4)
    docs = spark.createDataFrame(rows, SCHEMA)
    changed = F.when(F.col("doc_id") % 5 == 0, merkle.leaf_digest(["doc_id", "source", "lang", "n_chars", merkle.encoded(F.concat(F.coalesce("text", F.lit("")), F.lit(" ")))]))
    proofs = merkle.document_manifest(docs, changed).proofs()
    found = proofs.select("doc_id", (merkle.folded_root(F.coalesce("changed", "digest")) == F.col("root")).alias("ok")).collect()
    assert all(r["ok"] == (r["doc_id"] is None or r["doc_id"] % 5 != 0) for r in found)


def test_empty_table(spark, no_docs):
    manifest = merkle.document_manifest(no_docs)
    assert manifest.root() is None and manifest.proofs().count() == 0
