"""Leaks, mixtures, token files, shards and neighbours: brute force, round trips and edges."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from anchorline.llm import decontaminate, mixing, neighbours, shards, token_files
from anchorline.llm.frames import table
from .conftest import SF, made_text

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def coverage(doc, item, match):
    """Greedy string tiling, plainly."""
    free_d, free_i, covered = [True] * len(doc), [True] * len(item), 0
    while True:
        best = (match - 1, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and free_i[i + n] and free_d[d + n]:
                    n += 1
                if n > best[0]:
                    best = (n, d, i)
        n, d, i = best
        if n < match:
            return covered
        free_d[d : d + n] = free_i[i : i + n] = [False] * n
        covered += n


def test_leaks(spark, edge_docs, no_docs, monkeypatch):
    rng = random.Random(9)
    items = [(i, made_text(rng, rng.randint(12, 40))) for i in range(12)] + [(50, None), (51, ""), (52, "too short"), (None, made_text(rng, 20))]
    rows = []
    for n in range(40):
        w = items[n % 12][1].split()
        half, third = len(w) // 2, len(w) // 3
        inside = [w, w[half:] + w[:half], w[: third + 2], [*w[:half], "stop", *w[half:]], w[third:], []][n % 6]
        rows.append((n, f"{made_text(rng, 15)}. {' '.join(inside).upper()}! {made_text(rng, 10)}"))
    rows += [(None, items[0][1]), (7, items[1][1]), (7, items[1][1]), (60, None), (61, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = []
    for d, text in rows:
        for i, item in items:
            size = len(words(item))
            if size >= 5 and (got := coverage(words(text), words(item), 5)) >= 0.6 * size:
                expected.append((d, i, got, size))
    for block in (8 << 20, 600):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        found = decontaminate.find_leaks(docs, bench)
        assert sorted(map(tuple, found.select("doc_id", "item_id", "covered", "item_words").collect()), key=repr) == sorted(expected, key=repr)
        left = decontaminate.drop_leaks(docs.withColumn("item_id", F.lit(1)), bench)
        leaked = {(d, t) for d, t in rows for e in expected if e[0] == d}
        assert sorted((r[0] for r in left.collect()), key=repr) == sorted((d for d, t in rows if (d, t) not in leaked), key=repr)
    assert decontaminate.find_leaks(docs, bench.limit(0)).collect() == [] and decontaminate.find_leaks(no_docs, bench).collect() == []
    assert decontaminate.drop_leaks(edge_docs, bench).columns == edge_docs.columns


def test_leaks_of_the_benchmark(spark):
    found = decontaminate.find_leaks(table(spark, SF, "documents"), table(spark, SF, "benchmark")).collect()
    assert len(found) == 26 and all(r["coverage"] == 1 for r in found)


def labelled_docs(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(300):
        kind = ("clean", "clean", "low", "toxic")[i % 4]
        extra = {"clean": "", "low": " ###%%% $$$ &&&" * 8, "toxic": " nasty vile nasty"}[kind]
        rows.append((i, made_text(rng, 30) + extra))
        labels.append((i, kind if i % 3 else None))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, domain string")


def test_mixture_meets_targets(spark):
    docs, labels = labelled_docs(spark)
    for keep in ({"clean": 1.0, "low": 0.5, "toxic": 0.1}, {"clean": 1.5, "low": 0.4, "toxic": 1.0}):
        mixed = mixing.soft_mixture(docs, labels, keep).collect()
        p, n, rate = (np.array([r[c] for r in mixed], float) for c in ("posteriors", "n_tokens", "rate"))
        assert len(mixed) == 300 and (rate >= 0).all() and np.allclose(p.sum(axis=1), 1)
        before, after = (n[:, None] * p).sum(axis=0), (n[:, None] * p * rate[:, None]).sum(axis=0)
        assert np.allclose(after, before * list(keep.values()), atol=2e-3 * before.sum())
        truth = {i: ("clean", "clean", "low", "toxic")[i % 4] for i in range(300)}
        assert np.mean([truth[r["doc_id"]] == r["domain"] for r in mixed]) > 0.95


def test_mixture_draws_rows(spark, edge_docs, no_docs):
    docs, labels = labelled_docs(spark)
    fitted, _ = mixing.fit_mixture(docs, labels, {"clean": 1.0, "low": 0.5, "toxic": 0.1}, as_kept=True)
    left = {r[0] for r in fitted.drawn(docs).collect()}
    share = {k: np.mean([i in left for i in range(300) if ("clean", "clean", "low", "toxic")[i % 4] == k]) for k in ("clean", "low", "toxic")}
    assert share["clean"] > 0.93 and 0.3 < share["low"] < 0.7 and share["toxic"] < 0.3
    assert fitted.drawn(edge_docs).columns == edge_docs.columns
    rated = mixing.soft_mixture(edge_docs, labels.withColumn("doc_id", F.col("doc_id") % 27), {"clean": 1.0, "low": 0.5, "toxic": 0.1})
    assert rated.count() == edge_docs.count() and rated.where("rate IS NULL OR rate < 0").count() == 0
    for empty in (mixing.soft_mixture(no_docs, labels, {"clean": 1.0, "low": 1.0}), mixing.soft_mixture(no_docs, labels.limit(0), {"clean": 1.0, "low": 1.0})):
        assert empty.collect() == []
    unlabelled = mixing.soft_mixture(docs, labels.limit(0), {"clean": 1.0, "low": 0.5}).collect()
    assert all(np.allclose(r["posteriors"], [0.5, 0.5]) for r in unlabelled)


def expected_tokens(rows):
    tokenizer, start = Tokenizer.from_file(TOKENIZER), 0
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        yield i, start, len(ids), zlib.crc32(ids.tobytes())
        start += len(ids)


def test_token_files(spark, edge_docs, edge_rows, no_docs, monkeypatch, tmp_path):
    # copies of a null id stand in the order of their texts' hashes, so they are compared apart from their place
    plain = [r for r in edge_rows if r[0] is not None]
    expected = list(expected_tokens(plain))
    for size in (32 << 20, 40_000):
        files = token_files.write_token_files(edge_docs.where("doc_id IS NOT NULL"), str(tmp_path / str(size)), TOKENIZER, file_bytes=size)
        got = token_files.read_token_files(spark, files).orderBy("part", "place").select("doc_id", "start", "n_tokens", "ids_crc32")
        assert list(map(tuple, got.collect())) == expected and (len(files) > 1) == (size < 1 << 20)
    monkeypatch.setattr(token_files, "FRAME_BYTES", 64)
    whole = token_files.token_files(edge_docs, TOKENIZER).collect()
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in whole) == sorted((r[2], r[3]) for r in expected_tokens(edge_rows))
    assert [r["doc_id"] for r in sorted(whole, key=lambda r: r["start"])][-2:] == [None, None]
    assert token_files.token_files(no_docs, TOKENIZER).collect() == []


def test_reader_fetches_single_documents(spark, edge_docs, tmp_path):
    files = token_files.write_token_files(edge_docs.where("doc_id IS NOT NULL"), str(tmp_path / "t"), TOKENIZER)
    reader = token_files.open_reader(files[0][1])
    tokenizer = Tokenizer.from_file(TOKENIZER)
    text = {r["doc_id"]: r["text"] for r in edge_docs.collect()}
    for i in (len(reader) - 1, 0, 3):
        assert tokenizer.decode(reader.tokens(i)[:-1].tolist()) == (text[int(reader.ids[i])] or "")
    raw = bytearray(open(files[0][1].removeprefix("file://"), "rb").read())
    raw[int(reader.begin[2]) + int(reader.table[2, 0]) - 3] ^= 1
    with pytest.raises(Exception):  # noqa: B017  (the frame or its checksum)
        token_files.TokenFileReader(pa.BufferReader(bytes(raw))).tokens(2)


def test_units_change_no_ids():
    rng = random.Random(1)
    parts = ["a", "b", "Z", "ß", "é", "ÿ", "ǆ", "×", "÷", "ª", "ı", " ", "  ", "\n", "\t", "'", "'s", "'ll", ".", ",", "!", "|", "<|endoftext|>", "<|", "|>", "1", "23", "文", "😀", "_", "\r", "\x1f", " ", "　", "endoftext", " '"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    encoder = token_files.Encoder(TOKENIZER)
    ids, bounds = encoder.encode(pa.array(texts))
    expected = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == expected


def test_shards(spark, edge_docs, no_docs, monkeypatch):
    rng = random.Random(8)
    rows = [(i if rng.random() < 0.7 else 5, rng.choice([None, 8, 40, 3000]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, size long, row long")
    for cell in (1_000_000, 20):
        monkeypatch.setattr(shards, "ROWS_PER_CELL", cell)
        got = shards.histogram_sort(df, "size", ["doc_id", "row"], shards=7).toPandas()
        sums = got.groupby("shard")["size"].sum()
        assert len(got) == 3000 and len(sums) == 7 and sums.max() - sums.min() <= 2 * 3000
        assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"])
    # rows that cannot be told apart stay together; columns keep their values
    same = shards.histogram_sort(edge_docs, "slot", ["text"], shards=3)
    assert sorted(same.columns) == sorted(edge_docs.columns) and same.count() == edge_docs.count()
    assert shards.histogram_sort(no_docs, "n_chars", ["doc_id"]).collect() == []
    one = spark.createDataFrame([(1, 8)], "doc_id long, size long")
    assert [r["slot"] for r in shards.histogram_sort(one, "size", ["doc_id"]).collect()] == [0]


def test_hilbert_curve_visits_neighbours():
    for axes, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.array(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij")).reshape(axes, -1).T
        keys = neighbours.hilbert_keys(grid, bits)
        assert sorted(keys) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def brute_neighbours(ids, vectors, asked, k):
    u = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for q in np.flatnonzero(asked):
        score = u @ u[q]
        score[q] = -9
        yield ids[q], ids[np.lexsort((ids, -score))[:k]].tolist()


def test_neighbours_recall(spark):
    rows = table(spark, SF, "embeddings")
    got = neighbours.nearest(rows, F.col("vec_id") % 50 == 0).collect()
    pdf = rows.select("vec_id", "embedding").toPandas()
    vectors, ids = np.stack(pdf.embedding).astype(float), pdf.vec_id.to_numpy()
    true = dict(brute_neighbours(ids, vectors, ids % 50 == 0, 5))
    found = {q: {r["vec_id"] for r in got if r["query_id"] == q} for q in true}
    assert np.mean([len(found[q] & set(true[q])) / 5 for q in true]) >= 0.9
    place = {i: v for i, v in zip(ids, vectors)}
    for r in got:
        a, b = place[r["query_id"]], place[r["vec_id"]]
        assert abs(r["score"] - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12


def test_neighbours_edges(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(30)]
    rows += [(40 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(9)]
    bad = [(100, None), (101, [0.0] * 4), (102, [1.0, None, 0.0, 0.0]), (103, [float("nan")] * 4), (104, [float("inf"), 0.0, 0.0, 0.0]), (105, [1.0]), (None, [1.0] * 4), (3, rows[3][1])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1)).withColumn("curve", F.lit(2))
    ids, vectors = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    for block, at_once in ((4096, 4096), (8, 2)):
        monkeypatch.setattr(neighbours, "BLOCK", block)
        monkeypatch.setattr(neighbours, "QUERIES_AT_ONCE", at_once)
        got = neighbours.nearest(df, F.col("vec_id") % 10 == 0, target=1.0).collect()
        assert {r["vec_id"] for r in got} <= set(ids) and [r["rank"] for r in got if r["query_id"] == 0] == sorted(r["rank"] for r in got if r["query_id"] == 0)
        for q, expected in brute_neighbours(ids, vectors, ids % 10 == 0, 5):
            assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == expected
    # lengths whose squares overflow or vanish change no cosine
    sized = [(i, (np.array(v) * [1.0, 1e200, 1e-200][i % 3]).tolist()) for i, v in rows[:30]]
    far = spark.createDataFrame(sized, "vec_id long, embedding array<double>")
    got = neighbours.nearest(far, F.col("vec_id") % 10 == 0, target=1.0).collect()
    for q, expected in brute_neighbours(ids[:30], vectors[:30], ids[:30] % 10 == 0, 5):
        found = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["vec_id"] for r in found] == expected and all(0 < abs(r["score"]) <= 1 + 1e-12 for r in found)
    few = neighbours.nearest(df.where("vec_id < 3"), F.col("vec_id") == 0).collect()
    assert len(few) == 2
    assert neighbours.nearest(df.limit(0), F.col("vec_id") == 0).collect() == []
    assert neighbours.nearest(df, F.lit(False)).collect() == []
