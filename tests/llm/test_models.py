"""Language and toxicity: held-out accuracy on the supplied tables, offsets, and edges."""

import numpy as np
from pyspark.sql import functions as F
from .conftest import SF

from anchorline.llm import language, toxicity
from anchorline.llm.frames import crc_held_out, table


def test_language_held_out(spark):
    docs = table(spark, SF, "documents")
    model = language.fit_language(docs.where(~crc_held_out()))
    found = language.predict_language(docs, model).join(docs.select("doc_id", "lang", crc_held_out().alias("out")), "doc_id")
    out = found.where("out").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert out[0] > 0.97 and 0 <= out[1] and out[2] <= 1
    assert language.keep_known(docs, model).count() == 1000


def test_unlearned_languages_and_noise_go(spark):
    docs, rng = table(spark, SF, "documents"), np.random.default_rng(4)
    drawn = lambda units, n, gap="": gap.join(rng.choice(list(units), n))
    polish = "w każdym razie nie mogę powiedzieć że jest to zupełnie nowa książka ponieważ została już wydana".split()
    finnish = "mutta kun hän tuli kotiin niin kaikki olivat jo lähteneet eikä kukaan tiennyt minne he menivät".split()
    russian = "сегодня утром мы пошли на рынок чтобы купить свежие овощи и хлеб для нашей семьи".split()
    planted = [drawn(words, 200, " ") for words in (polish, finnish, russian)]
    planted += [drawn("今天天气很好我们去公园散步然后吃饭回家看书", 500), drawn("abcdefghijklmnopqrstuvwxyz", 2000)]
    planted += [drawn("0123456789 ", 3000) + "a", drawn("#$%&*+=<>@^~|", 3000) + " z", "12 34"]
    learned = ["A.", "Von.", docs.where("doc_id = 2").first()["text"]]
    rows = spark.createDataFrame([(t,) for pair in zip(planted, learned * 3) for t in pair] + [(None,), ("",)], "text string")
    model = language.fit_language(docs.where(~crc_held_out()))
    kept = [r["text"] for r in language.keep_known(rows.coalesce(1), model).collect()]
    assert sorted(kept) == sorted((learned * 3)[: len(planted)])
    held_out = docs.where(crc_held_out())
    assert language.keep_known(held_out, model).count() == held_out.count()


def test_language_edges(spark, edge_docs, no_docs):
    rows = [(1, "der die das und ist " * 30, "de"), (2, "the and of is that " * 30, "en"), (3, None, "en"), (4, "x", None), (5, "", "de")]
    model = language.fit_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en"]
    got = language.predict_language(edge_docs, model).collect()
    assert len(got) == edge_docs.count()
    texts = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    silent = sorted([i for i, t in texts if not any(c.isalpha() for c in t or "")], key=repr)
    assert sorted([r["doc_id"] for r in got if r["lang_pred"] == "und"], key=repr) == silent
    assert all(r["score"] == 0 for r in got if r["lang_pred"] == "und")
    assert language.keep_known(edge_docs, model).columns == edge_docs.columns
    assert {r["lang_pred"] for r in language.predict_language(edge_docs, None).collect()} == {"und"}
    assert language.fit_language(no_docs) is None
    assert language.predict_language(no_docs, model).collect() == [] and language.keep_known(no_docs, model).collect() == []


def test_network_learns_and_covers_whole_texts():
    first = language.window_starts(np.array([0, 10, 256, 600]))
    assert [x.tolist() for x in first] == [[1, 2, 3, 3, 3], [0, 0, 0, 256, 344]]
    rng = np.random.default_rng(0)
    windows = rng.integers(97, 123, (400, language.WINDOW)).astype(np.uint8)
    labels = rng.integers(0, 2, 400)
    windows[labels == 1, 100:104] = np.frombuffer(b"QXQZ", np.uint8)
    net = language.train(windows, labels, ["a", "b"], epochs=80)
    p = net.probabilities(windows, net.pair_tables())
    assert (p.argmax(axis=1) == labels).mean() > 0.95 and np.allclose(p.sum(axis=1), 1, atol=1e-5)


def test_toxicity_held_out(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    field = toxicity.fit_toxicity(docs, labels)
    found = toxicity.tag_documents(docs, field).join(labels, "doc_id").toPandas()
    assert found[found.toxic == 1].predicted.mean() > 0.6 and found[found.toxic == 0].predicted.mean() < 0.03
    text = {r[0]: r[1] for r in docs.select("doc_id", "text").collect()}
    words = [text[r.doc_id].encode()[s["start"] : s["end"]].decode() for r in found.itertuples() for s in r.spans]
    assert words and all(w.isalnum() for w in words)


def test_toxicity_edges(spark, edge_docs, no_docs):
    rows = [(i, f"good words here {'awful' if i % 3 == 0 else 'nice'} number{i} and so on " * 3) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(None, 1), (3, None), (99, 1), (3, 0)], "doc_id long, toxic int")
    field = toxicity.fit_toxicity(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.tag_documents(docs, field).collect()}
    assert all(got[i]["predicted"] == int(i % 3 == 0) for i in range(60))
    start = rows[0][1].index("awful")
    assert (got[0]["spans"][0]["start"], got[0]["spans"][0]["end"]) == (start, start + 5)
    edges = toxicity.tag_documents(edge_docs, field).collect()
    assert len(edges) == edge_docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in edges)
    assert toxicity.fit_toxicity(docs, labels.where("toxic = 1")) is None and toxicity.fit_toxicity(no_docs, labels) is None
    assert {r["score"] for r in toxicity.tag_documents(docs, None).collect()} == {0.0}
    assert toxicity.tag_documents(no_docs, field).collect() == []


def test_toxicity_scores_do_not_follow_the_sample(spark):
    """A tenth is toxic, and most toxic texts show it in no word: texts without such a word are clean, in any sample."""
    rows = [(i, int(i % 10 == 0), f"some words number{i} {'awful' if i % 50 == 0 else 'plain'} and so on") for i in range(2000)]
    frame = spark.createDataFrame(rows, "doc_id long, toxic int, text string")
    train, held_out = frame.where("doc_id < 1500"), frame.where("doc_id >= 1500")
    means = []
    for texts_each in (100, 2000):  # below and above the 150 and 1,350 labelled texts
        field = toxicity.fit_toxicity(train.select("doc_id", "text"), train.select("doc_id", "toxic"), texts_each=texts_each)
        found = toxicity.tag_documents(held_out, field).join(held_out.select("doc_id", "toxic"), "doc_id").toPandas()
        assert found[found.toxic == 0].predicted.mean() < 0.03
        assert found[found.doc_id % 50 == 0].predicted.all()
        means.append(found[found.toxic == 0].score.mean())
    assert abs(means[0] - means[1]) < 0.05


def test_of_equal_texts_with_different_labels_the_larger_one_stands(spark):
    rows = [(i, int(i % 5 == 0), f"plain words {i} " + ("foul vile" if i % 5 == 0 else "fine")) for i in range(60)]
    copies = [(100 + i, i % 2, "the same text twice") for i in range(6)]

    def fit(some):
        frame = spark.createDataFrame(some, "doc_id long, toxic int, text string").repartition(3)
        return toxicity.fit_toxicity(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"))

    one, other = fit(rows + copies), fit((rows + copies)[::-1])
    alone = fit(rows + [(100, 1, "the same text twice")])
    assert one.curve.tolist() == other.curve.tolist()
    assert one.curve[1:].tolist() == alone.curve[1:].tolist()


def test_marginals_by_enumeration():
    rng = np.random.default_rng(3)
    field = toxicity.Field(np.zeros(toxicity.SLOTS + 1), 0.0, rng.normal(size=(2, 2)), np.zeros(3))
    emission, real = rng.normal(size=(2, 6)), np.array([[True] * 6, [True] * 4 + [False] * 2])
    got, _, _ = field.marginals(emission, real)
    for row, n in ((0, 6), (1, 4)):
        total, marked = 0.0, np.zeros(n)
        for path in np.ndindex(*[2] * n):
            weight = np.exp(sum(emission[row, t] for t in range(n) if path[t]) + sum(field.transition[a, b] for a, b in zip(path, path[1:])))
            total += weight
            marked += weight * np.array(path)
        assert np.allclose(got[row, :n], marked / total)
    assert (got[1, 4:] == 0).all()


def test_lower_case_and_words():
    from anchorline.llm.kernels import lower_bytes, word_bounds

    text = "ÀÉÞ×ß Straße_ABC-x9…é"
    data = np.frombuffer(text.encode(), np.uint8)
    assert lower_bytes(data).tobytes().decode() == "àéþ×ß straße_abc-x9…é"
    starts, ends, upto = word_bounds(np.frombuffer(b"ab cdef", np.uint8), np.array([0, 1, 1, 5, 7]))
    assert list(zip(starts, ends)) == [(0, 1), (1, 2), (3, 5), (5, 7)] and upto.tolist() == [0, 1, 1, 3, 4]
