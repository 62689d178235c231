import datetime
import random

import pytest

SF = "/root/testdata/sf0.01"


def made_text(rng, words):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()) + str(rng.randint(0, 40)) for _ in range(words))


@pytest.fixture(scope="session")
def edge_rows():
    """(doc_id, text): nulls, empty, blank, short and very long texts, copies, repeated rows and a null id."""
    rng = random.Random(5)
    base = [made_text(rng, n) for n in (120, 300, 80, 200, 60)]
    passage = made_text(rng, 70)
    long = made_text(rng, 40_000)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(10, base[1]), (11, base[1]), (12, base[1].replace("alpha", "alphb", 1)), (13, f"{base[2]}\n\n{passage}  é ")]
    rows += [(14, f"{passage} {base[0]}"), (15, None), (16, ""), (17, " \t\n"), (18, "short"), (19, "Short"), (20, "aaaa" * 5000)]
    rows += [(21, long), (22, long[:150_000] + passage), (23, base[3]), (23, base[3]), (24, "éß " * 60), (None, base[3]), (None, "x")]
    rows += [(-5, passage), (25, "one two three four"), (26, "ONE two three four")]
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    """The edge rows with further columns, whose names the operators use inside."""
    extra = "shard int, slot long, rank int, batch int, band long, x double, n int, p string, __row string, __key long, __id long, __letters string, rate double, domain string, when timestamp"
    row = (1, 2, 3, 4, 5, 6.0, 7, "p", "r", 8, 9, "l", 0.5, "d", datetime.datetime(2024, 1, 1))
    return spark.createDataFrame([(*r, *row) for r in edge_rows], f"doc_id long, text string, {extra}").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
