"""Fill-in-the-middle: rotations, forms, round trips and edges."""

import re
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from anchorline.llm import fill_middle
from anchorline.llm.fill_middle import Plan


def plainly(doc_id, text, plan=Plan()):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = sha256(f"{plan.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= plan.share:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < plan.spm_share:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("n,cut", [(0, 0), (1, 0), (1, 1), (7, 3), (200_000, 70_001), (131_072, 65_536), (131_073, 131_073)])
def test_rotation_exchanges_segments(n, cut):
    data = np.random.default_rng(n).integers(0, 256, n + 9, np.uint8).tobytes()
    buffer = bytearray(data)
    fill_middle.rotate(buffer, 4, 4 + cut, 4 + n)
    assert buffer == data[:4] + data[4 + cut : 4 + n] + data[4 : 4 + cut] + data[4 + n :]


@settings(max_examples=300, deadline=None)
@given(st.integers(-(2**63), 2**63 - 1), st.text(st.sampled_from("ab\n\r<>PSMé🙂"), max_size=60))
def test_texts_come_back(doc_id, text):
    plan = Plan()
    n, form, prefix, middle, output = fill_middle.transformed(plan, doc_id, text.encode())
    assert (n, form, prefix, middle, output.decode()) == plainly(doc_id, text)
    assert fill_middle.restored(plan, form, output) == text.encode()


def test_rows(spark, edge_docs, edge_rows, no_docs, monkeypatch):
    monkeypatch.setattr(fill_middle, "OUT_BYTES", 100_000)
    more = [(31, "a <P> b\nc"), (32, "one\ntwo\n\nthree"), (33, "\n"), (34, "x\r\ny" * 50_000)]
    docs = edge_docs.select("doc_id", "text", "n", "p").unionByName(spark.createDataFrame([(*r, 1, "q") for r in more], "doc_id long, text string, n int, p string"))
    for plan in (Plan(), Plan(share=40, spm_share=20, seed=11)):
        got = fill_middle.restore(fill_middle.fill_in_middle(docs, plan), plan).collect()
        key = lambda r: (r[0] is None, r[0] or 0, r[-1])
        expected = [(i, *plainly(i, t, plan), t or "") for i, t in [*edge_rows, *more]]
        assert sorted((tuple(r) for r in got), key=key) == sorted(expected, key=key)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.restore(fill_middle.fill_in_middle(no_docs)).count() == 0
