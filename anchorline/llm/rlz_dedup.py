"""Duplicate passages of words by relative Lempel-Ziv parsing.

The corpus is its own reference, held in blocks: a block indexes the passages of all documents that share its anchors.
Each passage is parsed against the block in which every equal passage must stand: a factor begins at the first window
of ``span`` words that a smaller document holds, copies from the smallest such document as far as both agree, and at
its end the next window is looked up again, so nothing is lost at factor boundaries. Factors of neighbouring passages
that go on in the same source are one factor.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from anchorline.llm.frames import NULL_ID
from anchorline.llm.kernels import RangeHash, WordTokens, mix, ranges
from anchorline.llm.passages import Batch, Pieces, Told, repeated_passages

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CUT_SCHEMA = "doc_id long, n_words long, n_removed long, n_factors long, kept_sha256 string, kept string"
FACTOR_SCHEMA = "doc_id long, first_word long, n_words long, source_doc long, source_word long"


def parse_block(pieces: Pieces, span: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of the pieces, its source: the smallest document of the block that holds it, and the place.

    The index is the sorted list of the fingerprints of all windows. Words have exact numbers in a block; a source is
    accepted if its words equal those of the window.
    """
    words = WordTokens(pieces.text.cast(pa.large_string()))
    cells = pa.Array.from_buffers(
        pa.large_binary(), len(words.starts),
        [None, pa.py_buffer(np.append(words.starts, len(words.data)).astype(np.int64)), pa.py_buffer(words.data)],
    )
    number = cells.dictionary_encode().indices.to_numpy().astype(np.int64)
    first = words.offsets[:-1]
    at = ranges(first, pieces.windows)
    prints = RangeHash(mix(number.astype(np.uint64) + np.uint64(1))).of(at, at + span)
    owner = np.repeat(np.arange(len(first)), pieces.windows)
    doc, place = pieces.doc[owner], pieces.place[owner] + at - first[owner]
    order = np.lexsort((place, doc, prints))
    new = np.ones(len(order), bool)
    new[1:] = prints[order[1:]] != prints[order[:-1]]
    source = np.empty(len(order), np.int64)
    source[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    # compare the first words of every run of windows in full, and one more word per further window
    run = np.ones(len(at), bool)
    run[1:] = (owner[1:] != owner[:-1]) | (at[source[1:]] != at[source[:-1]] + 1)
    length = np.where(run, span, 1)
    offset = np.where(run, 0, span - 1)
    mine, theirs = ranges(at + offset, length), ranges(at[source] + offset, length)
    equal = np.logical_and.reduceat(number[mine] == number[theirs], np.cumsum(length) - length) if len(at) else run
    run_number = np.cumsum(run) - 1
    bad = np.zeros(run_number[-1] + 1 if len(at) else 0, bool)
    bad[run_number[~equal]] = True
    own = np.arange(len(at))
    source = np.where(bad[run_number], own, source) if len(at) else own
    return doc[source], place[source]


def factors_of(batch: Batch, shards: int, told: Told) -> tuple[np.ndarray, ...]:
    """Factors in order: row, first word in the document, words, source document and word. Factors may overlap by
    less than a window, where the source changes."""
    row, first, count, ref_doc, ref_place = batch.factors(shards, told)
    first = first - batch.tokens.offsets[row]
    order = np.lexsort((ref_doc, first, row))
    row, first, count, ref_doc, ref_place = (x[order] for x in (row, first, count, ref_doc, ref_place))
    # a window may be told of twice, by its shard and by its batch: the smaller source stays
    new = np.ones(len(row), bool)
    if len(row) > 1:
        end = first + count
        new[1:] = (row[1:] != row[:-1]) | (ref_doc[1:] != ref_doc[:-1]) | (first[1:] > end[:-1]) | (
            ref_place[1:] - first[1:] != ref_place[:-1] - first[:-1]
        )
    begin = np.flatnonzero(new)
    stop = np.maximum.reduceat(first + count, begin) if len(begin) else first
    return row[begin], first[begin], stop - first[begin] + batch.span - 1, ref_doc[begin], ref_place[begin]


def cut_documents(batch: Batch, shards: int, told: Told, with_kept: bool) -> pa.Table:
    tokens = batch.tokens
    removed = batch.removed(shards, told)
    factors = np.bincount(factors_of(batch, shards, told)[0], minlength=len(batch.ids))
    out: dict[str, list] = {n: [] for n in ("n_words", "n_removed", "kept_sha256", "kept")}
    for a, b in zip(tokens.offsets[:-1], tokens.offsets[1:], strict=True):
        n = int(np.count_nonzero(removed[a:b]))
        if a == b:
            kept = b""
        elif not n:
            kept = tokens.data[tokens.starts[a] : tokens.ends[b - 1]].tobytes()
        else:
            stay = np.flatnonzero(~removed[a:b]) + a
            kept = tokens.data[ranges(tokens.starts[stay], tokens.ends[stay] - tokens.starts[stay] + 1)].tobytes()[:-1]
        out["n_words"].append(b - a)
        out["n_removed"].append(n)
        out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        out["kept"].append(kept.decode() if with_kept else None)
    return pa.table(
        {
            "doc_id": pa.array(batch.ids, mask=batch.ids == NULL_ID),
            "n_words": pa.array(out["n_words"], pa.int64()),
            "n_removed": pa.array(out["n_removed"], pa.int64()),
            "n_factors": pa.array(factors, pa.int64()),
            "kept_sha256": pa.array(out["kept_sha256"], pa.string()),
            "kept": pa.array(out["kept"], pa.string()),
        }
    )


def list_factors(batch: Batch, shards: int, told: Told) -> pa.Table:
    row, first, words, ref_doc, ref_place = factors_of(batch, shards, told)
    doc = batch.ids[row]
    columns = {"first_word": first, "n_words": words, "source_doc": ref_doc, "source_word": ref_place}
    return pa.table(
        {"doc_id": pa.array(doc, mask=doc == NULL_ID)} | {n: pa.array(v, pa.int64()) for n, v in columns.items()}
    )


def remove_repeated_words(
    docs: DataFrame, span: int = 50, doc_id: str = "doc_id", text: str = "text", with_kept: bool = True
) -> DataFrame:
    """Remove each word that a window of ``span`` words covers which also starts in a document of smaller id.

    Words are runs of bytes other than ASCII white space, unchanged. One row per row of ``docs``: id, words, removed
    words, factors, SHA-256 of the kept words joined by a blank and, if asked for, these words. A null text has no
    words; texts of fewer than ``span`` words stay whole; for null and repeated ids see ``passages``.
    """
    return repeated_passages(
        docs, WordTokens, parse_block, lambda b, s, a: cut_documents(b, s, a, with_kept), CUT_SCHEMA, span,
        max(1, span // 6), doc_id, text,
    )


def repeated_factors(docs: DataFrame, span: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The factors themselves: where each begins, how many words it copies, and from where."""
    return repeated_passages(docs, WordTokens, parse_block, list_factors, FACTOR_SCHEMA, span, max(1, span // 6), doc_id, text)
