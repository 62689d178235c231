"""Duplicate byte strings by suffix arrays.

Shards of text are sorted into suffix arrays by induced sorting; permuted common prefixes then show which places begin
the same ``span`` bytes, and the smallest document of each such group keeps them.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from anchorline.llm.frames import NULL_ID
from anchorline.llm.kernels import ByteTokens, ranges
from anchorline.llm.passages import Batch, Pieces, Told, repeated_passages
from anchorline.llm.suffixes import common_prefixes, suffix_array

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def smallest_holders(pieces: Pieces, span: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window, the smallest document in this block that holds it, and its place there."""
    bounds = np.frombuffer(pieces.text.buffers()[1], np.int64)[: len(pieces.text) + 1]
    size = np.diff(bounds)
    raw = np.frombuffer(pieces.text.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    first = bounds[:-1] - bounds[0] + np.arange(len(size))
    n = len(raw) + len(size)
    data, separator = np.zeros(n + span + 8, np.uint8), np.zeros(n, bool)
    separator[first + size] = True
    data[:n][~separator] = raw
    order = suffix_array(data[:n], separator)
    window = ranges(first, pieces.windows)
    shared = common_prefixes(data, order, first, pieces.windows, span)
    # windows in the order of the suffix array; a new group begins where the common prefix is shorter than a window
    mark = np.full(n, -1, np.int64)
    mark[window] = np.arange(len(window))
    sorted_window = mark[order]
    sorted_window = sorted_window[sorted_window >= 0]
    group = np.cumsum(shared[sorted_window] < span)
    owner = np.repeat(np.arange(len(size)), pieces.windows)[sorted_window]
    doc, place = pieces.doc[owner], (pieces.place[owner] + window[sorted_window] - first[owner])
    by = np.lexsort((place, doc, group))
    head = by[np.flatnonzero(np.diff(group[by], prepend=-1))]
    out_doc, out_place = np.empty(len(window), np.int64), np.empty(len(window), np.int64)
    index = np.cumsum(np.diff(group, prepend=group[0] if len(group) else 0) != 0) if len(group) else group
    out_doc[sorted_window], out_place[sorted_window] = doc[head][index], place[head][index]
    return out_doc, out_place


def cut_documents(batch: Batch, shards: int, told: Told, with_kept: bool) -> pa.Table:
    removed = batch.removed(shards, told)
    data, offsets = batch.tokens.data, batch.tokens.offsets
    out: dict[str, list] = {n: [] for n in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        gone = removed[a:b]
        n = int(np.count_nonzero(gone))
        kept = data[a:b].tobytes() if not n else data[a:b][~gone].tobytes()
        out["n_bytes"].append(b - a)
        out["n_removed"].append(n)
        out["n_spans"].append(int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1])) if n else 0)
        out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        out["kept"].append(kept if with_kept else None)
    return pa.table(
        {"doc_id": pa.array(batch.ids, mask=batch.ids == NULL_ID)}
        | {n: pa.array(v, {"kept": pa.binary(), "kept_sha256": pa.string()}.get(n, pa.int64())) for n, v in out.items()}
    )


def remove_repeated_bytes(
    docs: DataFrame, span: int = 50, doc_id: str = "doc_id", text: str = "text", with_kept: bool = True
) -> DataFrame:
    """Remove each byte that a string of ``span`` bytes covers which also starts in a document of smaller id.

    One row per row of ``docs``: id, bytes, removed bytes, maximal removed runs, SHA-256 of the kept bytes and, if
    asked for, these bytes. A null text is empty; texts shorter than ``span`` stay whole; for null and repeated ids
    see ``passages``.
    """
    return repeated_passages(
        docs, ByteTokens, smallest_holders, lambda b, s, a: cut_documents(b, s, a, with_kept), SCHEMA, span,
        max(1, span // 2), doc_id, text,
    )
