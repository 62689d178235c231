"""Fill-in-the-middle: a document's middle lines move to its end, behind sentinels, and come back exactly.

A text is cut at two line ends that a hash of its id draws. The sentinels are inserted in a bytearray at the cuts, which
gives prefix, middle and suffix in their old order; then two neighbouring segments change places by three reversals, in
place and a block at a time. The inverse rotation brings a transformed text back. Both directions are narrow: no row
depends on another one, nothing is shuffled, and a lost task is simply run again.

Forms: ``psm`` is <P>prefix<S>suffix<M>middle, ``spm`` is <S>suffix<P>prefix<M>middle, and ``plain`` texts stay as they
are: empty ones, those that hold a sentinel, and those the draw leaves out.
"""

from __future__ import annotations

import struct
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from anchorline.llm.frames import map_arrow

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 1 << 16  # bytes that a reversal exchanges at a time
OUT_BYTES = 16 << 20  # texts of about so many bytes leave a task at once
NEWLINE = 10


@dataclass(frozen=True)
class Plan:
    """Sentinels, seed, and the shares (per cent) of texts that are transformed and, of those, that become ``spm``."""

    prefix: bytes = b"<P>"
    suffix: bytes = b"<S>"
    middle: bytes = b"<M>"
    seed: int = 7
    share: int = 100
    spm_share: int = 50


def reverse(data: np.ndarray, lo: int, hi: int) -> None:
    """Reverse data[lo:hi] in place; the only copy is one block."""
    while hi - lo > 1:
        step = min(BLOCK, (hi - lo) // 2)
        head = data[lo : lo + step].copy()
        data[lo : lo + step] = data[hi - step : hi][::-1]
        data[hi - step : hi] = head[::-1]
        lo, hi = lo + step, hi - step


def rotate(buffer: bytearray, lo: int, cut: int, hi: int) -> None:
    """Exchange the neighbouring segments [lo, cut) and [cut, hi): reverse each of them, then both together."""
    data = np.frombuffer(buffer, np.uint8)
    reverse(data, lo, cut)
    reverse(data, cut, hi)
    reverse(data, lo, hi)


def line_ends(text: bytes) -> np.ndarray:
    """End of every line; a line keeps its newline, and the last one may have none."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == NEWLINE) + 1
    return np.append(ends, len(text)) if len(text) and (not len(ends) or ends[-1] < len(text)) else ends


def draws(plan: Plan, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four 32-bit numbers from the hash of seed and id; a null id counts as an empty text."""
    return struct.unpack(">4I", sha256(f"{plan.seed}:{'' if doc_id is None else doc_id}".encode()).digest()[:16])


def code_points(text: bytes | memoryview) -> int:
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def transformed(plan: Plan, doc_id: int | None, text: bytes) -> tuple[int, str, int | None, int | None, bytes]:
    """Lines, form, code points of prefix and middle (None if plain), and the transformed text."""
    ends = line_ends(text)
    n = len(ends)
    first, second, chosen, kind = draws(plan, doc_id)
    if not text or chosen % 100 >= plan.share or any(s in text for s in (plan.prefix, plan.suffix, plan.middle)):
        return n, "plain", None, None, text
    a, b = sorted((first % (n + 1), second % (n + 1)))
    a, b = (int(ends[i - 1]) if i else 0 for i in (a, b))
    buffer = bytearray(text)
    buffer[b:b] = plan.suffix
    buffer[a:a] = plan.middle
    buffer[0:0] = plan.prefix
    middle_at = len(plan.prefix) + a
    suffix_at = middle_at + len(plan.middle) + b - a
    form = "spm" if kind % 100 < plan.spm_share else "psm"
    rotate(buffer, 0 if form == "spm" else middle_at, suffix_at, len(buffer))
    return n, form, code_points(text[:a]), code_points(text[a:b]), bytes(buffer)


def restored(plan: Plan, form: str, output: bytes) -> bytes:
    """The text before ``transformed``. A transformed text holds each sentinel once, as the text itself has none."""
    if form == "plain":
        return output
    buffer = bytearray(output)
    if form == "spm":
        rotate(buffer, 0, output.index(plan.prefix), len(buffer))
    else:
        rotate(buffer, output.index(plan.suffix), output.index(plan.middle), len(buffer))
    for sentinel in (plan.suffix, plan.middle, plan.prefix):
        at = buffer.index(sentinel)
        del buffer[at : at + len(sentinel)]
    return bytes(buffer)


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[bytes]:
    for value in batch.column(column).cast(pa.large_binary()):
        yield value.as_py() or b""


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    """Record batches of about OUT_BYTES; the column at place ``size`` holds the long texts."""
    held, amount = [], 0
    for row in rows:
        held.append(row)
        amount += len(row[size])
        if amount >= OUT_BYTES:
            yield _batch(held, schema)
            held, amount = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.binary()).cast(f.type) if f.type == pa.string() and isinstance(c[0], bytes) else pa.array(c, f.type)
         for c, f in zip(columns, schema, strict=True)], schema=schema,
    )


def fill_in_middle(docs: DataFrame, plan: Plan = Plan(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n (lines), form, prefix_chars, middle_chars (code points; null if plain), output.

    A null text counts as empty and stays plain with 0 lines. A null id draws as an empty text does; rows that repeat
    an id are cut by the same draws. Further columns are left out, so none can clash.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
         ("middle_chars", pa.int64()), ("output", pa.string())]
    )

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows = ((i, *transformed(plan, i, t)) for i, t in zip(ids, _texts(batch, "text"), strict=True))
            yield from _batches(rows, schema, 5)

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_arrow(narrow, go, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(rows: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """The rows of ``fill_in_middle`` with ``restored``, the text rebuilt from ``output`` and ``form`` alone."""
    kept = [f.name for f in rows.schema if f.name != "restored"]
    out = rows.select(*kept, F.lit("").alias("restored")).schema

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = batch.column("form").to_pylist()
            back = [restored(plan, f, t) for f, t in zip(forms, _texts(batch, "output"), strict=True)]
            texts = pa.array(back, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), texts], names=[*kept, "restored"])

    return map_arrow(rows.select(*kept), go, out)
