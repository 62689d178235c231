"""Licence scans by diagonal voting.

1. Every text is cut into words, and every run of k neighbouring words is hashed, at every place. The runs meet the places
   of the templates' runs in a Spark join on the hash.
2. A run at place p that equals a template's run at place t votes for the diagonal p - t, the place at which the template
   would begin. Votes are counted per document, template and diagonal.
3. Words put in or left out shift the rest of a copy to a neighbouring diagonal, so diagonals at most ``slack`` apart
   are merged. Merged diagonals with enough of a template's runs give a candidate span.
4. Spans are verified on the words themselves: a phrase has to stand there word by word; of a licence text the longest
   common subsequence with the span, divided by the longer of template and matched stretch, has to reach ``least``.
   Of overlapping spans of licence texts those with the largest share stay.

Documents are known by a digest of id and text, so rows that repeat are voted for once and each gets the answer. The
texts themselves are moved only if there are more documents with candidates than may be broadcast.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from anchorline.llm.frames import map_arrow
from anchorline.llm.kernels import RangeHash, joined_bytes, ranges, slices_of, text_bounds, word_bounds, word_hashes
from anchorline.session import stored_small

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLICE_BYTES = 4 << 20  # bytes of text handled at a time
PLACES = 1 << 16  # runs in one row
GRAM = 3  # words of a run; shorter phrases are one run

# Phrases and labels of the base scan.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Public licence notices, which the scan looks for by default.
NOTICES = (
    ("Released under the MIT License.", "mit"),
    ("Licensed under the Apache License, Version 2.0.", "apache"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
    ("Licensed under CC BY 4.0.", "cc-by"),
    ("Licensed under CC BY-SA 4.0.", "cc-by-sa"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
     "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.", "mit"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
     "following conditions are met.", "bsd"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
     "License as published by the Free Software Foundation.", "gpl"),
    ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on "
     "an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "apache"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies.", "isc"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
     "distributed with this file, You can obtain one at", "mpl"),
)


class Words:
    """Words of texts: runs of ASCII letters (A-Z lowered), digits and bytes from 0x80 on."""

    def __init__(self, texts: pa.Array):
        raw, bounds = joined_bytes(texts, "\n")
        self.data = raw + (((raw >= 65) & (raw <= 90)) * np.uint8(32))
        self.starts, self.ends, self.before = word_bounds(self.data, bounds)

    def runs(self, size: int) -> np.ndarray:
        """Hash of every run of ``size`` words; runs that cross a text's end are among them."""
        return RangeHash(word_hashes(self.data, self.starts, self.ends)).grams(size).view(np.int64)

    def of(self, row: int, lo: int, hi: int) -> list[bytes]:
        """The words [lo, hi) of a text."""
        first, raw = self.before[row], self.data
        return [raw[self.starts[i] : self.ends[i]].tobytes() for i in range(first + lo, min(first + hi, self.before[row + 1]))]


@dataclass(frozen=True)
class Template:
    words: tuple[bytes, ...]
    label: str
    base: bool
    size: int = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "size", min(GRAM, len(self.words)))


def templates_of(phrases=PHRASES, notices=NOTICES) -> list[Template]:
    """Templates from (text, label); texts without words are left out."""
    out = []
    for rows, base in ((phrases, True), (notices, False)):
        for text, label in rows:
            cut = Words(pa.array([text]))
            words = tuple(cut.of(0, 0, len(text)))
            out += [Template(words, label, base)] if words else []
    return out


def _positions(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """One row per run of a template. Their number is that of the templates' words."""
    rows = []
    for number, template in enumerate(templates):
        found = Words(pa.array([b" ".join(template.words).decode()])).runs(template.size)
        rows += [(int(gram), number, at) for at, gram in enumerate(found)]
    return stored_small(spark.createDataFrame(rows, "gram long, template int, at int"))


def _runs(keyed: DataFrame, sizes: list[int]) -> DataFrame:
    """All runs of all texts: key, place of the first one, and up to PLACES hashes a row."""
    schema = pa.schema([("key", pa.binary()), ("first", pa.int64()), ("grams", pa.list_(pa.int64()))])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in slices_of(text_bounds(texts), SLICE_BYTES):
                words, keys = Words(texts.slice(lo, hi - lo)), batch.column("key").slice(lo, hi - lo)
                for size in sizes:
                    grams = words.runs(size)
                    counts = np.maximum(np.diff(words.before) - size + 1, 0)
                    pieces = -(-counts // PLACES)
                    row = np.repeat(np.arange(len(counts)), pieces)
                    first = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * PLACES
                    held = np.minimum(counts[row] - first, PLACES)
                    for a, b in slices_of(np.concatenate([[0], np.cumsum(held)]), SLICE_BYTES // 8):
                        values = grams[ranges(words.before[row[a:b]] + first[a:b], held[a:b])]
                        offsets = pa.array(np.concatenate([[0], np.cumsum(held[a:b])]), pa.int32())
                        lists = pa.ListArray.from_arrays(offsets, pa.array(values))
                        columns = [keys.take(pa.array(row[a:b])).cast(pa.binary()), pa.array(first[a:b]), lists]
                        yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return map_arrow(keyed.select("key", "text"), go, "key binary, first long, grams array<long>")


def common_stretch(template: list, span: list) -> tuple[int, int, int]:
    """Length of the longest common subsequence, and the first and last place in ``span`` that it uses.

    Of all places that allow the length, the last ends as early as possible.
    """
    rows = np.zeros((len(template) + 1, len(span) + 1), np.int32)
    codes = {w: i for i, w in enumerate(dict.fromkeys([*template, *span]))}
    there = np.array([codes[w] for w in span], np.int64)
    for i, word in enumerate(template, 1):
        rows[i, 1:] = np.maximum(rows[i - 1, 1:], rows[i - 1, :-1] + (there == codes[word]))
        rows[i] = np.maximum.accumulate(rows[i])
    length = int(rows[-1, -1])
    if not length:
        return 0, 0, 0
    i, j = len(template), int(np.argmax(rows[-1] == length))
    first = last = j - 1
    while i and j:
        if rows[i - 1, j] == rows[i, j]:
            i -= 1
        elif rows[i, j - 1] == rows[i, j]:
            j -= 1
        else:
            first, i, j = j - 1, i - 1, j - 1
    return length, first, last


def verified(words: Words, row: int, template: Template, lo: int, hi: int) -> tuple[int, int, float] | None:
    """First word, end and share of the template's best stretch inside the words [lo, hi); None without any.

    Long spans, as a text that repeats a notice gives them, are read in overlapping pieces.
    """
    size, n = len(template.words), int(words.before[row + 1] - words.before[row])
    lo, hi = max(lo, 0), min(hi, n)
    if template.base:
        return (lo, lo + size, 1.0) if tuple(words.of(row, lo, lo + size)) == template.words else None
    best = None
    for a in range(lo, max(hi - 2 * size, lo + 1), 2 * size):
        matched, first, last = common_stretch(list(template.words), words.of(row, a, min(a + 4 * size, hi)))
        share = matched / max(size, last - first + 1)
        if matched and (best is None or share > best[2]):
            best = (a + first, a + last + 1, share)
    return best


def strongest(found: list[dict]) -> list[dict]:
    """Of overlapping stretches those with the largest share."""
    kept, group, reach = [], [], -1
    for one in [*sorted(found, key=lambda x: (x["first"], x["end"])), None]:
        if one is None or one["first"] >= reach:
            most = max((x["share"] for x in group), default=0.0)
            kept += [x for x in group if x["share"] == most]
            group, reach = [], -1
        if one is not None:
            group.append(one)
            reach = max(reach, one["end"])
    return kept


def candidates(keyed: DataFrame, templates: list[Template], slack: int, votes: float) -> DataFrame:
    """Per key the spans (template, lo, hi) that enough runs of a template vote for."""
    spark = keyed.sparkSession
    runs = _runs(keyed, sorted({t.size for t in templates}))
    each = runs.select("key", "first", F.posexplode("grams").alias("step", "gram"))
    met = each.join(_positions(spark, templates), "gram").select(
        "key", "template", "at", (F.col("first") + F.col("step") - F.col("at")).alias("diagonal")
    )
    diagonals = met.groupBy("key", "template", "diagonal").agg(F.collect_set("at").alias("ats"))
    own = Window.partitionBy("key", "template").orderBy("diagonal")
    array = lambda values: F.array(*map(F.lit, values))
    of = lambda values: F.get(array(values), F.col("template"))
    base = of([t.base for t in templates])
    apart = F.coalesce(base | (F.col("diagonal") - F.lag("diagonal").over(own) > slack), F.lit(True))
    groups = diagonals.withColumn("apart", apart.cast("long")).withColumn("cluster", F.sum("apart").over(own))
    merged = groups.groupBy("key", "template", "cluster").agg(
        F.min("diagonal").alias("lo"), F.max("diagonal").alias("hi"),
        F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("held"),
    )
    runs_of = of([len(t.words) - t.size + 1 for t in templates])
    enough = F.when(base, F.col("held") == runs_of).otherwise(F.col("held") >= F.lit(votes) * runs_of)
    span = F.struct("template", "lo", (F.col("hi") + of([len(t.words) for t in templates])).alias("hi"))
    return merged.where(enough).groupBy("key").agg(F.sort_array(F.collect_list(span)).alias("spans"))


FOUND = "array<struct<label: string, base: boolean, first: bigint, end: bigint, share: double>>"


def scan_licenses(
    docs: DataFrame, templates: list[Template] | None = None, slack: int = 3, votes: float = 0.25, least: float = 0.75,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, and ``spans`` (label, base, first word, end, share), in order.

    ``base`` spans are the places of phrases; the others are licence texts, whose ``share`` is at least ``least``. Null
    and empty texts have no words and no spans; rows that repeat get equal answers, and a null id is an id like
    others. Further columns are left out, so none can clash.
    """
    templates = templates_of() if templates is None else templates
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.coalesce("text", F.lit("")))
    keyed = narrow.withColumn("key", F.unhex(F.md5(name.cast("binary"))))
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()),
        ("spans", pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("first", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))),
    ])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in slices_of(text_bounds(texts), SLICE_BYTES):
                words, spans, out = Words(texts.slice(lo, hi - lo)), batch.column("spans").slice(lo, hi - lo).to_pylist(), []
                for row, wanted in enumerate(spans):
                    found: dict[bool, list] = {True: [], False: []}
                    for s in wanted or ():
                        t = templates[s["template"]]
                        stretch = verified(words, row, t, s["lo"], s["hi"])
                        if stretch and stretch[2] >= least:
                            found[t.base].append(dict(zip(("first", "end", "share"), stretch), label=t.label, base=t.base))
                    out.append(sorted(found[True] + strongest(found[False]), key=lambda x: (x["first"], x["end"], x["label"])))
                columns = [batch.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(words.before)), pa.array(out, schema.field("spans").type)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    known = stored_small(candidates(keyed, templates, slack, votes)) if templates else None
    spans = "array<struct<template: int, lo: bigint, hi: bigint>>"
    joined = keyed.join(known, "key", "left") if known else keyed.withColumn("spans", F.lit(None).cast(spans))
    return map_arrow(joined.select("doc_id", "text", "spans"), verify, f"doc_id long, n_words long, spans {FOUND}")
