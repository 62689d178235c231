"""Benchmark items inside documents, found by greedy string tiling.

Texts are compared as lower-cased words without punctuation. Every run of ``MATCH`` words of an item is a seed; seeds
are joined with the runs of all documents by their rolling hash. For a document and an item that share seeds, tiles are
marked: the longest match of still unmarked words is taken, verified word by word, and this is repeated down to MATCH
words. The share of the item's words under tiles is its coverage, whatever the order in which its parts appear.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from anchorline.llm.frames import map_arrow, parts, total_bytes
from anchorline.llm.kernels import RangeHash, joined_bytes, lower_bytes, ranges, slices_of, text_bounds, word_bounds, word_hashes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MATCH, COVERAGE = 5, 0.6
SLICE_BYTES, BLOCK_BYTES = 4 << 20, 8 << 20


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and the number of words before each text."""
    data, bounds = joined_bytes(texts)
    data = lower_bytes(data)
    starts, ends, upto = word_bounds(data, bounds)
    return word_hashes(data, starts, ends), upto


def grams_inside(words: np.ndarray, upto: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words that lie within a text, and where they begin."""
    count = np.maximum(np.diff(upto) - size + 1, 0)
    first = ranges(upto[:-1], count)
    return RangeHash(words).of(first, first + size), first


@dataclass
class Seeds:
    """Seeds of a block of items, sorted by hash."""

    ids: list
    words: np.ndarray
    upto: np.ndarray
    hashes: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, ids: list, texts: pa.Array, match: int) -> Seeds:
        words, upto = words_of(texts)
        hashes, place = grams_inside(words, upto, match)
        order = np.argsort(hashes, kind="stable")
        return cls(ids, words, upto, hashes[order], place[order])

    def join(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of (number of the given hash, place of a seed) that agree."""
        lo, hi = np.searchsorted(self.hashes, hashes, "left"), np.searchsorted(self.hashes, hashes, "right")
        hit = np.flatnonzero(hi > lo)
        each = hi[hit] - lo[hit]
        return np.repeat(hit, each), self.place[ranges(lo[hit], each)]


def tiles(doc: np.ndarray, item: np.ndarray, seeds: list[tuple[int, int]], match: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of two lists of words: (place in the document, place in the item, words).

    ``seeds`` are the matches of ``match`` words that the rolling hash has found. Runs of seeds on one diagonal are the
    maximal matches; the longest unmarked piece of one is marked in each turn, ties to the earlier place in the item,
    then in the document.
    """
    runs: dict[tuple[int, int], int] = {}
    last: dict[int, tuple[int, int]] = {}
    for d, i in sorted(seeds):
        start = last.get(d - i)
        if start is not None and start[0] + runs[start] - match + 1 == d:
            runs[start] += 1
        else:
            start = last[d - i] = (d, i)
            runs[start] = match
    free_doc, free_item = np.ones(len(doc), bool), np.ones(len(item), bool)
    open_runs = [(n, i, d) for (d, i), n in runs.items() if (doc[d : d + n] == item[i : i + n]).all()]
    out = []
    while open_runs:
        open_runs.sort(key=lambda r: (-r[0], r[1], r[2]))
        n, i, d = open_runs[0]
        if free_doc[d : d + n].all() and free_item[i : i + n].all():
            out.append((d, i, n))
            free_doc[d : d + n] = free_item[i : i + n] = False
            open_runs.pop(0)
            continue
        # part of it is marked by now: its unmarked pieces stay in the list
        free = free_doc[d : d + n] & free_item[i : i + n]
        edge = np.diff(np.concatenate([[0], free.astype(np.int8), [0]]))
        pieces = zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)
        open_runs[:1] = [(int(b - a), i + int(a), d + int(a)) for a, b in pieces if b - a >= match]
    return out


def leaks_in(texts: pa.Array, seeds: Seeds, match: int, coverage: float) -> Iterator[tuple]:
    """(text number, item number, covered words, words of the item, tiles)."""
    words, upto = words_of(texts)
    hashes, first = grams_inside(words, upto, match)
    at, place = seeds.join(hashes)
    if not len(at):
        return
    row = np.searchsorted(upto, first[at], "right") - 1
    item = np.searchsorted(seeds.upto, place, "right") - 1
    pair = row * len(seeds.ids) + item
    # words of the item that some seed covers bound its coverage from above
    size = np.diff(seeds.upto)
    covered = np.unique(np.repeat(pair, match) * np.int64(size.max() + 1) + np.repeat(place - seeds.upto[item], match) + np.tile(np.arange(match), len(pair)))
    pairs, counts = np.unique(covered // (size.max() + 1), return_counts=True)
    likely = pairs[counts >= coverage * size[pairs % len(seeds.ids)]]
    order = np.argsort(pair, kind="stable")
    begin, end = np.searchsorted(pair[order], likely, "left"), np.searchsorted(pair[order], likely, "right")
    for p, a, b in zip(likely, begin, end, strict=True):
        r, i = int(p) // len(seeds.ids), int(p) % len(seeds.ids)
        mine = order[a:b]
        found = list(zip((first[at[mine]] - upto[r]).tolist(), (place[mine] - seeds.upto[i]).tolist(), strict=True))
        marked = tiles(words[upto[r] : upto[r + 1]], seeds.words[seeds.upto[i] : seeds.upto[i + 1]], found, match)
        total = sum(n for _, _, n in marked)
        if total >= coverage * size[i]:
            yield r, i, total, int(size[i]), len(marked)


def seed_blocks(benchmark: DataFrame, match: int, item_id: str, item_text: str) -> Iterator[Seeds]:
    """The items, in blocks of about BLOCK_BYTES, one after another. They are a stated query set."""
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("text IS NOT NULL")
    blocks = parts(total_bytes(items), BLOCK_BYTES)
    for number in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number).collect()
        seeds = Seeds.of([r[0] for r in block], pa.array([r[1] for r in block], pa.string()), match)
        if len(seeds.hashes):
            yield seeds


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", match: int = MATCH, coverage: float = COVERAGE,
) -> DataFrame:
    """One row per row of ``docs`` and item whose words it covers by at least ``coverage``.

    Items of fewer than ``match`` words, null texts and texts without words take no part; null ids are carried along;
    repeated rows and items each count. The items are read in blocks of bounded size, and each block meets all
    documents in one narrow pass, so neither documents nor pairs are shuffled.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    names = ["doc_id", "item_id", "covered", "item_words", "tiles"]

    def block_pass(seeds: Seeds) -> DataFrame:
        def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b in slices_of(text_bounds(batch.column(1)), SLICE_BYTES):
                    found = list(leaks_in(batch.column(1).slice(a, b - a), seeds, match, coverage))
                    columns = [batch.column(0).take(pa.array([a + f[0] for f in found], pa.int64()))]
                    columns.append(pa.array([seeds.ids[f[1]] for f in found], pa.int64()))
                    columns += [pa.array([f[k] for f in found], pa.int64()) for k in (2, 3, 4)]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

        return map_arrow(rows, search, ", ".join(f"{n} long" for n in names))

    passes = [block_pass(s) for s in seed_blocks(benchmark, match, item_id, item_text)]
    found = reduce(DataFrame.unionAll, passes) if passes else rows.sparkSession.createDataFrame([], ", ".join(f"{n} long" for n in names))
    return found.withColumn("coverage", F.col("covered") / F.col("item_words"))


def drop_leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    match: int = MATCH, coverage: float = COVERAGE,
) -> DataFrame:
    """The rows of ``docs`` that cover no item by ``coverage``; all columns stay. Narrow, one pass per block of items."""
    at = docs.columns.index(text)

    def without(seeds: Seeds):
        def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for a, b in slices_of(text_bounds(batch.column(at)), SLICE_BYTES):
                    clean[[a + f[0] for f in leaks_in(batch.column(at).slice(a, b - a), seeds, match, coverage)]] = False
                yield batch.filter(pa.array(clean))

        return keep

    for seeds in seed_blocks(benchmark, match, item_id, item_text):
        docs = map_arrow(docs, without(seeds), docs.schema)
    return docs
