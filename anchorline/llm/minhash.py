"""Near duplicates by fast similarity sketching, banding and exact verification.

A sketch has ``COORDINATES`` bins. In each of the first rounds a round's hash throws every element of the set into a bin,
and a bin that is still empty keeps the least value thrown into it; from round COORDINATES on, round i throws all
elements into bin i - COORDINATES. So every bin is filled, and a sketch costs about the set's size plus t log t. Two sets
agree in a bin with a probability equal to their similarity, and the number of agreeing bins is sharply concentrated.

Equal sets are joined first, by their hash. Sketches are cut into bands; sets that agree in a band are candidates. All
members of a band's bucket are first compared with its smallest member, which joins groups of copies without comparing
their members in pairs. Members that are in different components after that are compared where they share an item that
is rare enough (see ``prefix_pairs``), which loses none of them. Every link is confirmed on the full sets. With 56 bands of 6 a pair of similarity 0.75 is missed with probability 2e-5, one of 0.8
with 3e-8.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from anchorline.llm.components import components
from anchorline.llm.frames import map_arrow
from anchorline.llm.kernels import RangeHash, WordTokens, mix, ranges, slices_of, text_bounds
from anchorline.session import scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS, BANDS = 6, 56
COORDINATES = ROWS * BANDS
SLICE_BYTES = 2 << 20
MOST_SLOTS = 1 << 21  # counters of item frequencies, 8 bytes each
BROADCAST_IDS = 500_000  # at most so many ids (8 bytes each) are broadcast; more are joined by a shuffle


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's shingles, one text after another, and their bounds."""
    tokens = WordTokens(texts, lower=True)
    found = RangeHash(tokens.hashes)
    count = np.diff(tokens.offsets)
    each = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    text = np.repeat(np.arange(len(count)), each)
    first = tokens.offsets[:-1][text] + ranges(np.zeros(len(count), np.int64), each)
    shingle = found.of(first, first + np.minimum(count, words)[text])
    order = np.lexsort((shingle, text))
    text, shingle = text[order], shingle[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])
    return shingle[new], np.concatenate([[0], np.cumsum(np.bincount(text[new], minlength=len(count)))])


def sketches(elements: np.ndarray, bounds: np.ndarray, size: int = COORDINATES) -> np.ndarray:
    """One sketch per set, sets x size; sets without elements have zeros."""
    n = len(bounds) - 1
    empty = np.uint64(2**64 - 1)
    out = np.full(n * size, empty, np.uint64)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    for turn in range(2 * size):
        if not len(elements):
            break
        thrown = mix(elements + np.uint64((turn + 1) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF))
        low = thrown & np.uint64(0xFFFFFFFF)
        if turn < size:
            at = owner * size + ((thrown >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        else:
            at = owner * size + (turn - size)
        # values of earlier rounds are smaller, so they stay
        np.minimum.at(out, at, low | np.uint64(turn << 32))
        if turn < 4 or turn % 4 == 3:
            open_sets = (out.reshape(n, size) == empty).any(axis=1)
            stay = open_sets[owner]
            elements, owner = elements[stay], owner[stay]
    return np.where(out == empty, 0, out).reshape(n, size)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """One key per band, sets x BANDS."""
    parts = mix(sketch.reshape(len(sketch), BANDS, ROWS) + np.arange(1, ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return mix(parts.sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def set_keys(elements: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each set."""
    keys = []
    for salt in (1, 2):
        sums = np.concatenate([[0], np.cumsum(mix(elements ^ np.uint64(salt * 0xA24BAED4963EE407 & 0xFFFFFFFFFFFFFFFF)), dtype=np.uint64)]).astype(np.uint64)
        keys.append(sums[bounds[1:]] - sums[bounds[:-1]])
    return keys[0].view(np.int64), keys[1].view(np.int64)


def sketch_documents(docs: DataFrame, words: int) -> DataFrame:
    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds = text_bounds(batch.column(1))
            for a, b in slices_of(bounds, SLICE_BYTES):
                elements, upto = shingle_sets(batch.column(1).slice(a, b - a), words)
                one, two = set_keys(elements, upto)
                bands = band_keys(sketches(elements, upto)).view(np.int64)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column(0).slice(a, b - a), "n_shingles": np.diff(upto), "key1": one, "key2": two,
                        "bands": pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * BANDS, BANDS), pa.int32()), bands.ravel()),
                    }
                )

    return map_arrow(docs, sketch, "doc_id long, n_shingles long, key1 long, key2 long, bands array<long>")


def shingle_arrays(docs: DataFrame, words: int) -> DataFrame:
    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds = text_bounds(batch.column(1))
            for a, b in slices_of(bounds, SLICE_BYTES):
                elements, upto = shingle_sets(batch.column(1).slice(a, b - a), words)
                yield pa.RecordBatch.from_pydict(
                    {"id": batch.column(0).slice(a, b - a), "items": pa.ListArray.from_arrays(pa.array(upto, pa.int32()), elements.view(np.int64))}
                )

    return map_arrow(docs, sets, "id long, items array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    shared = F.size(F.array_intersect("x.items", "y.items"))
    union = F.size("x.items") + F.size("y.items") - shared
    return (
        pairs.join(sets.alias("x"), F.col("a") == F.col("x.id"))
        .join(sets.alias("y"), F.col("b") == F.col("y.id"))
        .where(100 * shared >= percent * union)
        .select("a", "b")
    )


def prefix_pairs(apart: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of ``apart`` (id, component) in different components that can reach the similarity.

    The items of every set are ordered from rare to frequent. Sets that reach the similarity share an item among the
    first ones, whose number is what the sets may differ in, and the items behind it must suffice for the rest. Sets
    that have only a frequent passage in common share no such item. Any order would do: frequencies are counted over
    hashed slots, whose number follows that of the sets up to MOST_SLOTS.
    """
    own = sets.join(apart, "id").select("id", "component", "items")
    slots = 1 << min(MOST_SLOTS.bit_length() - 1, max(16, (4 * apart.count()).bit_length()))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.int64)
        for batch in batches:
            items = batch.column(0).flatten().to_numpy().view(np.uint64)
            total += np.bincount((items & np.uint64(slots - 1)).astype(np.int64), minlength=slots)
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"slot": slot, "n": total[slot]})

    found = map_arrow(own.select("items"), count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    frequency = np.zeros(slots, np.int64)
    frequency[[r[0] for r in found]] = [r[1] for r in found]

    def prefixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column(2).flatten().to_numpy().view(np.uint64)
            size = np.diff(batch.column(2).offsets.to_numpy())
            owner = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((items, frequency[(items & np.uint64(slots - 1)).astype(np.int64)], owner))
            first = size - -(-percent * size // 100) + 1
            place = ranges(np.zeros(len(size), np.int64), first)
            at = order[ranges(np.cumsum(size) - size, first)]
            row = np.repeat(np.arange(len(size)), first)
            yield pa.RecordBatch.from_pydict(
                {"item": items[at].view(np.int64), "id": batch.column(0).take(pa.array(row)), "component": batch.column(1).take(pa.array(row)),
                 "n": size[row].astype(np.int64), "rest": (size[row] - place).astype(np.int64)}
            )

    kept = map_arrow(own, prefixes, "item long, id long, component long, n long, rest long")
    mixed = kept.groupBy("item").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    x = kept.join(mixed.select("item"), "item")
    y = x.select("item", *[F.col(c).alias(f"{c}2") for c in ("id", "component", "n", "rest")])
    # intersection >= percent / (100 + percent) of both sizes
    enough = (100 + percent) * F.least("rest", "rest2") >= percent * (F.col("n") + F.col("n2"))
    return x.join(y, "item").where((F.col("component") > F.col("component2")) & enough).select(F.col("id").alias("a"), F.col("id2").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 75
) -> DataFrame:
    """Per row: id, size of its shingle set, smallest id reachable over links (itself included), and whether that is
    its own.

    Words are runs of bytes other than ASCII white space with A-Z lowered. Rows without words are linked with nothing.
    Rows with a null id are linked with nothing and kept, without a component. Rows that repeat an id are one document:
    they are linked, and all of them are kept if the id is.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketched_at, members_at, sets_at, apart_at = (scratch_path(spark, n) for n in ("sketches", "buckets", "sets", "apart"))
    sketch_documents(rows, words).write.parquet(sketched_at)
    sketched = spark.read.parquet(sketched_at)
    linkable = sketched.where("doc_id IS NOT NULL AND n_shingles > 0")
    # equal sets: one member stands for all
    whole = linkable.groupBy("key1", "key2").agg(
        F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")
    )
    banded = whole.select("id", "n", F.explode("bands").alias("band"))
    crowded = banded.groupBy("band").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("many")).where("many > 1")
    banded.join(crowded.select("band", "least"), "band").write.parquet(members_at)
    members = spark.read.parquet(members_at)
    ids = members.select("id").distinct()
    texts = rows.where("doc_id IS NOT NULL AND text IS NOT NULL")
    wanted = F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids
    held = texts.join(wanted, F.col("doc_id") == F.col("id"), "left_semi")
    shingle_arrays(held, words).write.parquet(sets_at)
    sets = spark.read.parquet(sets_at)
    first = members.where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b")).distinct()
    links = confirmed(first, sets, percent)
    # what equal sets and repeated ids link
    by_set = linkable.join(whole.select("key1", "key2", "id"), ["key1", "key2"])
    same = by_set.where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    joined = components(links.union(same))
    # members of one bucket that are still apart
    placed = members.join(joined, F.col("id") == F.col("node"), "left").select(
        "band", "id", F.coalesce("component", "id").alias("component")
    )
    apart = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    placed.join(apart.select("band"), "band").select("id", "component").distinct().write.parquet(apart_at)
    second = prefix_pairs(spark.read.parquet(apart_at), sets, percent)
    more = confirmed(second, sets, percent)
    all_links = more.union(joined.select(F.col("node").alias("a"), F.col("component").alias("b")))
    final = components(all_links)
    found = sketched.join(final, F.col("doc_id") == F.col("node"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return found.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 75) -> DataFrame:
    """``docs`` with one document of each group; all columns stay. The ids to drop are stored first."""
    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "near-copies")
    near_duplicates(docs, doc_id, text, words, percent).where("NOT kept").select(F.col("doc_id").alias("__id")).distinct().write.parquet(path)
    dropped = spark.read.parquet(path)
    dropped = F.broadcast(dropped) if dropped.count() <= BROADCAST_IDS else dropped
    return docs.join(dropped, docs[doc_id] == dropped["__id"], "left_anti")
