"""Approximate nearest neighbours by cosine over shifted space-filling curves.

Unit vectors are projected onto a few random directions, shifted, cut into a grid and numbered along a Hilbert curve;
each of ``CURVES`` projections gives another order of all vectors. The orders are range-partitioned and ranked by Spark.
A query's candidates are the vectors within a window of ranks around it on every curve: blocks of ranks meet the queries
whose windows touch them, and the best of all blocks and curves are merged and ranked by the exact measure.

The window is not fixed: the true neighbours of a bounded sample of queries are found by brute force, and the window is
the narrowest that holds ``TARGET`` of them on at least one curve. On vectors with little structure it gets wide.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from anchorline.llm.frames import map_arrow, parts
from anchorline.llm.samples import MANY
from anchorline.session import scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CURVES, AXES, BITS = 16, 8, 7
BLOCK, QUERIES_AT_ONCE = 4096, 4096
SAMPLE_VECTORS, SAMPLE_QUERIES = 4096, 160  # bounds of what the index is fitted on
TARGET = 0.95
SLICE = 8192


def hilbert_keys(grid: np.ndarray, bits: int) -> np.ndarray:
    """Place of each grid point (points x axes, values below 2**bits) along the Hilbert curve, as one integer.

    The coordinates are turned into the curve's transposed index by undoing the rotations and reflections of its cells
    from the coarsest to the finest level, and the bits are then interleaved.
    """
    x = [grid[:, i].astype(np.uint64) for i in range(grid.shape[1])]
    for level in range(bits - 1, 0, -1):
        bit, below = np.uint64(1 << level), np.uint64((1 << level) - 1)
        for i in range(len(x)):
            inside = (x[i] & bit) != 0
            swap = np.where(inside, np.uint64(0), (x[0] ^ x[i]) & below)
            x[i] = x[i] ^ swap
            x[0] = x[0] ^ np.where(inside, below, swap)
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip = np.where((x[-1] & np.uint64(1 << level)) != 0, flip ^ np.uint64((1 << level) - 1), flip)
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << np.uint64(1)) | (((axis ^ flip) >> np.uint64(level)) & np.uint64(1))
    return key.astype(np.int64)


class Curves:
    """Random projections with shifted grids, fitted to a sample of unit vectors."""

    def __init__(self, sample: np.ndarray, curves: int = CURVES, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.axes = min(AXES, sample.shape[1])
        self.turns, self.low, self.step = [], [], []
        for _ in range(curves):
            turn = np.linalg.qr(rng.normal(size=(sample.shape[1], sample.shape[1])))[0][:, : self.axes]
            seen = sample @ turn
            low, high = np.quantile(seen, 0.001, axis=0), np.quantile(seen, 0.999, axis=0)
            step = np.maximum((high - low) / (2**BITS - 1), 1e-12)
            self.turns.append(turn)
            self.low.append(low - rng.uniform(0, 1, self.axes) * step)
            self.step.append(step)

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """Curves x vectors."""
        out = []
        for turn, low, step in zip(self.turns, self.low, self.step, strict=True):
            out.append(hilbert_keys(np.clip((unit @ turn - low) / step, 0, 2**BITS - 1), BITS))
        return np.stack(out)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long lists as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def level(vectors: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component near 1: no square overflows or vanishes, and
    no digit of a cosine changes."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True, initial=0.0))[1])


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = level(vectors)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, so that a pair's value does not depend on what stands beside it."""
    a, b = level(a), level(b)
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def best_of(query_ids, queries, ids, vectors, k: int, allowed=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of ``vectors`` for each query (all three: query number, candidate number, cosine)."""
    out: list[tuple] = []
    plain = unit(queries) @ unit(vectors).T
    plain[query_ids[:, None] == ids[None]] = -np.inf
    if allowed is not None:
        plain[~allowed] = -np.inf
    for q, row in enumerate(plain):
        room = min(k, int(np.isfinite(row).sum()))
        if not room:
            continue
        least = np.partition(row, len(row) - room)[len(row) - room]
        near = np.flatnonzero(row >= least - 1e-9)  # ties may differ in the last bits here
        score = cosine(np.broadcast_to(queries[q], (len(near), queries.shape[1])), vectors[near])
        first = np.lexsort((ids[near], -score))[:room]
        out.append((np.full(room, q), near[first], score[first]))
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def usable_vectors(table: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, vector) of the vectors that take part; see ``nearest``."""
    v = F.col("vector")
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector")).where("vec_id IS NOT NULL")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(v.isNotNull() & F.coalesce(sound, F.lit(False)) & F.exists(v, lambda x: x != 0))
    size = rows.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.where(F.size(v) == (size["d"] if size else -1))
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def _bounded(rows: DataFrame, most: int, count: int) -> DataFrame:
    share = min(MANY, int(MANY * (2.0 * most + 50) / max(count, 1)))
    draw = F.xxhash64("vec_id", F.lit("curves"))
    return rows.where(F.pmod(draw, F.lit(MANY)) < share).orderBy(draw, "vec_id").limit(most)


def true_neighbours(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(query, neighbour) by brute force for a few queries that travel with the task."""

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, SLICE):
                part = batch.slice(a, SLICE)
                own = part.column(0).to_numpy()
                q, c, score = best_of(ids, queries, own, matrix(part.column(1)), k)
                yield pa.RecordBatch.from_pydict({"query_id": ids[q], "vec_id": own[c], "score": score})

    found = map_arrow(vectors, search, "query_id long, vec_id long, score double")
    return [(r[0], r[1]) for r in _top(found, k).select("query_id", "vec_id").collect()]


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best per query; a query has at most k rows per block and curve."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked_orders(vectors: DataFrame, curves: Curves, count: int, is_query: Column) -> DataFrame:
    """(curve, rank, vec_id, vector, is_query): every vector once per curve, ranked along it from 0."""

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, SLICE):
                part = batch.slice(a, SLICE)
                for curve, keys in enumerate(curves.keys(unit(matrix(part.column(1))))):
                    yield pa.RecordBatch.from_pydict(
                        {"curve": pa.array([curve] * len(keys), pa.int32()), "key": keys, "vec_id": part.column(0), "vector": part.column(1)}
                    )

    kind = dict(vectors.dtypes)["vector"]
    keyed = map_arrow(vectors, number, f"curve int, key long, vec_id long, vector {kind}")
    spark, path = vectors.sparkSession, scratch_path(vectors.sparkSession, "curves")
    order = ["curve", "key", "vec_id"]
    sorted_rows = keyed.repartitionByRange(parts(count * CURVES, 4 * BLOCK), *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()  # partition in the upper bits, place in the lower 33
    sorted_rows.select("*", place.alias("place")).write.parquet(path)  # ranks must not change if a task is run again
    stored = spark.read.parquet(path).withColumn("part", F.shiftright("place", 33))
    sizes = stored.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) - F.col("curve") * F.lit(count)
    return stored.join(offsets, "part").select("curve", rank.cast("long").alias("rank"), "vec_id", "vector", is_query.alias("is_query"))


def fit_window(orders: DataFrame, pairs: list[tuple[int, int]], count: int, target: float) -> int:
    """The half width, in ranks, that holds ``target`` of the pairs on at least one curve."""
    ids = sorted({i for p in pairs for i in p})
    few = orders.sparkSession.createDataFrame([(i,) for i in ids], "vec_id long")
    ranks: dict[int, dict[int, int]] = {}
    for r in orders.join(F.broadcast(few), "vec_id").select("vec_id", "curve", "rank").collect():
        ranks.setdefault(r[0], {})[r[1]] = r[2]
    gaps = [min(abs(ranks[a][c] - ranks[b][c]) for c in ranks[a]) for a, b in pairs]
    return int(np.quantile(gaps, target, method="higher")) + 1 if gaps else count


def nearest(
    table: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", target: float = TARGET
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row that ``is_query`` (over ``vec_id``) names.

    Vectors that are null, zero, hold null or non-finite components, have no id or another length than most take no
    part. Rows that repeat an id count once; the smallest vector stands. Ties go to the smaller id. With fewer than k
    candidates all are returned; an empty table gives no rows.
    """
    spark = table.sparkSession
    path = scratch_path(spark, "vectors")
    usable_vectors(table, vec_id, vector).write.parquet(path)
    vectors = spark.read.parquet(path)
    count = vectors.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not count:
        return spark.createDataFrame([], schema)
    sample = np.array([r[0] for r in _bounded(vectors, SAMPLE_VECTORS, count).select("vector").collect()], float)
    curves = Curves(unit(sample))
    orders = ranked_orders(vectors, curves, count, is_query)
    asked = vectors.where(is_query)
    few = _bounded(asked, SAMPLE_QUERIES, asked.count()).collect()
    if not few:
        return spark.createDataFrame([], schema)
    pairs = true_neighbours(vectors, np.array([r[0] for r in few]), np.array([r[1] for r in few], float), k)
    width = max(k, fit_window(orders, pairs, count, target))
    # a block meets at most about this many queries; more are dealt into chunks
    chunks = parts(asked.count() * min(count, 2 * width + BLOCK), count * QUERIES_AT_ONCE)
    block = (F.col("rank") / BLOCK).cast("long")
    blocks = orders.select("curve", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "rank", "vec_id", "vector")
    lo, hi = F.greatest(F.col("rank") - width, F.lit(0)), F.least(F.col("rank") + width, F.lit(count - 1))
    wanted = orders.where("is_query").select(
        F.col("curve").alias("q_curve"), F.explode(F.sequence((lo / BLOCK).cast("long"), (hi / BLOCK).cast("long"))).alias("q_block"),
        F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int").alias("q_chunk"), F.col("rank").alias("q_rank"),
        F.col("vec_id").alias("q_id"), F.col("vector").alias("q_vector"),
    )

    def search(key: tuple, candidates: pa.Table, queries: pa.Table) -> pa.Table:
        if not candidates.num_rows or not queries.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, vectors = candidates.column("vec_id").to_numpy(), matrix(candidates.column("vector"))
        ranks, out = candidates.column("rank").to_numpy(), []
        for a in range(0, queries.num_rows, 256):
            part = queries.slice(a, 256)
            own = part.column("q_id").to_numpy()
            near = np.abs(part.column("q_rank").to_numpy()[:, None] - ranks[None]) <= width
            q, c, score = best_of(own, matrix(part.column("q_vector")), ids, vectors, k, near)
            out.append((own[q], ids[c], score))
        q, c, s = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"query_id": q, "vec_id": c, "score": s})

    at_block, by_query = blocks.groupBy("curve", "block", "chunk"), wanted.groupBy("q_curve", "q_block", "q_chunk")
    found = at_block.cogroup(by_query).applyInArrow(search, "query_id long, vec_id long, score double")
    return _top(found, k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
