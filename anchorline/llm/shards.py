"""Sharding by histogram sort.

Rows are ordered by a 64-bit hash of their key columns. Splitters between shards are found by counting, exactly and
across all partitions, the bytes below a set of probes, and by placing finer probes where a splitter still misses its
target. Only the sums per probe interval reach the driver (at most ``shards * probes`` numbers a round). Rows move
once, when the splitters are known.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

LOW, HIGH = -(2**63), 2**63 - 1
ROWS_PER_CELL = 1_000_000


def interval_of(key: Column, probes: list[int]) -> Column:
    """Number of probes that are <= ``key``: a binary search over a literal array (probes ascending)."""
    if not probes:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(probes).bit_length()))]
    cuts = F.array(*[F.lit(p).cast("long") for p in probes])

    def advance(low: Column, step: Column) -> Column:
        return F.when(F.get(cuts, low + step - 1) <= key, low + step).otherwise(low)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), advance)


def _below(keyed: DataFrame, probes: list[int], weight: str) -> tuple[list[tuple[int, int]], tuple[int, int]]:
    """(Weight, rows) strictly below each probe, and of the whole frame."""
    found = (
        keyed.groupBy(interval_of(F.col("__key"), probes).alias("i"))
        .agg(F.sum(weight).alias("w"), F.count(F.lit(1)).alias("n"))
        .collect()
    )
    each = [(0, 0)] * (len(probes) + 1)
    for r in found:
        each[r["i"]] = (int(r["w"] or 0), r["n"])
    upto = list(accumulate(each, lambda x, y: (x[0] + y[0], x[1] + y[1])))
    return upto[:-1], upto[-1]


def find_splitters(
    keyed: DataFrame, shards: int, weight: str = "__weight", tolerance: float = 1e-3, probes: int = 8
) -> list[int]:
    """The keys that begin shards 1 .. shards-1 of a frame with ``__key`` and a weight column.

    A splitter is settled when the weight below it differs from its target by at most ``tolerance`` of a shard, or
    when at most one row or one key is left between its bounds; then the nearer bound is taken.
    """
    _, whole = _below(keyed, [], weight)
    total = whole[0]
    targets = [total * j / shards for j in range(1, shards)]
    known = {LOW: (0, 0), HIGH: whole}
    slack = tolerance * total / shards
    while True:
        ordered = sorted(known)
        below = [known[k][0] for k in ordered]
        wanted: set[int] = set()
        for t in targets:
            at = bisect_right(below, t)
            lo, hi = ordered[max(at - 1, 0)], ordered[min(at, len(ordered) - 1)]
            near = min(abs(known[lo][0] - t), abs(known[hi][0] - t)) <= slack
            if not near and hi - lo > 1 and known[hi][1] - known[lo][1] > 1:
                wanted |= {lo + (hi - lo) * i // (probes + 1) for i in range(1, probes + 1)} - {lo, hi}
        if not wanted:
            break
        asked = sorted(wanted)
        known |= dict(zip(asked, _below(keyed, asked, weight)[0], strict=True))
    ordered = sorted(known)
    return sorted(min(ordered, key=lambda k: abs(known[k][0] - t)) for t in targets)


def histogram_sort(
    df: DataFrame, weight: str, key: list[str], shards: int = 24, tolerance: float = 1e-3
) -> DataFrame:
    """Add ``shard`` (0 .. shards-1) and ``slot`` (gapless from 0 in each shard) so that the sums of ``weight`` are
    near equal.

    All columns of ``df`` are kept; columns named ``shard`` or ``slot`` are replaced. Rows equal in all ``key``
    columns cannot be parted, so ``key`` should hold something that tells rows apart. A null weight counts 0, null
    keys are ordinary values, and an empty frame gives an empty result. ``df`` is read once per round of probes, so
    hand in a narrow, stored frame where that matters.
    """
    own = df.select(F.struct("*").alias("__row"), F.xxhash64(*key).alias("__key"), F.col(weight).alias("__weight"))
    splitters = find_splitters(own, shards, "__weight", tolerance)
    # Each shard is cut into cells of about a million rows, so that no task numbers a whole shard.
    cells_each = max(1, -(-own.count() // (shards * ROWS_PER_CELL)))
    edges = [LOW, *splitters, HIGH]
    cuts = sorted({lo + (hi - lo) * i // cells_each for lo, hi in zip(edges, edges[1:], strict=False) for i in range(cells_each)})
    placed = own.withColumn("__cell", interval_of(F.col("__key"), cuts)).withColumn(
        "__shard", interval_of(F.col("__key"), splitters)
    )
    counts = placed.groupBy("__shard", "__cell").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy("__shard").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("__shard", "__cell", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__shard", "__cell").orderBy("__key")
    numbered = placed.withColumn("__in", F.row_number().over(inside) - 1)
    kept = [F.col("__row")[c].alias(c) for c in df.columns if c not in ("shard", "slot")]
    return numbered.join(before, ["__shard", "__cell"]).select(
        *kept, F.col("__shard").alias("shard"), (F.col("__in") + F.col("__before")).cast("long").alias("slot")
    )
