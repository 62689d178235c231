"""What the imputers share: rows in groups of settings, Arrow batches as matrices, and sums that merge in two levels.

A comparison or a set of folds fills many versions of one table. They stand in one frame, told apart by a column ``by`` of few
values, so that a round of an iterative imputer is one job for all of them.
"""

from __future__ import annotations

import math
import sys
import warnings
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from anchorline.session import cut_lineage

# executors need no copy of this package: what runs in tasks is sent along
cloudpickle.register_pickle_by_value(sys.modules[__name__])

GROUP, PATTERN = "__group", "__pattern"
PIECE = 4096  # numbers of a sum that travel in one row
ONE_LEVEL = 64  # tasks whose sums are merged at once
PART_BYTES, LEAST_ROWS = 32 << 20, 500


class NotSettled(UserWarning):
    """An iterative fit used all its rounds."""


def warn_unsettled(method: str, rounds: int, groups: list) -> None:
    if groups:
        named = "" if groups == [None] else f" for {groups}"
        warnings.warn(f"{method} did not settle in {rounds} rounds{named}", NotSettled, stacklevel=3)


def group_values(df: DataFrame, by: str | None) -> list:
    """The values of ``by``, one per version of the table; they are settings, so there are few. Null first."""
    if by is None:
        return [None]
    return sorted((r[0] for r in df.select(by).distinct().collect()), key=lambda v: (v is not None, v))


def group_number(by: str | None, values: list) -> Column:
    if by is None:
        return F.lit(0)
    out = F.lit(None).cast("int")
    for i, v in enumerate(values):
        out = F.when(F.col(by).eqNullSafe(F.lit(v)), i).otherwise(out)
    return out


def matrix_of(batch: pa.RecordBatch, columns: Sequence[str]) -> np.ndarray:
    """The columns as doubles, gaps as NaN."""
    return np.column_stack([np.asarray(batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False), float) for c in columns])


def with_matrix(batch: pa.RecordBatch, columns: Sequence[str], x: np.ndarray) -> pa.RecordBatch:
    """The batch with other values in ``columns``; every other column stays as it is, whatever its type."""
    names, arrays = batch.schema.names, list(batch.columns)
    for j, c in enumerate(columns):
        arrays[names.index(c)] = pa.array(x[:, j], from_pandas=True)
    return pa.RecordBatch.from_arrays(arrays, names=names)


def groups_of(batch: pa.RecordBatch) -> np.ndarray:
    """Group number of every row; -1 for a value of ``by`` that no fit has seen."""
    return np.asarray(pc.fill_null(batch.column(GROUP), -1).to_numpy(zero_copy_only=False))


def map_matrix(df: DataFrame, columns: Sequence[str], by: str | None, values: list, fill: Callable) -> DataFrame:
    """``fill(group, matrix)`` applied to the columns of every batch and group; rows of other groups stay. Narrow."""
    columns = list(columns)
    typed = df.withColumns({c: F.col(c).cast("double") for c in columns})
    marked = typed.withColumn(GROUP, group_number(by, values))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, group = matrix_of(batch, columns), groups_of(batch)
            for g in np.unique(group[group >= 0]):
                rows = group == g
                x[rows] = fill(int(g), x[rows])
            out = with_matrix(batch, columns, x)
            yield out.select([n for n in out.schema.names if n != GROUP])

    return marked.mapInArrow(go, typed.schema)


@dataclass
class Start:
    """Number of rows, and mean and deviation of the known cells, per group and column."""

    rows: np.ndarray
    known: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def scaled(self, group: int, x: np.ndarray) -> np.ndarray:
        return (x - self.centre[group]) / self.scale[group]

    def back(self, group: int, z: np.ndarray) -> np.ndarray:
        return z * self.scale[group] + self.centre[group]


def start_of(rows: DataFrame, columns: Sequence[str], groups: int) -> Start:
    """One aggregate with map-side combining; a column without known cells gets mean 0 and deviation 1."""
    d = len(columns)
    out = Start(np.zeros(groups, np.int64), np.zeros((groups, d), np.int64), np.zeros((groups, d)), np.ones((groups, d)))
    found = rows.groupBy(GROUP).agg(
        F.count(F.lit(1)), *[F.count(c) for c in columns], *[F.avg(c) for c in columns], *[F.stddev_pop(c) for c in columns]
    )
    for g, n, *rest in found.collect():
        out.rows[g], out.known[g] = n, rest[:d]
        out.centre[g] = [v or 0.0 for v in rest[d : 2 * d]]
        out.scale[g] = [v if v and math.isfinite(v) else 1.0 for v in rest[2 * d :]]
    return out


def arranged(df: DataFrame, columns: Sequence[str], by: str | None, values: list, patterns: bool = False) -> DataFrame:
    """Group number and columns of all rows, stored in partitions of bounded size.

    With ``patterns`` rows lacking the same cells lie together, so that a task solves once for all of them. They are spread
    by ranges, with a hash of the row as the last key, so that a frequent pattern covers many partitions.
    """
    rows = df.select(group_number(by, values).alias(GROUP), *[F.col(c).cast("double").alias(c) for c in columns])
    n = rows.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-n * len(columns) * 8 // PART_BYTES), min(cores, n // LEAST_ROWS))
    if not patterns:
        return cut_lineage(rows.repartition(int(parts)))
    lacking = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns])
    spread = rows.withColumn(PATTERN, lacking).withColumn("__spread", F.xxhash64(*columns))
    keys = [GROUP, PATTERN, "__spread"]
    return cut_lineage(spread.repartitionByRange(int(parts), *keys).sortWithinPartitions(*keys).select(GROUP, *columns))


def triangle(d: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(d)


def squared(upper: np.ndarray, d: int) -> np.ndarray:
    """A symmetric matrix from its upper triangle."""
    out = np.zeros((d, d))
    out[triangle(d)] = upper
    return out + np.triu(out, 1).T


def summed(rows: DataFrame, columns: Sequence[str], partial: Callable) -> dict[tuple[int, int], np.ndarray]:
    """Vectors added up over all tasks, by (group, name).

    ``partial`` gets an iterator of (group, matrix) and returns a task's vectors by (group, name). They travel in pieces,
    each by itself; with many tasks these are merged in two levels, so no reducer gets more than about the root of
    their number of one piece.
    """
    columns = list(columns)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        def matrices() -> Iterator[tuple[int, np.ndarray]]:
            for batch in batches:
                x, group = matrix_of(batch, columns), groups_of(batch)
                for g in np.unique(group):
                    yield int(g), x[group == g]

        task = TaskContext.get().partitionId()
        for (group, name), vector in partial(matrices()).items():
            for piece, at in enumerate(range(0, len(vector), PIECE)):
                values = pa.array([vector[at : at + PIECE]], pa.list_(pa.float64()))
                head = [pa.array([v], pa.int32()) for v in (group, name, piece, task)]
                yield pa.RecordBatch.from_arrays([*head, values], names=["g", "name", "piece", "task", "amounts"])

    parts = rows.mapInArrow(go, "g int, name int, piece int, task int, amounts array<double>")
    vectors = parts.select("g", "name", "piece", "task", array_to_vector("amounts").alias("amounts"))
    tasks = rows.rdd.getNumPartitions()
    if tasks > ONE_LEVEL:
        shelf = F.pmod("task", F.lit(math.isqrt(tasks)))
        vectors = vectors.groupBy("g", "name", "piece", shelf.alias("shelf")).agg(Summarizer.sum(F.col("amounts")).alias("amounts"))
    total = vectors.groupBy("g", "name", "piece").agg(Summarizer.sum(F.col("amounts")).alias("amounts"))
    found: dict[tuple[int, int], list] = {}
    for row in total.collect():
        found.setdefault((row["g"], row["name"]), []).append((row["piece"], row["amounts"].toArray()))
    return {key: np.concatenate([v for _, v in sorted(pieces, key=lambda p: p[0])]) for key, pieces in found.items()}
