"""MLlib's perceptron fitted with matrix products in tasks.

The loss, its start and the steps are those of MLlib's estimator: the mean over stacks of rows of their mean cross entropy, weights
drawn from its seed, and limited-memory BFGS with a strong Wolfe line search, so that what is found differs by rounding only. A
pass over the rows is a job whose tasks work on some hundred rows at a time, which takes a fraction of the estimator's time.
"""

from __future__ import annotations

import sys
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, functions as F

# executors need no copy of this package: what runs in tasks is sent along
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STACKS_HELD, STACKS_AT_ONCE = 256, 2  # stacks of rows that lie in one block, and that are worked on at once, in a core's cache
ONE_LEVEL = 64  # tasks whose sums are added on the driver at once
CORRECTIONS, MEMORY = 10, 10
LEAST_DROP, LEAST_TURN, TRIES = 1e-4, 0.9, 10  # of the line search


class NoStep(Exception):
    """The line search found none."""


def passed(weights: np.ndarray, layers: list[int], x: np.ndarray, y: np.ndarray, share: np.ndarray) -> tuple[float, np.ndarray]:
    """Loss and gradient over some rows, each with its share. A layer's weights lie input by input, before its offsets."""
    parts, at = [], 0
    for wide, out in zip(layers, layers[1:]):
        parts.append((weights[at : at + wide * out].reshape(wide, out), weights[at + wide * out : at + (wide + 1) * out]))
        at += (wide + 1) * out
    outputs = [x]
    for k, (w, offset) in enumerate(parts):
        z = outputs[-1] @ w
        z += offset
        if k + 1 < len(parts):
            np.negative(z, out=z)
            with np.errstate(over="ignore"):
                np.exp(z, out=z)
            z += 1.0
            np.reciprocal(z, out=z)
        else:
            z -= z.max(axis=1, keepdims=True)
            np.exp(z, out=z)
            z /= z.sum(axis=1, keepdims=True)
        outputs.append(z)
    rows = np.arange(len(y))
    delta = outputs.pop()
    with np.errstate(divide="ignore"):
        loss = -float(np.log(delta[rows, y]) @ share)
    delta[rows, y] -= 1.0
    delta *= share[:, None]
    gradient = np.empty_like(weights)
    for (w, _), before in zip(reversed(parts), reversed(outputs)):
        wide, out = w.shape
        gradient[at - out : at] = delta.sum(axis=0)
        gradient[at - (wide + 1) * out : at - out] = (before.T @ delta).reshape(-1)
        at -= (wide + 1) * out
        if at:
            delta = delta @ w.T
            slope = before * before
            np.subtract(before, slope, out=slope)
            delta *= slope
    return loss, gradient


def direction(gradient: np.ndarray, steps: deque, turns: deque) -> np.ndarray:
    """The quasi-Newton direction from the last steps and changes of the gradient, newest first."""
    out, shares, products = gradient.copy(), [], []
    scale = 1.0
    if steps:
        along = steps[0] @ turns[0]
        if not along >= 0:
            raise NoStep("curvature")
        scale = along / (turns[0] @ turns[0])
    for step, turn in zip(steps, turns):
        products.append(step @ turn)
        shares.append((step @ out) / products[-1])
        if np.isnan(shares[-1]):
            raise NoStep("history")
        out -= shares[-1] * turn
    out *= scale
    for step, turn, share, product in reversed(list(zip(steps, turns, shares, products))):
        out += (share - (turn @ out) / product) * step
    return -out


def _between(left: tuple, right: tuple) -> float:
    """Where a cubic through two points (place, value, slope) is least, not too near to either."""
    (a, fa, da), (b, fb, db) = left, right
    with np.errstate(all="ignore"):
        d1 = da + db - 3 * (fa - fb) / (a - b)
        d2 = np.sqrt(d1 * d1 - da * db)
        t = b - (b - a) * (db + d2 - d1) / (db - da + 2 * d2)
    low, high = a + 0.1 * (b - a), a + 0.9 * (b - a)
    return low if t < low else high if t > high else t


def line_search(along: Callable[[float], tuple[float, float]], t: float) -> float:
    """A step that lowers the value and turns the slope enough (strong Wolfe conditions)."""
    start, slope = along(0.0)
    if slope > 0:
        raise NoStep("no descent")

    def zoom(low: tuple, high: tuple) -> float:
        for _ in range(TRIES):
            at = _between(high, low) if low[0] > high[0] else _between(low, high)
            here = (at, *along(at))
            if here[1] > start + LEAST_DROP * at * slope or here[1] >= low[1]:
                high = here
            else:
                if abs(here[2]) <= LEAST_TURN * abs(slope):
                    return at
                if here[2] * (high[0] - low[0]) >= 0:
                    high = low
                low = here
        raise NoStep("zoom")

    low = (0.0, start, slope)
    for i in range(TRIES):
        here = (t, *along(t))
        if not np.isfinite(here[1]):
            t /= 2
            continue
        if here[1] > start + LEAST_DROP * t * slope or (here[1] >= low[1] and i > 0):
            return zoom(low, here)
        if abs(here[2]) <= LEAST_TURN * abs(slope):
            return t
        if here[2] >= 0:
            return zoom(here, low)
        low, t = here, t * 1.5
    raise NoStep("line")


def minimised(cost: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int, tolerance: float) -> np.ndarray:
    """Where limited-memory BFGS ends from ``x``: after so many rounds, or once values or gradients hardly change any more."""
    last: list = [None, None]

    def at(point: np.ndarray) -> tuple[float, np.ndarray]:
        if last[0] is None or not np.array_equal(last[0], point):
            last[:] = point, cost(point)
        return last[1]

    value, gradient = at(x)
    first, values, failed, n = value, deque([np.inf], MEMORY), False, 0
    steps, turns = deque(maxlen=CORRECTIONS), deque(maxlen=CORRECTIONS)

    def ended() -> bool:
        same = len(values) >= 2 and abs(value - max(values)) <= tolerance * abs(first)
        return n >= rounds or same or np.linalg.norm(gradient) <= max(tolerance * value, 1e-8)

    while not ended():
        try:
            way = direction(gradient, steps, turns)

            def along(t: float) -> tuple[float, float]:
                v, g = at(x + way * t)
                return v, float(g @ way)

            step = line_search(along, 1.0 / np.linalg.norm(way) if n == 0 else 1.0)
            if step * np.linalg.norm(gradient) < 1e-10:
                raise NoStep("underflow")
        except NoStep:
            if failed:
                break
            failed = True
            steps.clear()
            turns.clear()
            continue
        failed, new = False, x + way * step
        value, after = at(new)
        steps.appendleft(new - x)
        turns.appendleft(after - gradient)
        x, gradient, n = new, after, n + 1
        values.append(value)
    return x


def fit_perceptron(estimator: MultilayerPerceptronClassifier, df: DataFrame) -> MultilayerPerceptronClassificationModel:
    """The estimator's model of all rows, in the partitions that they have."""
    spark, layers, size = df.sparkSession, list(estimator.getLayers()), estimator.getBlockSize()
    features, label = estimator.getFeaturesCol(), estimator.getLabelCol()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, most = [], size * STACKS_HELD

        def told(some: pa.Table) -> pa.RecordBatch:
            x = some.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            y = some.column("y").to_numpy().astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in (x, y)], ["x", "y"])

        for batch in batches:
            waiting.append(batch)
            while sum(b.num_rows for b in waiting) >= most:
                rows = pa.Table.from_batches(waiting)
                yield told(rows.slice(0, most))
                waiting = rows.slice(most).to_batches()
        if sum(b.num_rows for b in waiting):
            yield told(pa.Table.from_batches(waiting))

    plain = df.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"))
    blocks = plain.mapInArrow(pack, "x binary, y binary").rdd.map(lambda r: (bytes(r[0]), bytes(r[1]))).persist(StorageLevel.MEMORY_AND_DISK)

    def cost(weights: np.ndarray) -> tuple[float, np.ndarray]:
        held = spark.sparkContext.broadcast(weights)

        def add(some: Iterator[tuple[bytes, bytes]]) -> Iterator[tuple[int, float, np.ndarray]]:
            stacks, loss, gradient = 0, 0.0, np.zeros(len(held.value))
            for told, labels in some:
                x, y = np.frombuffer(told, float).reshape(-1, layers[0]), np.frombuffer(labels, np.int64)
                for first in range(0, len(y), size * STACKS_AT_ONCE):
                    here = slice(first, min(len(y), first + size * STACKS_AT_ONCE))
                    n = here.stop - here.start
                    share = np.full(n, 1.0 / size)
                    if n % size:
                        share[n - n % size :] = 1.0 / (n % size)
                    found = passed(held.value, layers, x[here], y[here], share)
                    stacks, loss = stacks - (-n // size), loss + found[0]
                    gradient += found[1]
            yield stacks, loss, gradient

        sums = blocks.mapPartitions(add)
        both = lambda a, b: (a[0] + b[0], a[1] + b[1], a[2] + b[2])
        stacks, loss, gradient = sums.reduce(both) if blocks.getNumPartitions() <= ONE_LEVEL else sums.treeReduce(both)
        held.destroy()
        return loss / stacks, gradient / stacks

    # MLlib draws the first weights, and makes the model of the last ones; neither looks at the rows it is given
    few = spark.createDataFrame([(DenseVector([0.0] * layers[0]), float(y)) for y in range(layers[-1])], [features, label])
    first = estimator.copy({estimator.maxIter: 0}).fit(few).weights.toArray()
    found = minimised(cost, first, estimator.getMaxIter(), estimator.getTol())
    blocks.unpersist()
    return estimator.copy({estimator.maxIter: 0, estimator.initialWeights: DenseVector(found)}).fit(few)
