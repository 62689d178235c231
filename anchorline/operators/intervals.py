"""Join time points to the intervals that contain them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from anchorline.functions.times import epoch_hours

SLOT = "__slot"


def _slot(time: Column, slot_hours: int) -> Column:
    return F.floor(epoch_hours(time) / F.lit(float(slot_hours)))


def point_in_interval_join(
    points: DataFrame,
    intervals: DataFrame,
    on: Sequence[str],
    at: str,
    start: str,
    end: str,
    closed: bool,
    how: str = "inner",
    slot_hours: int = 120,
    salts: int = 1,
) -> DataFrame:
    """Equi join on ``on`` plus ``start <= at <= end`` (strict when not ``closed``).

    Joining on the key alone pairs every point of a hot key with every interval of it before the
    range test. Here time is cut into slots: an interval is repeated for the slots it touches, a point
    lies in exactly one, and the slot joins the equi key. A key holding a third of the rows is spread
    over its slots, each pair meets once, and a left join keeps its meaning. ``salts`` splits the
    points of a single hot (key, slot) further at the price of repeating the intervals; below that the
    skew join of adaptive execution splits what is still too large.
    """
    touched = (
        intervals.where(F.col(start) <= F.col(end))
        .withColumnsRenamed({c: f"__on_{c}" for c in on})
        .withColumn(
            "__on_slot", F.explode(F.sequence(_slot(F.col(start), slot_hours), _slot(F.col(end), slot_hours)))
        )
    )
    placed = points.withColumn(SLOT, _slot(F.col(at), slot_hours))
    match = F.col(SLOT) == F.col("__on_slot")
    for c in on:
        match = match & (placed[c] == touched[f"__on_{c}"])
    if salts > 1:
        touched = touched.withColumn("__on_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        placed = placed.withColumn("__salt", F.pmod(F.xxhash64(*points.columns), F.lit(salts)).cast("int"))
        match = match & (F.col("__salt") == F.col("__on_salt"))
    if closed:
        match = match & (F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))
    else:
        match = match & (F.col(at) > F.col(start)) & (F.col(at) < F.col(end))
    joined = placed.join(touched, match, how)
    return joined.drop(SLOT, "__on_slot", "__salt", "__on_salt", *[f"__on_{c}" for c in on])
