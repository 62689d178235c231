"""Bounded samples of labelled rows, from which classifiers are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

MANY = 1 << 30


def bounded_sample(rows: DataFrame, group: str, identity: list[str], each: int) -> DataFrame:
    """At most ``each`` rows per value of ``group``, picked by a hash of ``identity``.

    The counts per value are read first, and a hash filter leaves about twice the wanted number before rows are
    ranked, so no task ranks a whole group. ``group`` has few values (classes), as a classifier needs; rows
    without one are left out.
    """
    rows = rows.where(F.col(group).isNotNull())
    counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).collect()
    if not counts:
        return rows.limit(0)
    shares = F.create_map(*[F.lit(x) for r in counts for x in (r[0], min(MANY, int(MANY * (2.0 * each + 50) / r["n"])))])
    draw = F.xxhash64(*identity, F.lit("sample"))
    few = rows.where(F.pmod(draw, F.lit(MANY)) < F.element_at(shares, F.col(group)))
    ranked = few.withColumn("__rank", F.row_number().over(Window.partitionBy(group).orderBy(draw, *identity)))
    return ranked.where(F.col("__rank") <= each).drop("__rank")
