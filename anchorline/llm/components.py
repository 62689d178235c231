"""Connected components of a graph given as a frame of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from anchorline.session import cut_lineage


def _stars(pairs: DataFrame, large: bool) -> DataFrame:
    """Link neighbours of a node to the smallest of them: the larger neighbours, or the smaller ones and the node."""
    if large:
        near = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root"))
    joined = near.join(least, F.col("a") == F.col("node"))
    if large:
        linked = joined.where("b > a").select(F.col("b").alias("a"), F.col("root").alias("b"))
    else:
        linked = joined.select(F.col("b").alias("a"), F.col("root").alias("b")).union(
            least.select(F.col("node").alias("a"), F.col("root").alias("b"))
        )
    return linked.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); a component is named by its smallest node.

    Self loops and repeated edges do no harm; nodes without edges do not appear. The smallest neighbour of a node comes
    from a map-side combined aggregate, so a hub does not meet in one task. Every round is checkpointed; the number of
    rounds grows with the logarithm of the longest path.
    """
    pairs = cut_lineage(edges.select("a", "b").where("a <> b").distinct())
    seen = None
    while True:
        pairs = cut_lineage(_stars(_stars(pairs, True), False))
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
