"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.llm.common import staged


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b) that is not its component's smallest, which is the root.

    Each round ties larger neighbours of a node to its smallest neighbour, then smaller ones, until nothing changes;
    the number of rounds grows with the logarithm of the longest path. Minima are combined before the shuffle, and the
    joins back to the edges are plain ones that adaptive execution splits at nodes with many edges. Every round is a
    written table, so a lost executor costs one round at most. Loops are dropped, edges may repeat, null ends are
    ignored, no edges give no rows.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    pairs = staged(pairs.filter("u > v").distinct(), "edges")
    before = _state(pairs)
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(lower, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(lower.select("u", F.col("m").alias("v"))))
        pairs = staged(small.distinct(), "edges")
        after = _state(pairs)
        if after == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after


def _state(pairs: DataFrame) -> tuple:
    """A count and an order-free digest: equal for equal edge sets."""
    return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
