"""Distinct members of a group, as rows.

A group may hold a large share of all rows, so its distinct values never meet in one task or one row: they are
de-duplicated by (group, kind, member), which spreads a hot group over the cluster, and stay rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def member_rows(df: DataFrame, keys: list[str], kinds: Mapping[str, Column]) -> DataFrame:
    """Distinct (keys, kind, member) for every non-empty member."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("string").alias("member"))
                      for k, c in kinds.items()])
    return (df.select(*keys, F.explode(F.filter(pairs, lambda p: p["member"] != "")).alias("m"))
            .select(*keys, "m.kind", "m.member").distinct())
