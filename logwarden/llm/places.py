"""Where matches of a pattern lie, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hits(text: Column, pattern: Column, size: Callable[[Column], Column], **more: Callable[[Column, Column, Column], Column]) -> Column:
    """The matches of ``pattern`` in order, as structs of ``gap`` (size of the text since the last one) and ``size``.

    ``more`` adds fields, each from (what lies before, the match, what lies after up to the next match). Empty where
    nothing matches. Matches must not be empty.
    """
    found, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    pairs = F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("before"), found.alias("match"),
                         F.slice(between, F.lit(2), F.size(found)).alias("after"))
    made = F.transform(pairs, lambda p: F.struct(
        size(p["before"]).alias("gap"), size(p["match"]).alias("size"),
        *(f(p["before"], p["match"], p["after"]).alias(name) for name, f in more.items())))
    return F.when(F.size(found) > 0, made)


def placed(rows: DataFrame, keys: list[str], column: str = "hits") -> DataFrame:
    """A row for each hit of each key: ``start`` and ``end``, and the other fields of the hit.

    Rows that repeat a key must have the same hits and count once. Offsets are running sums over the hits of a key, so the
    work is linear in them; only gaps, sizes and fields are shuffled, never texts.
    """
    once = rows.groupBy(*keys).agg(F.first(column).alias(column))
    each = once.select(*keys, F.posexplode(column).alias("nth", "hit"))
    so_far = Window.partitionBy(*keys).orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum((F.col("hit.gap") + F.col("hit.size")).cast("long")).over(so_far)
    return (each.withColumn("end", end).withColumn("start", F.col("end") - F.col("hit.size"))
            .select(*keys, "start", "end", "hit.*").drop("gap", "size"))
