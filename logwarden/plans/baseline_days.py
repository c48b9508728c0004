"""A baseline store of whole days: value counts per day and metric, from which any range of days gives its baseline without
reading a window again.

Two parts hold what a day's windows contribute. ``histogram`` counts each value of a metric on a day. ``shares`` counts the
same for each target, so that targets found to be of high risk later can be taken out of days already filed. Rows of shares
lie in order of ``slot``, a number of the target, and an exclusion reads the row groups of its slots only. A day filed again
(after late logs, say) replaces what was filed for it; files of other days are never touched. Commits, versions and the one
writer are those of ``sources/sinks.py``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logwarden.config import Config
from logwarden.operators.baseline import all_metrics, histogram_distributions, metric_values
from logwarden.sources.sinks import Snapshot, write_commit

SLOTS = 256
PARTS = {"days": "day date, windows bigint", "histogram": "day date, metric string, value bigint, c bigint",
         "shares": "day date, slot int, target_id string, metric string, value bigint, c bigint"}


def _slot(target: Column) -> Column:
    """Nulls have a slot too; no exclusion names them."""
    return F.pmod(F.xxhash64(target), F.lit(SLOTS)).cast("int")


def _day(win: Column) -> Column:
    """The UTC day of an epoch second, whatever the session's time zone."""
    return F.date_add(F.lit(dt.date(1970, 1, 1)), F.floor(win / 86400).cast("int"))


def day_parts(users: DataFrame, ips: DataFrame, first: dt.date, last: dt.date) -> dict[str, DataFrame]:
    """Rows of the store for the days ``first`` to ``last``, from their windows. All lengths nest in a UTC day."""
    def within(df: DataFrame) -> DataFrame:
        lo, hi = (int(dt.datetime(d.year, d.month, d.day, tzinfo=dt.timezone.utc).timestamp()) for d in (first, last + dt.timedelta(days=1)))
        return df.filter((F.col("win") >= lo) & (F.col("win") < hi)).withColumn("day", _day(F.col("win")))

    values = metric_values(within(users), within(ips), keep=("day", "target_id"))
    histogram = values.groupBy("day", "metric", "value").agg(F.count(F.lit(1)).alias("c"))
    shares = (values.groupBy("day", "target_id", "metric", "value").agg(F.count(F.lit(1)).alias("c"))
              .withColumn("slot", _slot(F.col("target_id"))).repartition("day", "slot"))
    # every day has a row, so that one filed again without windows replaces what it had
    days = users.sparkSession.range((last - first).days + 1).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("day"))
    counted = within(users).select("day").unionByName(within(ips).select("day")).groupBy("day").agg(F.count(F.lit(1)).alias("windows"))
    return {"days": days.join(counted, "day", "left").select("day", F.coalesce("windows", F.lit(0).cast("bigint")).alias("windows")),
            "histogram": histogram, "shares": shares}


def file_days(spark: SparkSession, users: DataFrame, ips: DataFrame, path: str, run: str, first: dt.date, last: dt.date) -> int:
    """Files all windows of the days ``first`` to ``last`` as one commit and returns its version. What these days had before
    no longer counts; windows of other days are passed over."""
    after = Snapshot(spark, path).version
    return write_commit(spark, path, day_parts(users, ips, first, last), run, after=after)


def _part(snapshot: Snapshot, name: str, first: dt.date, last: dt.date) -> DataFrame:
    schema = T.StructType.fromDDL(PARTS[name])
    return snapshot.part(name, schema).filter(F.col("day").between(F.lit(first), F.lit(last)))


def filed_days(snapshot: Snapshot, first: dt.date, last: dt.date) -> DataFrame:
    """(day, version, windows): what counts for each filed day, the newest version."""
    rows = _part(snapshot, "days", first, last)
    return rows.groupBy("day").agg(F.max("version").alias("version"), F.max_by("windows", "version").alias("windows"))


def counts_of_days(snapshot: Snapshot, first: dt.date, last: dt.date, excluded: DataFrame | None = None) -> DataFrame:
    """(metric, value, c) over the windows of a range of days, without those of ``excluded`` targets."""
    current = F.broadcast(filed_days(snapshot, first, last).select("day", "version"))  # a row for each day of the range
    rows = _part(snapshot, "histogram", first, last).join(current, ["day", "version"], "left_semi").select("metric", "value", "c")
    if excluded is not None:
        targets = excluded.select("target_id").filter("target_id IS NOT NULL").distinct()
        slots = [r[0] for r in targets.select(_slot(F.col("target_id"))).distinct().collect()]  # 256 numbers at most
        gone = (_part(snapshot, "shares", first, last).filter(F.col("slot").isin(slots))
                .join(current, ["day", "version"], "left_semi").join(targets, "target_id", "left_semi"))
        rows = rows.unionByName(gone.select("metric", "value", (-F.col("c")).alias("c")))
    return rows.groupBy("metric", "value").agg(F.sum("c").alias("c")).filter("c > 0")


def baseline_of_days(spark: SparkSession, path: str, first: dt.date, last: dt.date, cfg: Config = Config(),
                     excluded: DataFrame | None = None, as_of: str | None = None) -> DataFrame:
    """The baseline of all filed windows from ``first`` to ``last``: that of ``compute_baseline`` over the same windows, up to the
    last digits of a double where a deviation has 15 or more (sums of doubles depend on their order there and here).

    Days not filed have no windows. An empty or new store gives six cold metrics. Every step after the histogram works on
    distinct values, so a longer range costs its distinct values and not its windows.
    """
    counts = counts_of_days(Snapshot(spark, path), first, last, excluded)
    return all_metrics(histogram_distributions(counts), cfg, as_of)
