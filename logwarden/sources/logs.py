"""Scans over stored raw documents and over normalised logs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.operators.normalize import normalize_logs
from logwarden.schema import raw_schema

DAY = "dt"


def read_raw(spark: SparkSession, path: str, fmt: str = "parquet", provenance: str = "provenance",
             start: int | None = None, end: int | None = None) -> DataFrame:
    """Raw documents with a fixed schema (never inferred). ``fmt``: parquet or json.

    With a range, whole days outside it are skipped where the store is partitioned by ``dt``, and the date in the text
    of ``@timestamp`` is compared, which reaches the row groups of the files. A day of slack on each side covers local
    dates and offsets.
    """
    schema = raw_schema(provenance)
    by_day = DAY in spark.read.format("text").load(path).columns  # from the names of folders, nothing is read
    stored = spark.read.format(fmt).schema(schema.add(DAY, "date") if by_day else schema).load(path)

    def day(epoch: int, slack: int) -> dt.date:
        return dt.datetime.fromtimestamp(epoch, dt.timezone.utc).date() + dt.timedelta(days=slack)

    if start is not None:
        stored = stored.filter(F.col("`@timestamp`") >= F.lit(day(start, -1).isoformat()))
        stored = stored.filter(F.col(DAY) >= F.lit(day(start, -1))) if by_day else stored
    if end is not None:
        stored = stored.filter(F.col("`@timestamp`") < F.lit(day(end, 2).isoformat()))
        stored = stored.filter(F.col(DAY) <= F.lit(day(end, 1))) if by_day else stored
    return stored.drop(DAY)


def in_range(logs: DataFrame, start: int, end: int, limit: int | None = None) -> DataFrame:
    """Logs of the closed range [start, end] in epoch seconds; ``limit`` keeps the earliest ones."""
    rows = logs.filter(F.col("receive_epoch").between(start, end))
    return rows if limit is None else rows.orderBy("receive_epoch", "log_id").limit(limit)


def recent(logs: DataFrame, as_of: int, minutes: int = 15, limit: int | None = None) -> DataFrame:
    return in_range(logs, as_of - minutes * 60, as_of, limit)


def of_user(logs: DataFrame, user_id: str, as_of: int | None = None, minutes: int = 60) -> DataFrame:
    rows = logs if as_of is None else recent(logs, as_of, minutes)
    return rows.filter(F.col("user_id") == user_id)


def read_logs(spark: SparkSession, path: str, start: int, end: int, fmt: str = "parquet",
              provenance: str = "provenance", numbered: bool = False) -> DataFrame:
    """Normalised logs of a closed range. ``numbered`` as in ``normalize_logs``."""
    return in_range(normalize_logs(read_raw(spark, path, fmt, provenance, start, end), provenance, numbered), start, end)
