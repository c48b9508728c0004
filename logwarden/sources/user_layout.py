"""Logs stored by day and user, so that the logs of one user are found without reading the rest of a day."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.sources.logs import DAY, in_range
from logwarden.sources.sinks import BY_USER, run_folder


def store_by_user(logs: DataFrame, path: str, run: str, rows_per_file: int = 5_000_000) -> None:
    """Files normalised logs under their run by event day (UTC), sorted by user, with Bloom filters on the user.

    Logs are ranged by (day, user, second, id) in one shuffle, so a file holds few users, and a user with a third of all
    logs is split by time over as many files as it needs; logs without a user likewise. Logs without a readable time have
    a folder that no range reads. The bounds of the ranges are sampled, which reads ``logs`` once more: pass a staged or stored
    table. Writing a run again replaces exactly that run.
    """
    order = (DAY, "user_id", "receive_epoch", "log_id")
    dated = logs.withColumn(DAY, F.date_from_unix_date(F.floor(F.col("receive_epoch") / 86400).cast("int")))
    (dated.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy(DAY).options(**BY_USER)
     .option("maxRecordsPerFile", rows_per_file).mode("overwrite").parquet(run_folder(path, run)))


def stored_logs_of(spark: SparkSession, path: str, user_id: str, start: int, end: int) -> DataFrame:
    """A user's stored logs of the closed range [start, end] in epoch seconds, of all runs.

    Folders of other days are no input. In those left, the least and greatest user of each row group and page skip most of
    them, and Bloom filters skip row groups whose range holds the user without having it. A log that two runs
    hold comes twice. A path without files is an error, since it gives no columns.
    """
    first, last = (F.date_from_unix_date(F.lit(e // 86400)) for e in (start, end))
    stored = spark.read.parquet(path).filter(F.col(DAY).between(first, last) & (F.col("user_id") == F.lit(user_id)))
    return in_range(stored, start, end).drop(DAY, "run")
