"""Per-IP windows of three lengths.

``ip_windows`` holds the measures that baselines and scoring read; whole sets are rows of ``ip_members``. All lengths
roll up from one table of (address, 5 minutes, subject), so logs are shuffled once and a hot address spreads over its
subjects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.config import IP_WINDOWS
from logwarden.functions import scalar as X
from logwarden.operators.members import member_rows

KEYS = ["client_ip", "window_size", "win"]
META = ["ip_class", "ip_asn", "ip_org", "ip_country", "is_nat_whitelisted"]


def _lenses(epoch: Column) -> Column:
    """The windows of all lengths one instant falls into."""
    return F.explode(F.array(*[
        F.struct(F.lit(label).alias("window_size"), X.window_start(epoch, seconds).alias("win"))
        for label, seconds in IP_WINDOWS]))


def keyed(logs: DataFrame) -> DataFrame:
    return logs.filter((F.col("client_ip") != "") & F.col("receive_epoch").isNotNull())


def _smallest(df: DataFrame) -> DataFrame:
    return df.withColumn("win", X.window_start(F.col("receive_epoch"), IP_WINDOWS[0][1]))


def subject_grain(logs: DataFrame, keys: list[str]) -> DataFrame:
    """Measures per subject within ``keys``; additive but for the subject, which becomes a count."""
    return (logs.withColumn("subject", X.filled(F.col("user_id"))).groupBy(*keys, "subject").agg(
        F.count(F.lit(1)).alias("request_count"),
        F.count_if(F.col("status") >= 400).alias("error_count"),
        F.count_if(X.is_sensitive(F.col("uri"))).alias("suspicious_uri_count"),
        F.sum("bytes_sent").alias("response_bytes_total"),
        F.bool_and(F.coalesce("baseline_eligible", F.lit(True))).alias("is_baseline_eligible")))


def sums() -> list[Column]:
    return [*[F.sum(c).alias(c) for c in ("request_count", "error_count", "suspicious_uri_count", "response_bytes_total")],
            F.bool_and("is_baseline_eligible").alias("is_baseline_eligible")]


def subject_rows(logs: DataFrame) -> DataFrame:
    """Measures per (address, 5 minutes, subject): what windows of every length add up from, also over batches."""
    return subject_grain(_smallest(keyed(logs)), ["client_ip", "win"])


def head_rows(logs: DataFrame) -> DataFrame:
    """The first position of each set of metadata per (address, 5 minutes). An address rarely has two sets, so this leaves
    about one row each; only those few go through ``min_by``, whose struct buffer needs a sort."""
    return _smallest(keyed(logs)).groupBy("client_ip", "win", *META).agg(F.min(X.log_position()).alias("position"))


def all_lengths(rows: DataFrame) -> DataFrame:
    """Rows of 5 minutes as rows of each window they fall into (``window_size``, ``win``)."""
    return rows.withColumn("w", _lenses(F.col("win"))).drop("win").select("*", "w.*").drop("w")


def measures_of(rows: DataFrame) -> DataFrame:
    """Window measures from subject rows with ``window_size``; rows of several batches may repeat a subject."""
    return (rows.groupBy(*KEYS, "subject").agg(*sums()).groupBy(*KEYS)
            .agg(*sums(), F.count("subject").alias("unique_subs_count")))


def heads_of(rows: DataFrame) -> DataFrame:
    """Address metadata of the first log of each window, nulls included, from head rows with ``window_size``."""
    return (rows.select(*KEYS, "position", F.struct(*META).alias("meta")).groupBy(*KEYS)
            .agg(F.min_by("meta", "position").alias("meta")).select(*KEYS, "meta.*"))


def ip_windows(logs: DataFrame) -> DataFrame:
    return windows_of_rows(all_lengths(subject_rows(logs)), all_lengths(head_rows(logs)))


def windows_of_rows(subjects: DataFrame, heads: DataFrame) -> DataFrame:
    """The windows that subject and head rows add up to."""
    return measures_of(subjects).join(heads_of(heads), KEYS).select(
        F.col("client_ip").alias("target_id"), "win", X.epoch_to_iso(F.col("win")).alias("window_start"),
        "window_size", "request_count", "error_count", "suspicious_uri_count", "unique_subs_count",
        "response_bytes_total", *META, "is_baseline_eligible")


def ip_members(logs: DataFrame) -> DataFrame:
    """Whole sets as rows, rolled up from the 5-minute sets."""
    small = member_rows(_smallest(keyed(logs)), ["client_ip", "win"], {
        "sub_set": F.col("user_id"), "request_methods": F.col("method"), "ua_set": F.col("user_agent")})
    return (small.select("client_ip", _lenses(F.col("win")).alias("w"), "kind", "member")
            .select("client_ip", "w.*", "kind", "member").distinct())


def ip_events(logs: DataFrame) -> DataFrame:
    """The IP-window document."""
    return ip_windows(logs).select(F.col("window_start").alias("@timestamp"), F.lit("ip").alias("target_type"), "*")
