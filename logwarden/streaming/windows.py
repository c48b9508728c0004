"""Incremental windows with event time, watermarks and exact de-duplication.

Distinct counts run as two chained aggregations (per token or subject, then per window), so the state of a hot
user or address is many small rows and never one large set.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logwarden.config import IP_WINDOWS, USER_WINDOW, Config
from logwarden.functions import scalar as X
from logwarden.operators.global_rules import GLOBAL_RULES, GlobalRule, stream_groups
from logwarden.operators.ip_windows import META
from logwarden.operators.normalize import IDENTITY, normalize_logs
from logwarden.operators.rules import rule_alerts
from logwarden.operators.user_windows import finish, token_grain, window_measures
from logwarden.schema import raw_schema

LATENESS = "1 minute"


def stream_logs(spark: SparkSession, path: str, fmt: str = "json", provenance: str = "provenance",
                files_per_trigger: int = 1000, numbered: bool = False) -> DataFrame:
    """Normalised logs from a folder that receives raw documents."""
    raw = (spark.readStream.format(fmt).schema(raw_schema(provenance))
           .option("maxFilesPerTrigger", files_per_trigger).load(path))
    return normalize_logs(raw, provenance, numbered)


def dedup(logs: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Drops logs delivered again, as overlapping polls do; state lives as long as the watermark allows."""
    return (logs.filter(F.col("receive_ts").isNotNull()).withWatermark("receive_ts", lateness)
            .dropDuplicatesWithinWatermark(IDENTITY))


def _window(seconds: int):
    return F.window("receive_ts", f"{seconds} seconds")


def stream_user_windows(logs: DataFrame, cfg: Config = Config(), lateness: str = LATENESS) -> DataFrame:
    """Same rows as the batch ``user_windows``, emitted when the watermark passes a window."""
    rows = dedup(logs, lateness).filter(F.col("user_id").isNotNull())
    tokens = token_grain(rows.withColumn("w", _window(USER_WINDOW[1])), cfg, ["user_id", "w"])
    windows = window_measures(tokens, ["user_id", "w"])
    return finish(windows.withColumn("win", F.unix_seconds("w.start")), cfg)


def stream_ip_windows(logs: DataFrame, window_size: str = "5min", lateness: str = LATENESS) -> DataFrame:
    """IP measures and first-log metadata for one window length; start one query per length."""
    seconds = dict(IP_WINDOWS)[window_size]
    rows = dedup(logs, lateness).filter(F.col("client_ip") != "")
    position = X.log_position()
    subjects = (rows.withColumn("w", _window(seconds)).withColumn("subject", X.filled(F.col("user_id")))
                .groupBy("client_ip", "w", "subject").agg(
        F.count(F.lit(1)).alias("request_count"), F.count_if(F.col("status") >= 400).alias("error_count"),
        F.count_if(X.is_sensitive(F.col("uri"))).alias("suspicious_uri_count"),
        F.sum("bytes_sent").alias("response_bytes_total"),
        F.bool_and(F.coalesce(F.col("baseline_eligible"), F.lit(True))).alias("is_baseline_eligible"),
        F.min_by(F.struct(*META), position).alias("meta"), F.min(position).alias("position")))
    windows = subjects.groupBy("client_ip", "w").agg(
        *[F.sum(c).alias(c) for c in ("request_count", "error_count", "suspicious_uri_count")],
        F.count("subject").alias("unique_subs_count"),
        F.sum("response_bytes_total").alias("response_bytes_total"),
        F.bool_and("is_baseline_eligible").alias("is_baseline_eligible"),
        F.min_by("meta", "position").alias("meta"))
    win = F.unix_seconds("w.start")
    return windows.select(
        F.col("client_ip").alias("target_id"), win.alias("win"), X.epoch_to_iso(win).alias("window_start"),
        F.lit(window_size).alias("window_size"), "request_count", "error_count", "suspicious_uri_count",
        "unique_subs_count", "response_bytes_total", "meta.*", "is_baseline_eligible")


def stream_rule_alerts(logs: DataFrame, cfg: Config = Config(), lateness: str = LATENESS) -> DataFrame:
    """Per-log alerts, once for each log however often it is delivered."""
    return rule_alerts(dedup(logs, lateness), cfg)


def stream_global_alerts(logs: DataFrame, cfg: Config = Config(), rules: Sequence[GlobalRule] = GLOBAL_RULES, seconds: int = 300,
                         lateness: str = LATENESS) -> DataFrame:
    """(receive_epoch, win, alert) of the global rules per window, ``seconds`` long where a rule has no length of its own."""
    return stream_groups(dedup(logs, lateness), "receive_ts", cfg, rules, seconds)


def stream_subnet_clusters(logs: DataFrame, cfg: Config = Config(), seconds: int = 300,
                           lateness: str = LATENESS) -> DataFrame:
    """Networks with many active addresses per window."""
    rows = (dedup(logs, lateness).filter(F.col("client_ip") != "")
            .withColumn("subnet", X.subnet_of(F.col("client_ip"))).filter("subnet IS NOT NULL"))
    ips = rows.groupBy(_window(seconds).alias("w"), "subnet", "client_ip").agg(F.count(F.lit(1)).alias("logs"))
    return (ips.groupBy("w", "subnet").agg(F.count(F.lit(1)).alias("ip_count"))
            .filter(F.col("ip_count") >= cfg.cluster_min_ips)
            .select(F.unix_seconds("w.start").alias("win"), "subnet", "ip_count"))


def write_stream(df: DataFrame, path: str, checkpoint: str, once: bool = True,
                 every: str = "5 minutes") -> StreamingQuery:
    """Appends to a parquet table with exactly-once files; ``once`` drains what is there and stops."""
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)
    return writer.start(path)
