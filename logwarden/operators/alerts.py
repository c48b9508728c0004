"""Alert documents from rules, address clusters and review verdicts, and their query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwarden.config import Config
from logwarden.functions import scalar as X
from logwarden.operators.rules import matched


def subnet_clusters(logs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """/24 networks with many active addresses; the sample is the first ten addresses in order.

    Logs collapse to one row per address before anything else, so a busy network costs its addresses only.
    """
    ips = (logs.filter(F.col("client_ip") != "").withColumn("subnet", X.subnet_of(F.col("client_ip")))
           .filter("subnet IS NOT NULL")
           .groupBy("subnet", "client_ip").agg(F.max("receive_epoch").alias("last_epoch")))
    counted = (ips.groupBy("subnet").agg(F.count(F.lit(1)).alias("ip_count"), F.max("last_epoch").alias("last_epoch"))
               .filter(F.col("ip_count") >= cfg.cluster_min_ips))
    first = Window.partitionBy("subnet").orderBy("client_ip")
    sample = (ips.select("subnet", "client_ip").withColumn("rn", F.row_number().over(first))
              .filter(F.col("rn") <= cfg.cluster_samples)
              .groupBy("subnet").agg(F.array_sort(F.collect_list("client_ip")).alias("sample_ips")))
    return counted.join(sample, "subnet")


# Log fields an alert carries.
LOG_FIELDS = {"user_id": "string", "session_id": "string", "jwt_id": "string", "client_ip": "string",
              "method": "string", "uri": "string", "status": "bigint", "timestamp": "string"}


def alert_documents(alerts: DataFrame, alert_type: str, layer: int, as_of: int | None = None) -> DataFrame:
    """Flat alert records. ``as_of`` stamps them; without it they carry the time of their log."""
    def field(name: str) -> Column:
        return F.col(name) if name in alerts.columns else F.lit(None).cast(LOG_FIELDS[name])

    epoch = F.col("receive_epoch") if as_of is None else F.lit(as_of).cast("bigint")
    return alerts.select(
        X.epoch_to_iso(epoch).alias("@timestamp"), epoch.alias("alert_epoch"),
        F.lit(alert_type).alias("alert_type"), F.lit(layer).alias("layer"),
        F.col("alert.rule").alias("rule"), F.col("alert.severity").alias("severity"),
        F.struct("alert.reason", "alert.rfc", "alert.mitre", "alert.cve").alias("detection"),
        field("user_id").alias("user_id"), field("session_id").alias("session_id"), field("jwt_id").alias("jwt_id"),
        field("client_ip").alias("ip"), field("method").alias("method"), field("uri").alias("uri"),
        field("status").alias("status"), field("timestamp").alias("log_timestamp"),
        F.col("alert.evidence").alias("evidence"))


def run_summary(logs: DataFrame, found: DataFrame, cfg: Config = Config(), as_of: int | None = None) -> DataFrame:
    """One row: logs, matched logs, global alerts (the rows of ``found``), logs left for review."""
    hit = matched(cfg, as_of)
    alerts = found.agg(F.count(F.lit(1)).alias("n")).scalar()
    return logs.agg(
        F.count(F.lit(1)).alias("total_logs"), F.count_if(hit).alias("rule_matched"),
        F.count_if(~hit).alias("passed_to_review"),
    ).withColumn("global_alerts", alerts)


def recent_alerts(alerts: DataFrame, as_of: int, hours: int = 1, severity: str | None = None,
                  limit: int = 100) -> DataFrame:
    """Newest alerts of the last ``hours``, as a top-k over the alert table."""
    rows = alerts.filter(F.col("alert_epoch") >= as_of - hours * 3600)
    if severity is not None:
        rows = rows.filter(F.col("severity") == severity)
    order = [F.col(c).desc() for c in ("alert_epoch",)] + [
        F.col(c).asc_nulls_last() for c in ("rule", "user_id", "ip", "uri", "evidence")]
    return rows.orderBy(*order).limit(limit)
