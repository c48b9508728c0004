"""Streaming jobs that write: windows scored per micro-batch, profiles added to per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from logwarden.config import IP_WINDOWS, Config
from logwarden.operators.scoring import score_ips, score_users
from logwarden.plans.scoring import update_profiles
from logwarden.sources.sinks import stage, write_daily
from logwarden.streaming.windows import LATENESS, dedup, stream_ip_windows, stream_user_windows


def start(df: DataFrame, each, checkpoint: str, once: bool, every: str) -> StreamingQuery:
    writer = df.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def batch_name(batch: DataFrame, number: int) -> str:
    """The stream's id, which Spark keeps with the checkpoint, and the batch number: no two streams share it."""
    stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    return f"stream-{stream}-{number}"


def score_streams(logs: DataFrame, baseline: DataFrame, root: str, checkpoint: str, cfg: Config = Config(),
                  once: bool = True, every: str = "5 minutes", lateness: str = LATENESS) -> list[StreamingQuery]:
    """Scores closed windows of users and of addresses (one query for each length) against a stored baseline.

    A replayed micro-batch replaces its own files. Each query keeps its state in a folder of its own in ``checkpoint``.
    """
    def users(batch: DataFrame, number: int) -> None:
        write_daily(score_users(batch, baseline), f"{root}/risk_scores", batch_name(batch, number))

    def addresses(batch: DataFrame, number: int) -> None:
        write_daily(score_ips(batch, baseline, cfg), f"{root}/risk_scores", batch_name(batch, number))

    return [start(stream_user_windows(logs, cfg, lateness), users, f"{checkpoint}/user", once, every),
            *(start(stream_ip_windows(logs, label, lateness), addresses, f"{checkpoint}/ip-{label}", once, every)
              for label, _ in IP_WINDOWS)]


def profile_stream(logs: DataFrame, path: str, checkpoint: str, work: str, once: bool = True, every: str = "5 minutes",
                   lateness: str = LATENESS) -> StreamingQuery:
    """Adds new logs to the profile store. A micro-batch that comes again, also from a new checkpoint, adds nothing: the
    store knows its logs."""
    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        update_profiles(spark, stage(batch, work, "profile-batch"), path, batch_name(batch, number), work)

    return start(dedup(logs, lateness), each, checkpoint, once, every)
