"""One stream from logs to windows, risk, alerts and profiles.

Every micro-batch is one commit of one store. It files partial rows of its logs (per user, window and token; per address, five
minutes and subject; profile parts), which add up with those of earlier batches, and the risk of the windows that the event-time
clock has closed since. The source is read once and de-duplicated once, against the ids in the store; windows of all lengths roll
up from the same five-minute rows, so there is no state in Spark's state store, however long a window or a restart. A log that
comes after its window was closed is filed as late, and its windows are scored again from all their partial rows: of a window's
risk rows the newest counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from logwarden.config import IP_WINDOWS, USER_WINDOW, Config
from logwarden.functions import scalar as X
from logwarden.operators import ip_windows as I
from logwarden.operators import profiles as P
from logwarden.operators import user_windows as U
from logwarden.operators.normalize import IDENTITY, normalize_logs
from logwarden.operators.scoring import risk_scores
from logwarden.schema import raw_schema
from logwarden.sources.sinks import Snapshot, finish_commit, stage, store_version, write_parts
from logwarden.streaming.jobs import batch_name, start

TARGET = ["target_type", "target_id", "window_size", "win"]
NO_BASELINE = "metric string, sample_count bigint, mean double, std double, cold_start boolean, computed_at string"
#: Longest window, in seconds: how far before the clock a window that is still open may begin.
REACH = max(seconds for _, seconds in IP_WINDOWS)


def ends(window_size: Column) -> Column:
    return F.coalesce(*(F.when(window_size == label, F.col("win") + seconds) for label, seconds in IP_WINDOWS))


def dated(rows: DataFrame) -> DataFrame:
    return rows.withColumn("day", X.day_of(F.col("win")))


# -- the store ------------------------------------------------------------------------------------------------

def log_parts(logs: DataFrame, cfg: Config) -> dict[str, DataFrame]:
    """The partial rows of new logs: those of profiles, of windows, and the ids of all logs."""
    return {**P.partials(logs), "seen": logs.select(*IDENTITY, X.day_of(F.col("receive_epoch")).alias("day")),
            "user_tokens": dated(U.token_measures(U.keyed(logs), cfg)),
            "ip_subjects": dated(I.subject_rows(logs)), "ip_firsts": dated(I.head_rows(logs))}


def late_rows(logs: DataFrame, clock: int) -> DataFrame:
    """Logs whose five minutes were closed before they came."""
    win = X.window_start(F.col("receive_epoch"), USER_WINDOW[1])
    return (logs.withColumn("win", win).filter(F.col("win") + USER_WINDOW[1] <= clock)
            .select(*IDENTITY, "user_id", "client_ip", "win", (F.lit(clock) - F.col("receive_epoch")).alias("seconds_late"), X.day_of(F.col("receive_epoch")).alias("day")))


def clock_row(spark: SparkSession, clock: int) -> DataFrame:
    return spark.range(1).select(F.lit(clock).cast("bigint").alias("clock"), X.day_of(F.lit(clock)).alias("day"))


#: Schemas by configuration; making them means planning every operator once.
KNOWN: dict[Config, dict[str, T.StructType]] = {}


def schemas(spark: SparkSession, cfg: Config) -> dict[str, T.StructType]:
    """Schemas of all parts, from the operators that make them."""
    if cfg in KNOWN:
        return KNOWN[cfg]
    none = normalize_logs(spark.createDataFrame([], raw_schema()))
    risk = risk_scores(U.user_windows(none, cfg), I.ip_windows(none), spark.createDataFrame([], NO_BASELINE), cfg)
    made = {**log_parts(none, cfg), "late": late_rows(none, 0), "risk": dated(risk), "clock": clock_row(spark, 0)}
    KNOWN[cfg] = {name: df.schema for name, df in made.items()}
    return KNOWN[cfg]


def read_store(spark: SparkSession, path: str, names: list[str], cfg: Config = Config(), snapshot: Snapshot | None = None) -> dict[str, DataFrame]:
    kinds, snapshot = schemas(spark, cfg), snapshot or Snapshot(spark, path)
    return {name: snapshot.part(name, kinds[name]) for name in names}


def store_clock(spark: SparkSession, path: str, cfg: Config = Config(), snapshot: Snapshot | None = None) -> int | None:
    """The event time up to which windows are closed; None for a new store."""
    return read_store(spark, path, ["clock"], cfg, snapshot)["clock"].agg(F.max("clock")).first()[0]


# -- closing windows ------------------------------------------------------------------------------------------

def due(rows: DataFrame, keys: list[str], end: Column, before: int | None, now: int, late: DataFrame | None) -> DataFrame:
    """Partial rows of the windows to score: those that end after ``before`` and by ``now``, and those of ``late`` keys."""
    closing = rows.filter((end <= now) & (F.lit(True) if before is None else end > before))
    if late is None:
        return closing
    return closing.unionByName(rows.filter(end <= before).join(late, keys, "left_semi"))


def due_windows(parts: dict[str, DataFrame], late: DataFrame | None, before: int | None, now: int, cfg: Config) -> tuple[DataFrame, DataFrame]:
    """User and address windows to score, whole, from partial rows of this and all earlier batches."""
    five = F.col("win") + USER_WINDOW[1]
    users = addresses = None
    length = ends(F.col("window_size"))
    if late is not None:
        users = late.filter(F.col("user_id").isNotNull()).select(*U.KEYS).distinct()
        addresses = I.all_lengths(I.keyed(late).select("client_ip", "win").distinct()).filter(length <= before).select(*I.KEYS).distinct()
    tokens = due(parts["user_tokens"], U.KEYS, five, before, now, users)
    subjects, firsts = (due(I.all_lengths(parts[name].drop("day", "version")), I.KEYS, length, before, now, addresses) for name in ("ip_subjects", "ip_firsts"))
    return U.windows_of_tokens(tokens, cfg), I.windows_of_rows(subjects, firsts)


def file_batch(spark: SparkSession, logs: DataFrame, name: str, path: str, work: str, baseline: DataFrame, pii: DataFrame | None = None,
               cfg: Config = Config(), lateness: int = 60, clock: int | None = None, as_of: str | None = None) -> dict:
    """Files a batch of logs as one commit called ``name``; one that is there already stays as it is.

    Logs count once by IDENTITY, whatever batch, restart or stream brings them. The clock is the newest log's time less
    ``lateness`` seconds (or ``clock``, if that is later) and never goes back; logs without a time are left out, and one from
    the future moves it as far. PII is joined to the windows as it is at the time of the batch. The days that are
    read are those of the batch and of windows still open. The store has a single writer: StoreConflict otherwise, and the
    batch does not count. Returns what was filed.
    """
    snapshot = Snapshot(spark, path)
    if name in snapshot.runs:
        return {"version": None, "logs": 0, "late": 0}
    before = store_clock(spark, path, cfg, snapshot)
    # Spark turns adaptive execution off in the session of a micro-batch; what is read with ``spark`` has it.
    timed = stage(logs.filter(F.col("receive_epoch").isNotNull()), work, "stream-batch", spark)
    days = [r[0] for r in timed.select(X.day_of(F.col("receive_epoch"))).distinct().collect()]
    seen = read_store(spark, path, ["seen"], cfg, snapshot)["seen"].filter(F.col("day").isin(days) if days else F.lit(False))
    new = stage(P.not_in(P.once_each(timed), seen), work, "stream-new")
    newest, count = new.agg(F.max("receive_epoch"), F.count(F.lit(1))).first()
    if count == 0 and clock is None:
        return {"version": None, "logs": 0, "late": 0}
    now = max(x for x in (before, clock, None if newest is None else newest - lateness, 0) if x is not None)

    commit = uuid.uuid4().hex
    write_parts(path, commit, log_parts(new, cfg))
    late = None if before is None else stage(late_rows(new, before), work, "stream-late")
    n_late = 0 if late is None else late.count()
    stored = read_store(spark, path, ["user_tokens", "ip_subjects", "ip_firsts"], cfg, snapshot.with_pending(commit))
    if before is not None:
        touched = [r[0] for r in late.select("day").distinct().collect()]
        recent = F.col("day") >= X.day_of(F.lit(before - REACH))
        stored = {k: df.filter(recent | F.col("day").isin(touched) if touched else recent) for k, df in stored.items()}
    users, ips = due_windows(stored, late if n_late else None, before, now, cfg)
    risk = dated(risk_scores(users, ips, baseline, cfg, pii, as_of))
    write_parts(path, commit, {"risk": risk, "clock": clock_row(spark, now), **({"late": late} if n_late else {})})
    return {"version": finish_commit(spark, path, commit, name, snapshot.version), "logs": count, "late": n_late, "clock": now}


def close_windows(spark: SparkSession, path: str, work: str, baseline: DataFrame, pii: DataFrame | None = None, cfg: Config = Config(),
                  as_of: str | None = None) -> dict:
    """Scores the windows that are still open, as at the end of a replayed history. Logs that come for them later are late."""
    none = normalize_logs(spark.createDataFrame([], raw_schema()))
    newest = read_store(spark, path, ["seen"], cfg)["seen"].agg(F.max("receive_epoch")).first()[0] or 0
    return file_batch(spark, none, f"close after {store_version(spark, path)}", path, work, baseline, pii, cfg, clock=newest + REACH, as_of=as_of)


def risk_stream(logs: DataFrame, path: str, checkpoint: str, work: str, baseline: DataFrame, pii: DataFrame | None = None, cfg: Config = Config(),
                once: bool = True, every: str = "5 minutes", lateness: int = 60) -> StreamingQuery:
    """Scores and profiles the logs of a stream (``stream_logs``) by ``file_batch``. A micro-batch that Spark runs again after a
    failure replaces what did not count, or finds its commit and does nothing."""
    spark = logs.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        file_batch(spark, batch, batch_name(batch, number), path, work, baseline, pii, cfg, lateness)

    return start(logs, each, checkpoint, once, every)


# -- reading --------------------------------------------------------------------------------------------------

def newest_risk(risk: DataFrame) -> DataFrame:
    """One row for each window: that of the newest commit, which withdraws earlier ones.

    A commit has a window once, and most windows have one commit. Those with several are found on their keys; the rows themselves
    are neither grouped nor sorted, and columns that a query does not use are not read.
    """
    again = (risk.groupBy(*TARGET).agg(F.max("version").alias("newest"), F.min("version").alias("oldest"))
             .filter("newest <> oldest").select(*TARGET, "newest"))
    fields = [c for c in risk.columns if c not in (*TARGET, "version", "day")]
    return (risk.join(again, TARGET, "left").filter("newest IS NULL OR version = newest").select(*TARGET, *fields))


def stored_risk(spark: SparkSession, path: str, cfg: Config = Config()) -> DataFrame:
    return newest_risk(read_store(spark, path, ["risk"], cfg)["risk"])


def stored_profiles(spark: SparkSession, path: str, as_of: int, cfg: Config = Config()) -> DataFrame:
    """Profiles with the alert history of the risk that counts."""
    parts = read_store(spark, path, ["windows", "heads", "tokens", "endpoints", "ips", "risk"], cfg)
    history = P.history_of(P.alert_rows(newest_risk(parts.pop("risk")), cfg), as_of)
    return P.user_profiles(P.merged(parts), as_of, history, cfg)


def late_logs(spark: SparkSession, path: str, cfg: Config = Config()) -> DataFrame:
    return read_store(spark, path, ["late"], cfg)["late"].drop("version")


def late_counts(spark: SparkSession, path: str, cfg: Config = Config()) -> DataFrame:
    """Late logs of each day: how many, for how many users, and how late at most."""
    return late_logs(spark, path, cfg).groupBy("day").agg(
        F.count(F.lit(1)).alias("logs"), F.count_distinct("user_id").alias("users"), F.max("seconds_late").alias("most_seconds_late"))


def compact_store(spark: SparkSession, path: str, through, cfg: Config = Config()) -> int:
    """Merges the rows of all commits for event days up to ``through`` into one commit, part by part. The sums stay what they are,
    so logs that come late for these days still correct their windows."""
    snapshot = Snapshot(spark, path)
    closed = {name: rows.filter(F.col("day") <= F.lit(through)) for name, rows in read_store(spark, path, list(schemas(spark, cfg)), cfg, snapshot).items()}
    made = P.compacted({**closed, "alerts": spark.createDataFrame([], f"{P.ALERT}, version bigint")})
    made.pop("alerts")
    clock = store_clock(spark, path, cfg, snapshot)
    subjects = closed["ip_subjects"].groupBy("client_ip", "win", "subject").agg(*I.sums())
    firsts = closed["ip_firsts"].groupBy("client_ip", "win", *I.META).agg(F.min("position").alias("position"))
    made |= {"user_tokens": dated(U.merged_tokens(closed["user_tokens"])), "ip_subjects": dated(subjects), "ip_firsts": dated(firsts),
             "risk": dated(newest_risk(closed["risk"])), "late": closed["late"].drop("version")}
    if clock is not None:
        made["clock"] = clock_row(spark, clock)
    kinds = schemas(spark, cfg)
    commit = uuid.uuid4().hex
    write_parts(path, commit, {name: rows.select(*kinds[name].names) for name, rows in made.items()})
    return finish_commit(spark, path, commit, f"compaction through {through}", snapshot.version, through)
