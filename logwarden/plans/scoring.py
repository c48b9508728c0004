"""The scoring job: logs -> windows -> baseline -> risk -> tables -> profiles.

``work`` is always a folder of shared storage for tables that several steps read.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logwarden.config import Config
from logwarden.operators import profiles as P
from logwarden.operators.baseline import compute_baseline, high_risk_targets
from logwarden.operators.ip_windows import META, ip_events, ip_members, ip_windows
from logwarden.operators.scoring import risk_scores, risk_summary
from logwarden.operators.user_windows import replay_samples, user_events, user_members, user_windows, windows_of
from logwarden.schema import raw_schema
from logwarden.sources.sinks import Snapshot, committed, read_run, stage, store_version, write_commit, write_daily


#: The columns of a log that windows are made of.
WINDOW_COLUMNS = ["log_id", "receive_epoch", "user_id", "jwt_id", "status", "uri", "bytes_sent", "baseline_eligible", "client_ip", *META,
                  "jwt_issued_at", "jwt_expires_at", "auth_time", "audiences"]


def staged_windows(logs: DataFrame, work: str, cfg: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """User and IP windows, written once because the baseline and the scores both read them. Of the logs, which three
    aggregations read, the columns that these use are written first, so documents are parsed once."""
    logs = stage(logs.select(*WINDOW_COLUMNS), work, "window-logs")
    return stage(user_windows(logs, cfg), work, "user-windows"), stage(ip_windows(logs), work, "ip-windows")


def score_logs(logs: DataFrame, work: str, cfg: Config = Config(), pii: DataFrame | None = None,
               excluded: DataFrame | None = None, baseline: DataFrame | None = None,
               as_of: str | None = None) -> DataFrame:
    """Risk documents of all windows in ``logs``.

    ``baseline`` may come from an earlier run; otherwise the same logs define it.
    """
    users, ips = staged_windows(logs, work, cfg)
    if baseline is None:
        baseline = compute_baseline(users, ips, cfg, excluded, as_of)
    return risk_scores(users, ips, baseline, cfg, pii, as_of)


def score_with_feedback(logs: DataFrame, work: str, previous_risk: DataFrame | None = None, cfg: Config = Config(),
                        pii: DataFrame | None = None) -> DataFrame:
    """Two rounds: targets the first round scored high stay out of the second baseline.

    ``previous_risk`` replaces the first round by the stored scores of an earlier run.
    """
    users, ips = staged_windows(logs, work, cfg)
    if previous_risk is None:
        previous_risk = risk_scores(users, ips, compute_baseline(users, ips, cfg), cfg, pii)
    excluded = stage(high_risk_targets(previous_risk, cfg), work, "high-risk")  # read by every metric of the baseline
    return risk_scores(users, ips, compute_baseline(users, ips, cfg, excluded), cfg, pii)


def run_scoring(logs: DataFrame, root: str, run: str, work: str, cfg: Config = Config(), pii: DataFrame | None = None,
                day: dt.date | None = None, write: bool = True, write_baseline: bool = True,
                as_of: str | None = None) -> dict:
    """The whole batch with its sinks. ``run`` names it; running it again, on any day, replaces its own output.

    Window documents carry exact counts; the sets behind them are the tables user_members, ip_members and
    replay_samples, as rows keyed by window. The profiles of the run's users are filed as user_profiles.
    """
    if not write:
        return {"risk": score_logs(logs, work, cfg, pii, as_of=as_of)}
    spark = logs.sparkSession
    logs = stage(logs, work, "logs")  # parsed once; every step below reads some of its columns
    out: dict = {}

    def file(name: str, df: DataFrame) -> DataFrame:
        out[name] = write_daily(df, f"{root}/{name}", run, day)
        return read_run(spark, f"{root}/{name}", run, df.schema)

    users, ips = windows_of(file("user_events", user_events(logs, cfg))), file("ip_events", ip_events(logs))
    file("user_members", user_members(logs))
    file("ip_members", ip_members(logs))
    file("replay_samples", replay_samples(logs))
    baseline = compute_baseline(users, ips, cfg, as_of=as_of)
    if write_baseline:
        baseline = file("baseline", baseline)
    out["risk"] = file("risk_scores", risk_scores(users, ips, baseline, cfg, pii, as_of))
    out["summary"] = risk_summary(out["risk"], cfg)
    out["profiles"] = update_profiles(spark, logs, f"{root}/profiles", run, work, out["risk"], cfg)
    now = logs.agg(F.max("receive_epoch")).first()[0] or 0
    touched = P.keyed(logs).select("user_id").distinct()
    profiles = P.user_profiles(P.merged(only_users(read_parts(spark, f"{root}/profiles"), touched)), now, cfg=cfg)
    file("user_profiles", profiles)
    return out


# -- profile store --------------------------------------------------------------------------------------------

def part_schemas(spark: SparkSession) -> dict[str, T.StructType]:
    """Schemas of the store's parts, from the operators that make them."""
    from logwarden.operators.normalize import normalize_logs
    none = normalize_logs(spark.createDataFrame([], raw_schema()))
    alerts = spark.createDataFrame([], P.ALERT)
    return {name: df.schema for name, df in {**P.partials(none), "alerts": alerts}.items()}


def read_parts(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All partial rows of the store that count; empty tables for a new store."""
    snapshot = Snapshot(spark, path)
    return {name: snapshot.part(name, schema) for name, schema in part_schemas(spark).items()}


def only_users(parts: P.State, users: DataFrame) -> dict[str, DataFrame]:
    return {name: rows.join(users, "user_id", "left_semi") if "user_id" in rows.columns else rows for name, rows in parts.items()}


def update_profiles(spark: SparkSession, logs: DataFrame, path: str, run: str, work: str,
                    risk: DataFrame | None = None, cfg: Config = Config()) -> dict:
    """Adds logs, and alerts of a risk table, to the profile store, as one commit.

    Every log counts once, by its id, however batches split, overlap, repeat or come late: ids seen are part of the
    store, by event day, and only those days are read that the logs touch. What is new is written once, and its partial
    rows are added to the days they belong to; nothing else is rewritten. Returns the commit's version, users created,
    windows updated, windows without a user (failed), and risk rows recorded and skipped.
    """
    before, old = store_version(spark, path), read_parts(spark, path)
    span = P.keyed(logs).agg(F.min("win"), F.max("win")).first()
    seen = None
    if span[0] is not None:
        first, last = (dt.datetime.fromtimestamp(e, dt.timezone.utc).date() for e in span)
        seen = old["seen"].filter(F.col("day").between(F.lit(first), F.lit(last)))
    fresh = stage(P.unseen(logs, seen), work, "profile-delta")
    parts = P.partials(fresh)
    counts = P.upsert_counts(logs, parts, old).first().asDict()
    if risk is not None:
        parts["alerts"] = P.alert_rows(risk, cfg)
        counts |= P.recording_counts(risk, cfg).first().asDict()
    return {"version": write_commit(spark, path, parts, run, after=before), **counts}


def compact_profiles(spark: SparkSession, path: str, through: dt.date) -> int:
    """Merges the partial rows of all commits for event days up to ``through`` into one commit. Later days, and logs that
    come late for these, go on as before."""
    before = store_version(spark, path)
    closed = {name: rows.filter(F.col("day") <= F.lit(through)) for name, rows in read_parts(spark, path).items()}
    return write_commit(spark, path, P.compacted(closed), f"compaction through {through}", through, before)


def profile_of(spark: SparkSession, path: str, user_id: str, as_of: int, cfg: Config = Config()) -> DataFrame:
    """The profile of one user, no row if there is none. Files hold users in order, so few row groups are read."""
    parts = {name: rows.filter(F.col("user_id") == user_id) if "user_id" in rows.columns else rows
             for name, rows in read_parts(spark, path).items()}
    return P.user_profiles(P.merged(parts), as_of, cfg=cfg)


def profile_exists(spark: SparkSession, path: str, user_id: str) -> bool:
    parts = read_parts(spark, path)
    return any(not parts[name].filter(F.col("user_id") == user_id).isEmpty() for name in ("windows", "alerts"))


def previous_high_risk(spark: SparkSession, root: str, cfg: Config = Config(), run: str | None = None) -> DataFrame:
    """Targets that the last round scored high: those of ``run``, or of the run filed last (by write day, then name)."""
    risk = spark.read.parquet(f"{root}/risk_scores")
    if run is None:
        last = risk.agg(F.max(F.struct("ingest_date", F.col("run").cast("string").alias("run"))).alias("last")).first()["last"]
        run = last["run"] if last is not None else ""
    return high_risk_targets(risk.filter(F.col("run").cast("string") == run), cfg)
