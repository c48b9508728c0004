"""Named queries over the test tables. Nested results are flattened and lists joined to text so that any SQL
engine can be compared column by column."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.config import FACTORS, Config
from logwarden.functions import scalar as X
from logwarden.functions.labels import factor_label
from logwarden.operators import alerts as A
from logwarden.operators import baseline as B
from logwarden.operators import global_rules as GR
from logwarden.operators import ip_windows as I
from logwarden.operators import profiles as P
from logwarden.operators import review as R
from logwarden.operators import rules as TR
from logwarden.operators import scoring as S
from logwarden.operators import user_windows as U
from logwarden.operators.normalize import IDENTITY
from logwarden.operators.normalize import normalize_logs as normalized
from logwarden.operators.normalize import token_fields
from logwarden.plans import baseline_days as BD
from logwarden.plans import scoring as SC
from logwarden.plans.rule_batch import review_batch, rule_documents, run_rules, save_verdicts
from logwarden.plans.scoring import score_logs, score_with_feedback, staged_windows
from logwarden.sources import documents as D
from logwarden.sources import events as E
from logwarden.sources import logs as scans
from logwarden.sources.sinks import stage, write_daily
from logwarden.sources.user_layout import store_by_user, stored_logs_of
from logwarden.streaming import closed as CL
from logwarden.streaming import scored as SS
from logwarden.streaming import windows as ST

Query = Callable[[SparkSession, str], DataFrame]
CFG = Config(expected_audience=E.EXPECTED_AUDIENCE, review_window=86400)

# Query parameters, in epoch seconds.
RANGE = (1704844800, 1705103999)  # 2024-01-10 to 2024-01-12
DAY_END = 1706659200  # 2024-01-31
TRUST_AS_OF = 1705363200  # 2024-01-16
SPLIT = 1705276937  # 2024-01-15, inside a window
SOME_USER = "8"
BASE_DAYS = (dt.date(2024, 1, 9), dt.date(2024, 1, 22))  # two weeks

REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def joined(c: str | Column) -> Column:
    return F.array_join(c, ",")


def logs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.event_logs(spark, sf_dir)


def work_of(spark: SparkSession) -> str:
    """Shared storage for tables that several steps read: the session's checkpoint folder, else its warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/work"


def _pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.pii_signals(E.read_events(spark, sf_dir))


def _risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_logs(logs_of(spark, sf_dir), work_of(spark), CFG, _pii(spark, sf_dir))


# -- sources, normalisation, expressions ----------------------------------------------------------------------

@query
def normalize_logs(spark, d):
    df = logs_of(spark, d).drop("receive_ts")
    return df.withColumns({c: joined(c) for c in ("amr", "scopes", "audiences")})


@query
def token_derivation(spark, d):
    fields = token_fields(F.col("jwt_issued_at"), F.col("jwt_expires_at"), F.col("receive_epoch"))
    return logs_of(spark, d).select("log_id", *[c.alias(n) for n, c in fields.items()])


@query
def time_range_scan(spark, d):
    raw = E.raw_documents(E.events_between(E.read_events(spark, d), *RANGE))
    return scans.in_range(normalized(raw, numbered=True), *RANGE).select("log_id", "timestamp", "user_id", "uri", "status")


@query
def time_range_first(spark, d):
    raw = E.raw_documents(E.events_between(E.read_events(spark, d), *RANGE))
    return scans.in_range(normalized(raw, numbered=True), *RANGE, limit=500).select("log_id", "timestamp", "user_id", "uri")


@query
def recent_logs(spark, d):
    minutes = 1440
    events = E.events_between(E.read_events(spark, d), DAY_END - minutes * 60, DAY_END)
    return scans.recent(normalized(E.raw_documents(events), numbered=True), DAY_END, minutes).select(
        "log_id", "timestamp", "method", "uri")


@query
def user_logs(spark, d):
    return scans.of_user(logs_of(spark, d), SOME_USER).select("log_id", "timestamp", "method", "uri", "status")


@query
def sensitive_uri(spark, d):
    return logs_of(spark, d).filter(X.is_sensitive(F.col("uri"))).select("log_id", "method", "uri", "client_ip")


@query
def derived_fields(spark, d):
    uri = F.col("uri")
    return logs_of(spark, d).select(
        "log_id", X.path_of(uri).alias("path"), X.accessed_user(uri).alias("accessed_user"),
        X.is_suspicious(uri).alias("suspicious"), X.subnet_of(F.col("client_ip")).alias("subnet"),
        X.hour_of_day(F.col("receive_epoch")).alias("hour"), X.status_class(F.col("status")).alias("status_class"),
        X.epoch_to_iso(X.window_start(F.col("receive_epoch"), 300)).alias("window_start"),
        X.round_half_even(F.col("bytes_sent") / 32, 1).alias("units"))


def _ingested(spark, d) -> tuple[DataFrame, DataFrame]:
    """The events' documents as lines of JSON, some of them broken or with numbers where text is usual, filed and read back."""
    id_, line = F.col("log_id"), F.to_json(F.struct("*"))
    lines = E.raw_documents(E.read_events(spark, d)).select(
        F.when(id_ % 59 == 0, " ").when(id_ % 61 == 0, F.substring(line, 1, 40)).when(id_ % 71 == 0, F.concat(F.lit("["), line, F.lit("]")))
        .when(id_ % 73 == 0, F.regexp_replace(line, '"iat":[0-9]+', '"iat":"never"'))
        .when(id_ % 67 == 0, F.regexp_replace(line, '"status":"([0-9]+)"', '"status":$1.7')).otherwise(line).alias("value"))
    root = f"{work_of(spark)}/ingested-{uuid.uuid4().hex}"
    D.ingest_lines(lines, root, "lines", work_of(spark), dt.date(2024, 2, 1))
    return D.ingested(spark, root, "lines")


@query
def ingested_logs(spark, d):
    """Logs of the lines that are documents; a status of 200.7 is 200."""
    return normalized(_ingested(spark, d)[0]).select(
        "log_id", "timestamp", "receive_epoch", "method", "uri", "status", "bytes_sent", "client_ip", "user_id", "jwt_id", "jwt_issued_at",
        "jwt_expires_at", "auth_time", joined("audiences").alias("audiences"), "baseline_eligible", "is_nat_whitelisted")


@query
def rejected_lines(spark, d):
    """Lines that are no documents, by reason."""
    return _ingested(spark, d)[1].groupBy("reason").agg(F.count(F.lit(1)).alias("lines"), F.min("line").alias("first_line"))        .select("reason", "lines", F.substring("first_line", 1, 12).alias("starts"))


# -- rules ----------------------------------------------------------------------------------------------------

@query
def token_rules_per_log(spark, d):
    return TR.token_violations(logs_of(spark, d), CFG)


@query
def token_violation_window(spark, d):
    logs = logs_of(spark, d)
    samples = U.violation_samples(logs, CFG).withColumnRenamed("user_id", "target_id")
    text = F.transform("violation_samples", lambda s: F.concat_ws("|", s["rule"], s["score"], s["reason"],
                                                                  F.coalesce(s["jti"], F.lit("-")), s["uri"]))
    return (U.user_windows(logs, CFG).join(samples, ["target_id", "win"], "left")
            .select("target_id", "window_start", "violation_score", joined("triggered_rules").alias("triggered_rules"),
                    F.coalesce(F.array_join(text, ";"), F.lit("")).alias("samples")))


@query
def legacy_rule_alerts(spark, d):
    return TR.rule_alerts(logs_of(spark, d), CFG).select(
        "log_id", "alert.rule", "alert.severity", "alert.rfc", "alert.mitre", "alert.reason", "alert.evidence")


@query
def legacy_rule_alerts_as_of(spark, d):
    """Wall-clock mode: every token that has expired by ``as_of`` is flagged."""
    return (TR.rule_alerts(logs_of(spark, d), CFG, as_of=TRUST_AS_OF).groupBy("alert.rule", "alert.severity")
            .agg(F.count(F.lit(1)).alias("alerts")))


@query
def rule_residual(spark, d):
    return TR.residual_logs(logs_of(spark, d), CFG).select("log_id", "user_id", "uri", "status")


@query
def rule_summary(spark, d):
    logs = logs_of(spark, d)
    return A.run_summary(logs, A.subnet_clusters(logs, CFG), CFG)


@query
def subnet_cluster(spark, d):
    return A.subnet_clusters(logs_of(spark, d), CFG).withColumn("sample_ips", joined("sample_ips"))


@query
def global_rule_alerts(spark, d):
    """Three rules over networks in one grouping and one over sessions, per day."""
    return GR.global_alerts(logs_of(spark, d), CFG, GR.NETWORK_RULES).select("receive_epoch", "win", "alert.*")


@query
def global_rule_summary(spark, d):
    logs = logs_of(spark, d)
    return A.run_summary(logs, GR.global_alerts(logs, CFG, GR.NETWORK_RULES), CFG)


@query
def alert_documents(spark, d):
    """Rule, cluster and reviewer alerts in one table."""
    logs = logs_of(spark, d)
    requests = review_batch(logs, CFG)
    reviewed = A.alert_documents(R.review_verdicts(requests, _answers(requests), CFG), "llm", 2)
    return rule_documents(logs, CFG).unionByName(reviewed).select(
        "*", "detection.reason", "detection.rfc", "detection.mitre", "detection.cve").drop("detection")


@query
def recent_alerts(spark, d):
    docs = rule_documents(logs_of(spark, d), CFG)
    return A.recent_alerts(docs, DAY_END, hours=72, severity="high").select(
        "@timestamp", "alert_type", "rule", "severity", "user_id", "ip", "uri")


# -- windows --------------------------------------------------------------------------------------------------

@query
def user_events_5min(spark, d):
    doc = U.user_events(logs_of(spark, d), CFG)
    return (doc.withColumn("class_crossings", F.col("token_replay_meta.jti_count_with_class_crossing"))
            .withColumn("country_crossings", F.col("token_replay_meta.jti_count_with_country_crossing"))
            .withColumn("violation_score", F.col("token_violation.score"))
            .withColumn("triggered_rules", joined("token_violation.triggered_rules"))
            .withColumn("violation_samples", F.size("token_violation.violating_samples"))
            .drop("token_replay_meta", "token_violation"))


@query
def user_windows(spark, d):
    return U.user_windows(logs_of(spark, d), CFG).withColumn("triggered_rules", joined("triggered_rules"))


@query
def token_replay(spark, d):
    return U.replay_samples(logs_of(spark, d))


@query
def user_windows_without_log_id(spark, d):
    """Documents without an id, delivered twice: the derived id tells deliveries from documents."""
    twice = E.raw_documents(E.read_events(spark, d)).drop("log_id").withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    windows = U.user_windows(normalized(twice).dropDuplicates(IDENTITY), CFG)
    return windows.select("target_id", "win", "request_count", "success_count", "error_count", "suspicious_uri_count",
                          "response_bytes_total", "jti_count", "class_crossings", "country_crossings", "violation_score",
                          joined("triggered_rules").alias("triggered_rules"))


@query
def ip_events_multi(spark, d):
    return I.ip_events(logs_of(spark, d))


@query
def ip_windows(spark, d):
    return I.ip_windows(logs_of(spark, d))


@query
def user_event_members(spark, d):
    return U.user_members(logs_of(spark, d))


@query
def ip_event_members(spark, d):
    return I.ip_members(logs_of(spark, d))


# -- baseline and scores --------------------------------------------------------------------------------------

@query
def baseline_distributions(spark, d):
    users, ips = staged_windows(logs_of(spark, d), work_of(spark), CFG)
    return B.compute_baseline(users, ips, CFG).drop("computed_at")


@query
def baseline_excluding_high_risk(spark, d):
    users, ips = staged_windows(logs_of(spark, d), work_of(spark), CFG)
    risk = S.risk_scores(users, ips, B.compute_baseline(users, ips, CFG), CFG)
    hot = stage(B.high_risk_targets(risk, CFG), work_of(spark), "high-risk")
    return B.compute_baseline(users, ips, CFG, hot).drop("computed_at")


def _filed_baseline(spark, d) -> tuple[str, DataFrame, DataFrame]:
    """A store of days in three commits, the second of which files days of the first again with their late logs, and the windows."""
    users, ips = staged_windows(logs_of(spark, d), work_of(spark), CFG)
    path, middle = f"{work_of(spark)}/baseline-{uuid.uuid4().hex}", dt.date(2024, 1, 15)
    BD.file_days(spark, users.filter(F.col("request_count") > 1), ips, path, "incomplete", dt.date(2024, 1, 1), middle)
    BD.file_days(spark, users, ips, path, "with late logs", dt.date(2024, 1, 1), middle)
    BD.file_days(spark, users, ips, path, "later", middle + dt.timedelta(days=1), dt.date(2024, 1, 31))
    return path, users, ips


@query
def baseline_of_days(spark, d):
    """Two weeks' baseline from the store of days, reading no window."""
    return BD.baseline_of_days(spark, _filed_baseline(spark, d)[0], *BASE_DAYS, CFG).drop("computed_at")


@query
def baseline_of_days_excluding(spark, d):
    """The same without the targets that later scored high: their share is taken out of the days filed."""
    path, users, ips = _filed_baseline(spark, d)
    risk = S.risk_scores(users, ips, B.compute_baseline(users, ips, CFG), CFG)
    hot = stage(B.high_risk_targets(risk, CFG), work_of(spark), "high-risk")
    return BD.baseline_of_days(spark, path, *BASE_DAYS, CFG, hot).drop("computed_at")


@query
def factor_scores(spark, d):
    return _risk(spark, d).select("target_type", "target_id", "window_start", "window_size", "factor_breakdown.*")


@query
def ip_diversity_meta(spark, d):
    logs = logs_of(spark, d)
    return score_logs(logs, work_of(spark), CFG).filter(F.col("target_type") == "ip").select(
        "target_id", "window_start", "window_size", "ip_user_diversity_meta.*")


@query
def risk_scores(spark, d):
    return _risk(spark, d).select(
        "@timestamp", "target_type", "target_id", "window_start", "window_size", "total_score", "dominant_factor",
        *[F.col(f"factor_breakdown.{k}").alias(k) for k in FACTORS], "attacker_level", "data_exfiltration_detected",
        "suspected_exfiltration", joined("triggered_rules").alias("triggered_rules"),
        F.col("evidence.token_replay.jti_count_with_class_crossing").alias("class_crossings"),
        "ip_class", "ip_asn", "ip_org", "ip_country", "is_nat_whitelisted")


@query
def risk_scores_with_feedback(spark, d):
    return score_with_feedback(logs_of(spark, d), work_of(spark), cfg=CFG).select(
        "target_type", "target_id", "window_start", "window_size", "total_score", "dominant_factor",
        "attacker_level")


@query
def attacker_levels(spark, d):
    return (_risk(spark, d).groupBy("target_type", "window_size", "attacker_level")
            .agg(F.count(F.lit(1)).alias("windows"), F.max("total_score").alias("max_score"),
                 F.count_if("suspected_exfiltration").alias("suspected")))


@query
def risk_summary(spark, d):
    return S.risk_summary(_risk(spark, d), CFG)


@query
def dominant_histogram(spark, d):
    return S.dominant_histogram(_risk(spark, d), CFG).withColumn("label", factor_label(F.col("dominant_factor")))


@query
def alerts_above_p99(spark, d):
    risk = stage(score_logs(logs_of(spark, d), work_of(spark), CFG), work_of(spark), "risk")
    return S.alerting(risk, CFG, S.score_p99(risk)).select("target_type", "target_id", "window_start", "window_size",
                                                           "total_score")


@query
def pii_sensitivity(spark, d):
    signals = _pii(spark, d)
    score = S.response_sensitivity(F.col("email"), F.col("phone"), F.col("doorlock_with_address"))
    return signals.withColumn("response_sensitivity", score)


# -- review ---------------------------------------------------------------------------------------------------

def _answers(requests: DataFrame) -> DataFrame:
    """Stand-in reviewer: answers of every shape, built from the requests."""
    n = F.col("request_count").cast("string")
    fenced = F.concat(
        F.lit('Result:\n```json\n{"is_anomaly": true, "severity": "high", "rule_label": "U-LLM-PRIV-ESC", "reason": "'),
        n, F.lit(' requests", "evidence": ["'), F.col("log.uri"), F.lit('"], "mitre_attack": "T1190"}\n```'))
    short = F.when(F.col("request_count") % 2 == 0, F.lit('  {"is_anomaly": 1, "reason": "errors"}\n')).otherwise(
        F.lit('{"is_anomaly": tru'))
    text = (F.when(F.col("reason") == "suspicious_path", fenced).when(F.col("reason") == "error_rate", short)
            .otherwise(F.lit('{"is_anomaly": false}')))
    return requests.select(*R.KEYS, text.alias("text"))


@query
def review_candidates(spark, d):
    return R.review_candidates(TR.residual_logs(logs_of(spark, d), CFG), CFG)


@query
def review_requests(spark, d):
    return review_batch(logs_of(spark, d), CFG).withColumn("first_log", F.col("log.log_id")).drop("log")


@query
def review_verdicts(spark, d):
    requests = review_batch(logs_of(spark, d), CFG)
    return R.review_verdicts(requests, _answers(requests), CFG).select(*R.KEYS, "log_id", "uri", "alert.*")


# -- profiles -------------------------------------------------------------------------------------------------

@query
def profile_totals(spark, d):
    return P.behavior(P.totals_of(P.window_rows(logs_of(spark, d)))).drop(
        "active_hours", "active_hour_count", "circular_mean_hour", "circular_stdev_hour")


@query
def profile_hours(spark, d):
    return P.behavior(P.totals_of(P.window_rows(logs_of(spark, d)))).select(
        "user_id", joined("active_hours").alias("active_hours"), "active_hour_count", "circular_mean_hour",
        "circular_stdev_hour")


@query
def profile_endpoints(spark, d):
    return P.top_endpoints(P.profile_state(logs_of(spark, d))["endpoints"], CFG)


@query
def profile_ips(spark, d):
    return P.top_ips(P.profile_state(logs_of(spark, d))["ips"], CFG)


@query
def profile_location(spark, d):
    return (P.location(P.profile_state(logs_of(spark, d))["ips"], CFG).drop("known_ips")
            .withColumns({c: joined(c) for c in ("known_countries", "known_asns", "known_ip_classes")}))


@query
def profile_tokens(spark, d):
    return P.recent_tokens(P.profile_state(logs_of(spark, d))["tokens"], CFG).withColumns(
        {c: joined(c) for c in ("known_jtis", "known_lsids", "known_kids")})


@query
def profile_claims(spark, d):
    return P.profile_state(logs_of(spark, d))["claims"].select(
        "user_id", *[joined(c).alias(c) if c in ("audiences", "amr", "scopes") else c for c in P.CLAIMS])


@query
def profile_alerts(spark, d):
    return P.alert_history(_risk(spark, d), CFG, as_of=DAY_END)


@query
def alert_recording(spark, d):
    return P.recording_counts(_risk(spark, d), CFG)


@query
def trust_levels(spark, d):
    logs = logs_of(spark, d)
    seen = P.totals_of(P.window_rows(logs)).select("user_id", "first_seen")
    history = P.alert_history(score_logs(logs, work_of(spark), CFG), CFG).select("user_id", "total_alerts")
    level = P.trust_level(F.col("first_seen"), F.col("total_alerts"), TRUST_AS_OF)
    return seen.join(history, "user_id", "full_outer").select(
        "user_id", "first_seen", F.coalesce("total_alerts", F.lit(0).cast("bigint")).alias("total_alerts"),
        level.alias("trust_level"))


def _halves(spark, d, *columns) -> tuple[DataFrame, DataFrame]:
    """Logs of a first range that ends inside a window, and of a second that overlaps it; written once, since several steps read them."""
    events = E.read_events(spark, d)
    first, later = (normalized(E.raw_documents(events.filter(part)), numbered=True).select(*columns or "*")
                    for part in (E.before(SPLIT), ~E.before(SPLIT - 3 * 86400)))
    return stage(first, work_of(spark), "profile-first"), stage(later, work_of(spark), "profile-later")


@query
def profile_merge(spark, d):
    """A second, overlapping range merges into the first one's partials and gives the profile of the whole."""
    first, later = _halves(spark, d)
    old = P.partials(first)
    fresh = stage(P.unseen(later, old["seen"]), work_of(spark), "profile-delta")
    state = P.merged(P.together(old, P.partials(fresh)))
    doc = P.user_profiles(state, DAY_END, cfg=CFG)
    return doc.select(
        "user_id", "first_seen", "last_seen", "total_active_days", "behavior.requests_total",
        "behavior.error_ratio", "behavior.response_bytes_avg", "behavior.requests_per_window_max",
        joined("behavior.active_hours").alias("active_hours"), "behavior.unique_uri_count",
        F.col("behavior.typical_endpoints")[0]["path"].alias("top_path"),
        joined("jwt_pattern.known_jtis").alias("known_jtis"),
        F.col("jwt_pattern.typical_client_id").alias("client_id"),
        "location.known_ip_count", "location.primary_ip", "risk.trust_level", "ingest_meta.data_points_count")


@query
def profile_upsert_counts(spark, d):
    """Counts of a second, overlapping range; they need users and windows of logs and no other column."""
    first, later = _halves(spark, d, *IDENTITY, "user_id")
    fresh = stage(P.unseen(later, P.keyed(first)), work_of(spark), "profile-delta")
    return P.upsert_counts(later, {"windows": P.keyed(fresh)}, {"windows": P.keyed(first)})


# -- streaming ------------------------------------------------------------------------------------------------

def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    # a stream takes no path of a file, but a pattern of one; it also finds a table that is a folder of files
    events = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")
    return normalized(E.raw_documents(events), numbered=True)


def drained(df: DataFrame) -> DataFrame:
    """Runs a stream over what is there into a table on shared storage and reads it."""
    spark = df.sparkSession
    base = f"{work_of(spark)}/stream-{uuid.uuid4().hex}"
    ST.write_stream(df, f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


@query
def streaming_user_events(spark, d):
    return drained(ST.stream_user_windows(_event_stream(spark, d), CFG)).withColumn(
        "triggered_rules", joined("triggered_rules"))


@query
def streaming_ip_events(spark, d):
    return drained(ST.stream_ip_windows(_event_stream(spark, d), "1h"))


@query
def streaming_risk_scores(spark, d):
    """Windows of users and of all address lengths as one stream closes them, scored against the baseline of all windows, also of
    those left open."""
    work, path = work_of(spark), _place(spark, "closing")
    CL.closing_stream(_event_stream(spark, d), path, f"{path}/checkpoint", work, CFG).awaitTermination()
    closed, left = CL.closed_windows(spark, path, CFG), CL.open_windows(spark, path, CFG)
    baseline = stage(B.compute_baseline(*(a.unionByName(b) for a, b in zip(closed, left)), CFG), work, "baseline")
    return S.risk_scores(*closed, baseline, CFG).select(
        "target_type", "target_id", "win", "window_size", "total_score", "dominant_factor", "attacker_level")


@query
def streaming_dedup(spark, d):
    """Every log is delivered twice, as overlapping polls do, and kept once."""
    twice = _event_stream(spark, d).withColumn("delivery", F.explode(F.array(F.lit(1), F.lit(2)))).drop("delivery")
    return drained(ST.dedup(twice).select("log_id", "user_id", "uri", "receive_epoch"))


@query
def streaming_rule_alerts(spark, d):
    alerts = ST.stream_rule_alerts(_event_stream(spark, d), CFG)
    return drained(alerts.select("log_id", "alert.rule", "alert.severity", "alert.reason"))


@query
def streaming_subnet_clusters(spark, d):
    return drained(ST.stream_subnet_clusters(_event_stream(spark, d), CFG, seconds=86400))


@query
def streaming_global_alerts(spark, d):
    """The same rules by day, as the stream closes days."""
    found = ST.stream_global_alerts(_event_stream(spark, d), CFG, GR.NETWORK_RULES, seconds=86400)
    return drained(found.select("win", "receive_epoch", "alert.rule", "alert.severity", "alert.reason", "alert.evidence"))


# -- sinks and stores, read back ------------------------------------------------------------------------------

def _place(spark: SparkSession, name: str) -> str:
    return f"{work_of(spark)}/{name}-{uuid.uuid4().hex}"


@query
def filed_events(spark, d):
    """Window documents as daily runs; a retry on the next day replaces its run."""
    logs, root, day = logs_of(spark, d), _place(spark, "filed"), dt.date(2024, 2, 1)
    users, ips = U.user_windows(logs, CFG), I.ip_windows(logs)
    for name, df in (("user", users), ("ip", ips)):
        for later in (0, 1):
            write_daily(df.select("target_id", "window_size", "request_count"), f"{root}/events", f"{name}-run", day + dt.timedelta(days=later))
    return (spark.read.parquet(f"{root}/events").groupBy("run", F.col("ingest_date").cast("string").alias("ingest_date"), "window_size")
            .agg(F.count(F.lit(1)).alias("windows"), F.count_distinct("target_id").alias("targets"), F.sum("request_count").alias("requests")))


@query
def filed_risk(spark, d):
    """Risk rows as the sink has them, and what the next round leaves out: targets of the last run that scored high."""
    root = _place(spark, "filed")
    risk = stage(_risk(spark, d), work_of(spark), "risk")
    write_daily(risk.filter("total_score > 90"), f"{root}/risk_scores", "2024-01-30", dt.date(2024, 1, 30))
    write_daily(risk, f"{root}/risk_scores", "2024-01-31", dt.date(2024, 1, 31))
    hot = SC.previous_high_risk(spark, root, CFG).withColumn("excluded_next", F.lit(True))
    filed = spark.read.parquet(f"{root}/risk_scores").filter(F.col("run").cast("string") == "2024-01-31")
    return filed.join(hot, "target_id", "left").select(
        "target_type", "target_id", "win", "window_size", "total_score", "dominant_factor", "attacker_level",
        F.coalesce("excluded_next", F.lit(False)).alias("excluded_next"))


@query
def filed_alerts(spark, d):
    """Rule, cluster and reviewer alerts as their sink has them."""
    logs, root = logs_of(spark, d), _place(spark, "filed")
    run_rules(logs, root, "rules", CFG, day=dt.date(2024, 2, 1))
    requests = review_batch(logs, CFG)
    save_verdicts(requests, _answers(requests), root, "verdicts", CFG, day=dt.date(2024, 2, 1))
    return spark.read.parquet(f"{root}/alerts").select(
        "run", "alert_type", "layer", "rule", "severity", "user_id", "ip", "uri", "alert_epoch", "evidence", "detection.reason")


def _store(spark, d) -> str:
    """A profile store of two overlapping batches, the second of which comes again, compacted up to the split."""
    path, work = _place(spark, "profiles"), work_of(spark)
    events = E.read_events(spark, d)
    # parsed once, since each commit reads its logs several times
    first = stage(normalized(E.raw_documents(events.filter(E.before(SPLIT))), numbered=True), work, "store-first")
    later = stage(normalized(E.raw_documents(events.filter(~E.before(SPLIT - 3 * 86400))), numbered=True), work, "store-later")
    for name, logs in (("first", first), ("later", later), ("later again", later)):
        SC.update_profiles(spark, logs, path, name, work)
    SC.compact_profiles(spark, path, dt.date(2024, 1, 14))
    return path


def _profile_columns(doc: DataFrame) -> DataFrame:
    return doc.select(
        "user_id", "first_seen", "last_seen", "behavior.requests_total", "behavior.error_ratio", "behavior.unique_uri_count",
        joined("jwt_pattern.known_jtis").alias("known_jtis"), F.col("jwt_pattern.typical_client_id").alias("client_id"),
        "location.known_ip_count", "location.primary_ip", "ingest_meta.data_points_count")


@query
def profile_store(spark, d):
    """Profiles read back from a store that has had repeats, an overlap and a compaction."""
    return _profile_columns(P.user_profiles(P.merged(SC.read_parts(spark, _store(spark, d))), DAY_END, cfg=CFG))


@query
def profile_lookup(spark, d):
    """One user's stored profile, and whether that user and an unknown one exist."""
    path = _store(spark, d)
    return _profile_columns(SC.profile_of(spark, path, SOME_USER, DAY_END, CFG)).withColumns({
        "known": F.lit(SC.profile_exists(spark, path, SOME_USER)), "stranger": F.lit(SC.profile_exists(spark, path, "no such user"))})


@query
def stored_user_logs(spark, d):
    """One user's logs of a range, from logs filed by user in two runs, the second of which comes again."""
    path, events = _place(spark, "by-user"), E.read_events(spark, d)
    first, later = (normalized(E.raw_documents(events.filter(part)), numbered=True) for part in (E.before(SPLIT), ~E.before(SPLIT)))
    for run, logs in (("first", first), ("later", later), ("later", later)):
        store_by_user(logs, path, run)
    return stored_logs_of(spark, path, SOME_USER, RANGE[0], DAY_END).select("log_id", "timestamp", "method", "uri", "status")


#: Stores that queries of this application have streamed into, by table folder. Filing there again would change nothing.
STREAMED: dict[tuple[str, str], str] = {}


def _streamed(spark, d) -> str:
    """Three deliveries through one checkpoint: logs before the split, an overlapping second half, and late ones of the first."""
    key = (spark.sparkContext.applicationId, d)
    if key not in STREAMED:
        base = _place(spark, "streamed")
        events, late = E.read_events(spark, d), (F.col("event_id") % 100 == 7) & E.before(SPLIT)
        baseline = stage(B.compute_baseline(*staged_windows(logs_of(spark, d), work_of(spark), CFG), CFG), work_of(spark), "baseline")
        pii = stage(_pii(spark, d), work_of(spark), "pii")
        for part in (E.before(SPLIT) & ~late, ~E.before(SPLIT - 3 * 86400) & ~late, late):
            E.raw_documents(events.filter(part)).write.mode("append").parquet(f"{base}/raw")
            logs = ST.stream_logs(spark, f"{base}/raw", "parquet", numbered=True)
            SS.risk_stream(logs, f"{base}/store", f"{base}/checkpoint", work_of(spark), baseline, pii, CFG).awaitTermination()
        SS.close_windows(spark, f"{base}/store", work_of(spark), baseline, pii, CFG)
        STREAMED[key] = f"{base}/store"
    return STREAMED[key]


@query
def streamed_risk(spark, d):
    """Risk of all windows from the stream, with PII, late logs included."""
    return SS.stored_risk(spark, _streamed(spark, d), CFG).select(
        "target_type", "target_id", "win", "window_size", "total_score", "dominant_factor", "attacker_level", "data_exfiltration_detected",
        joined("triggered_rules").alias("triggered_rules"), "ip_class", "ip_country")


@query
def streamed_profiles(spark, d):
    """Profiles from the stream, with their alert history."""
    doc = SS.stored_profiles(spark, _streamed(spark, d), DAY_END, CFG)
    return _profile_columns(doc).join(doc.select(
        "user_id", "risk.total_alerts", "risk.last_alert_epoch", "risk.last_alert_dominant_factor", "risk.last_alert_rule", "risk.max_score_seen",
        "risk.max_attacker_level_seen", "risk.data_exfiltration_ever", "risk.alerts_last_7d", "risk.trust_level"), "user_id")


@query
def streamed_late(spark, d):
    """Late logs of each day."""
    return SS.late_counts(spark, _streamed(spark, d), CFG).withColumn("day", F.col("day").cast("string"))
