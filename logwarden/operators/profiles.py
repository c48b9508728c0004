"""Accumulated user profiles.

A profile is not folded document by document. Logs become partial rows by user and event day (``partials``), whose
measures are associative, so partials of any batches, in any order, add up to the same state (``merged``). Trimming (top
endpoints, recent tokens) happens when a profile is read, on exact counts.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwarden.config import Config
from logwarden.functions import scalar as X
from logwarden.operators import user_windows as UW
from logwarden.operators.normalize import IDENTITY

CLAIMS = ["audiences", "issuer", "client_id", "acr", "amr", "scopes", "token_lifetime"]
TOKEN_KINDS = {"jti": "jwt_id", "kid": "kid", "session": "session_id"}
STATUS = ["s2xx", "s3xx", "s4xx", "s5xx"]
State = Mapping[str, DataFrame]


def keyed(logs: DataFrame) -> DataFrame:
    return UW.keyed(logs.filter(F.col("user_id") != ""))


# -- partials -------------------------------------------------------------------------------------------------

def window_rows(logs: DataFrame) -> DataFrame:
    """One row per (user, window): its additive facts."""
    auth = F.when(F.col("auth_time") != 0, F.col("auth_time"))
    return keyed(logs).groupBy(*UW.KEYS).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("status").between(200, 299)).alias("success"),
        F.count_if(F.col("status") >= 400).alias("errors"),
        F.sum("bytes_sent").alias("bytes_total"), F.max("bytes_sent").alias("bytes_max"),
        *[F.count_if(F.floor(F.col("status") / 100) == int(s[1])).alias(s) for s in STATUS],
        F.min("receive_epoch").alias("first_seen"), F.max("receive_epoch").alias("last_seen"),
        F.min(auth).alias("auth_min"), F.max(auth).alias("auth_max"))


def totals_of(windows: DataFrame) -> DataFrame:
    """User totals from window rows. Active hours are a 24-bit mask."""
    hour_bit = F.expr("shiftleft(1, CAST(floor(pmod(win, 86400) / 3600) AS INT))")
    return windows.groupBy("user_id").agg(
        F.sum("requests").alias("requests_total"), F.sum("success").alias("success_total"),
        F.sum("errors").alias("error_total"), F.sum("bytes_total").alias("bytes_total"),
        F.max("bytes_max").alias("bytes_max"), *[F.sum(s).alias(s) for s in STATUS],
        F.count(F.lit(1)).alias("windows"), F.max("requests").alias("window_max"),
        F.bit_or(hour_bit).alias("hours"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.min_by("auth_min", F.when(F.col("auth_min").isNotNull(), F.col("win"))).alias("first_auth"),
        F.max_by("auth_max", F.when(F.col("auth_max").isNotNull(), F.col("win"))).alias("last_auth"))


def _merge_windows(df: DataFrame) -> DataFrame:
    sums = ["requests", "success", "errors", "bytes_total", *STATUS]
    return df.groupBy(*UW.KEYS).agg(
        *[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in ("bytes_max", "last_seen", "auth_max")],
        *[F.min(c).alias(c) for c in ("first_seen", "auth_min")])


def _present(name: str, c: Column) -> Column:
    if name in ("audiences", "amr", "scopes"):
        return F.size(c) > 0
    return c != 0 if name == "token_lifetime" else c != ""


def head_rows(logs: DataFrame) -> DataFrame:
    """The claims of the first log of each (user, window).

    Claims rarely change inside a window, so grouping by their values leaves about one row per window before
    anything has to be sorted.
    """
    both = (F.col("jwt_expires_at") != 0) & (F.col("jwt_issued_at") != 0)
    rows = keyed(logs).withColumn("token_lifetime", F.when(
        both, X.difference(F.col("jwt_expires_at"), F.col("jwt_issued_at"))))
    variants = rows.groupBy(*UW.KEYS, *CLAIMS).agg(F.min(X.log_position()).alias("position"))
    return _merge_heads(variants.select(*UW.KEYS, "position", F.struct(*CLAIMS).alias("head")))


def _merge_heads(df: DataFrame) -> DataFrame:
    return df.groupBy(*UW.KEYS).agg(F.min_by("head", "position").alias("head"), F.min("position").alias("position"))


def claims_of(heads: DataFrame) -> DataFrame:
    """Latest non-empty claims per user."""
    latest = F.struct("win", (-F.col("position")).alias("order"))  # latest window, then its first log
    return _merge_claims(heads.select("user_id", *[
        c for name in CLAIMS for c in (F.col(f"head.{name}").alias(name), F.when(
            _present(name, F.col(f"head.{name}")), latest).alias(f"{name}_at"))]))


def _merge_claims(df: DataFrame) -> DataFrame:
    return df.groupBy("user_id").agg(*[
        a for name in CLAIMS
        for a in (F.max_by(name, f"{name}_at").alias(name), F.max(f"{name}_at").alias(f"{name}_at"))])


def token_rows(logs: DataFrame) -> DataFrame:
    """Last window of every token id, key id and session id of a user and day."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in TOKEN_KINDS.items()])
    return (keyed(logs).select("user_id", "win", F.explode(F.filter(pairs, lambda p: p["value"] != "")).alias("p"))
            .groupBy(X.day_of(F.col("win")).alias("day"), "user_id", F.col("p.kind").alias("kind"), F.col("p.value").alias("value"))
            .agg(F.max("win").alias("last_win")))


def _merge_tokens(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by, "user_id", "kind", "value").agg(F.max("last_win").alias("last_win"))


def endpoint_rows(logs: DataFrame) -> DataFrame:
    return (keyed(logs).filter(F.col("uri") != "").withColumn("path", X.path_of(F.col("uri")))
            .groupBy(X.day_of(F.col("win")).alias("day"), "user_id", "path")
            .agg(F.count(F.lit(1)).alias("count"), F.max("receive_epoch").alias("last_seen")))


def _merge_endpoints(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by, "user_id", "path").agg(F.sum("count").alias("count"), F.max("last_seen").alias("last_seen"))


IP_META = ["ip_class", "ip_asn", "ip_country"]


def ip_rows(logs: DataFrame) -> DataFrame:
    """Addresses of a user and day; each metadata field keeps its first non-empty value."""
    variants = keyed(logs).filter(F.col("client_ip") != "").groupBy(
        X.day_of(F.col("win")).alias("day"), "user_id", "client_ip", *IP_META).agg(
        F.count(F.lit(1)).alias("count"), F.min("receive_epoch").alias("first_seen"),
        F.max("receive_epoch").alias("last_seen"), F.min(X.log_position()).alias("position"))
    return _merge_ips(variants.select(
        "day", "user_id", "client_ip", "count", "first_seen", "last_seen", *[
            c for m in IP_META for c in (X.filled(F.col(m)).alias(m),
                                         F.when(F.col(m) != "", F.col("position")).alias(f"{m}_at"))]), "day")


def _merge_ips(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by, "user_id", "client_ip").agg(
        F.sum("count").alias("count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        *[a for m in IP_META for a in (F.min_by(m, f"{m}_at").alias(m), F.min(f"{m}_at").alias(f"{m}_at"))])


ALERT = "user_id string, win bigint, total_score int, dominant_factor string, attacker_level string, " \
        "data_exfiltration_detected boolean, triggered_rules array<string>, day date"


def alert_rows(risk: DataFrame, cfg: Config = Config()) -> DataFrame:
    """The user rows of a risk table that enter the history."""
    kept = risk.filter((F.col("target_type") == "user") & (F.col("target_id") != "")
                       & (F.col("total_score") >= cfg.alert_score))
    return kept.select(F.col("target_id").alias("user_id"), "win", "total_score", "dominant_factor", "attacker_level",
                       "data_exfiltration_detected", "triggered_rules", X.day_of(F.col("win")).alias("day"))


def partials(logs: DataFrame) -> dict[str, DataFrame]:
    """The partial rows of a set of logs, each with its event day."""
    def dated(df: DataFrame) -> DataFrame:
        return df.withColumn("day", X.day_of(F.col("win")))

    return {"windows": dated(window_rows(logs)), "heads": dated(head_rows(logs)), "tokens": token_rows(logs),
            "endpoints": endpoint_rows(logs), "ips": ip_rows(logs),
            "seen": keyed(logs).select(*IDENTITY, X.day_of(F.col("win")).alias("day")).distinct()}


def _latest_alerts(df: DataFrame) -> DataFrame:
    """One row per (user, window): that of the newest commit, whatever runs overlap."""
    fields = [c for c in df.columns if c not in ("user_id", "win", "version")]
    return (df.groupBy("user_id", "win").agg(F.max_by(F.struct(*fields), "version").alias("a"))
            .select("user_id", "win", "a.*"))


def compacted(parts: State) -> dict[str, DataFrame]:
    """Partials of many commits as those of one, day by day."""
    day = X.day_of(F.col("win")).alias("day")
    return {"windows": _merge_windows(parts["windows"]).withColumn("day", day),
            "heads": _merge_heads(parts["heads"]).withColumn("day", day),
            "tokens": _merge_tokens(parts["tokens"], "day"), "endpoints": _merge_endpoints(parts["endpoints"], "day"),
            "ips": _merge_ips(parts["ips"], "day"), "seen": parts["seen"].select(*IDENTITY, "day").distinct(),
            "alerts": _latest_alerts(parts["alerts"])}


def merged(parts: State) -> dict[str, DataFrame]:
    """The state of all users that partials add up to."""
    state = {"windows": _merge_windows(parts["windows"]), "claims": claims_of(_merge_heads(parts["heads"])),
             "tokens": _merge_tokens(parts["tokens"]), "endpoints": _merge_endpoints(parts["endpoints"]),
             "ips": _merge_ips(parts["ips"])}
    if "alerts" in parts:
        state["alerts"] = _latest_alerts(parts["alerts"])
    return state


def together(*several: State) -> dict[str, DataFrame]:
    """Partials of several batches."""
    first, *rest = several
    out = dict(first)
    for more in rest:
        out = {name: rows.unionByName(more[name], allowMissingColumns=True) for name, rows in out.items()}
    return out


def profile_state(logs: DataFrame) -> dict[str, DataFrame]:
    return merged(partials(logs))


def once_each(logs: DataFrame) -> DataFrame:
    """Logs once each by IDENTITY. Whether any comes twice is asked first, on identities alone (``logs`` is read for it: pass a
    staged table); only those that do are put through ``dropDuplicates``, which sorts whole rows."""
    again = logs.groupBy(*IDENTITY).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*(F.col(c).alias(f"again_{c}") for c in IDENTITY))
    if again.isEmpty():
        return logs
    same = [F.col(c).eqNullSafe(F.col(f"again_{c}")) for c in IDENTITY]
    return logs.join(again, same, "left_anti").unionByName(logs.join(again, same, "left_semi").dropDuplicates(IDENTITY))


def not_in(logs: DataFrame, seen: DataFrame) -> DataFrame:
    """Logs whose IDENTITY is not in ``seen``; all have a time. Those newer than any that is seen pass as they are. The others and the
    ids are dealt by IDENTITY, and a task holds the ids of its share: Spark takes two columns of a wide table for small and would
    send all ids to every executor, or else sort whole logs."""
    newest, at = seen.agg(F.max("receive_epoch")).first()[0], F.col("receive_epoch")
    if newest is None:
        return logs
    ids = seen.select(*IDENTITY).hint("shuffle_hash")
    return logs.filter(at > newest).unionByName(logs.filter(at <= newest).join(ids, IDENTITY, "left_anti").select(*logs.columns))


def unseen(logs: DataFrame, seen: DataFrame | None) -> DataFrame:
    """Logs of users that are not in ``seen`` (IDENTITY), each once: what makes repeats and overlaps change nothing."""
    rows = once_each(keyed(logs))
    return (rows if seen is None else not_in(rows, seen)).drop("win")


def upsert_counts(logs: DataFrame, fresh: State, old: State | None) -> DataFrame:
    """One row: users created, user windows that entered a profile, and windows without a user id."""
    windows = fresh["windows"].select("user_id", "win").distinct()
    users = windows.select("user_id").distinct()
    created = users if old is None else users.join(old["windows"].select("user_id").distinct(), "user_id", "left_anti")
    nameless = UW.keyed(logs.filter(F.col("user_id") == "")).select("win").distinct()
    one = [created.select(F.lit("created").alias("kind")), windows.select(F.lit("updated").alias("kind")),
           nameless.select(F.lit("failed").alias("kind"))]
    rows = one[0].unionByName(one[1]).unionByName(one[2])
    return rows.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("created", "updated", "failed")])


# -- reading --------------------------------------------------------------------------------------------------

def hours_of(mask: Column) -> Column:
    return F.filter(F.sequence(F.lit(0), F.lit(23)),
                    lambda h: F.call_function("shiftright", mask, h).bitwiseAND(F.lit(1)) == 1)


def circular_hours(hours: Column) -> tuple[Column, Column]:
    """Mean and deviation of a set of hours on the 24 h circle.

    Evenly spread hours cancel out; what is left is rounding noise, so a resultant below 1e-9 counts as none.
    """
    turn = 2 * math.pi / 24
    n = F.size(hours)

    def mean(fn) -> Column:
        return F.aggregate(F.transform(hours, lambda h: fn(h * F.lit(2.0) * math.pi / 24)), F.lit(0.0),
                           lambda a, b: a + b) / n

    s, c = mean(F.sin), mean(F.cos)
    r = F.sqrt(s * s + c * c)
    none = r < 1e-9
    hour = F.when(none, 0.0).otherwise(F.pmod(F.atan2(s, c) * 24 / (2 * math.pi), F.lit(24.0)))
    spread = F.when(r >= 1.0, 0.0).when(none, 12.0).otherwise(F.sqrt(F.lit(-2.0) * F.log(r)) / turn)
    return (F.when(n > 0, X.round_half_even(hour, 3)), F.when(n > 0, X.round_half_even(spread, 3)))


def behavior(totals: DataFrame) -> DataFrame:
    n = F.col("requests_total")
    mean, spread = circular_hours(F.col("active_hours"))
    days = F.floor((F.col("last_seen") - F.col("first_seen")) / 86400) + 1
    return totals.withColumn("active_hours", hours_of(F.col("hours"))).select(
        "user_id", "first_seen", "last_seen", F.greatest(days, F.lit(1)).alias("total_active_days"),
        "requests_total", "success_total", "error_total",
        X.round_half_even(F.col("error_total") / n, 4).alias("error_ratio"),
        F.col("bytes_total").alias("response_bytes_total"), F.col("bytes_max").alias("response_bytes_max"),
        X.round_half_even(F.col("bytes_total") / n, 1).alias("response_bytes_avg"), *STATUS,
        F.col("windows").alias("data_points_count"),
        X.round_half_even(n / F.col("windows"), 3).alias("requests_per_window_mean"),
        F.col("window_max").alias("requests_per_window_max"),
        "active_hours", F.size("active_hours").alias("active_hour_count"),
        mean.alias("circular_mean_hour"), spread.alias("circular_stdev_hour"),
        "first_auth", "last_auth")


def recent_tokens(tokens: DataFrame, cfg: Config = Config()) -> DataFrame:
    """The last distinct values of each kind, oldest first, and the exact number of sessions (of which the newest are listed)."""
    keep = (F.when(F.col("kind") == "jti", cfg.keep_jtis).when(F.col("kind") == "kid", cfg.keep_kids)
            .otherwise(cfg.keep_sessions))
    newest = Window.partitionBy("user_id", "kind").orderBy(F.desc("last_win"), F.desc("value"))
    most = max(cfg.keep_jtis, cfg.keep_kids, cfg.keep_sessions)
    kept = (tokens.withColumn("rn", F.row_number().over(newest))
            .filter(F.col("rn") <= most).filter(F.col("rn") <= keep))

    def values(kind: str) -> Column:
        pairs = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("last_win", "value"))))
        return F.transform(pairs, lambda p: p["value"])

    lists = kept.groupBy("user_id").agg(
        values("jti").alias("known_jtis"), values("session").alias("known_lsids"), values("kid").alias("known_kids"))
    sessions = tokens.groupBy("user_id").agg(F.count_if(F.col("kind") == "session").alias("known_lsid_count"))
    return lists.join(sessions, "user_id")


def top_endpoints(endpoints: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(user, path) rows of the most used paths, ties by name."""
    best = Window.partitionBy("user_id").orderBy(F.desc("count"), "path")
    return endpoints.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= cfg.keep_endpoints)


def top_ips(ips: DataFrame, cfg: Config = Config()) -> DataFrame:
    best = Window.partitionBy("user_id").orderBy(F.desc("count"), "client_ip")
    return (ips.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= cfg.keep_ips)
            .select("user_id", "rank", "client_ip", "count", "first_seen", "last_seen", *IP_META))


def location(ips: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Most used addresses, and the countries, networks and classes of all addresses."""
    entry = F.struct("rank", F.col("client_ip").alias("ip"), *IP_META, "first_seen", "last_seen", "count")
    listed = top_ips(ips, cfg).groupBy("user_id").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    known = ips.groupBy("user_id").agg(*[  # a user's countries, networks and classes: few values, whatever its addresses
        F.array_sort(F.collect_set(m)).alias(name)
        for m, name in (("ip_country", "known_countries"), ("ip_asn", "known_asns"), ("ip_class", "known_ip_classes"))])
    return (listed.join(known, "user_id")
            .select("user_id", F.transform("entries", lambda e: e.dropFields("rank")).alias("known_ips"),
                    F.size("entries").alias("known_ip_count"), "known_countries", "known_asns", "known_ip_classes",
                    F.col("entries")[0]["ip"].alias("primary_ip")))


# Order of the attacker levels.
LEVEL_RANK = {"L0": 1, "L2": 2, "L4(Slow & Low)": 3, "L4": 4}


def alert_history(risk: DataFrame, cfg: Config = Config(), as_of: int | None = None) -> DataFrame:
    """Risk history per user from user rows at or above the alert score; "last" means the latest window."""
    return history_of(alert_rows(risk, cfg), as_of)


def history_of(rows: DataFrame, as_of: int | None = None) -> DataFrame:
    """Risk history per user from alert rows, one per window."""
    level = F.coalesce(*[F.when(F.col("attacker_level") == k, F.lit(v)) for k, v in LEVEL_RANK.items()], F.lit(0))

    def within(days: int) -> Column:
        if as_of is None:
            return F.lit(None).cast("bigint")
        return F.count_if(F.col("win").between(as_of - days * 86400, as_of))

    rule = F.try_element_at("triggered_rules", F.lit(1))
    out = rows.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_alerts"), F.max("win").alias("last_alert_epoch"),
        F.max_by("dominant_factor", "win").alias("last_alert_dominant_factor"),
        F.max_by(rule, F.when(rule.isNotNull(), F.col("win"))).alias("last_alert_rule"),
        F.max("total_score").alias("max_score_seen"), F.max(level).alias("level"),
        F.bool_or("data_exfiltration_detected").alias("data_exfiltration_ever"),
        within(1).alias("alerts_last_24h"), within(7).alias("alerts_last_7d"), within(30).alias("alerts_last_30d"))
    name = F.coalesce(*[F.when(F.col("level") == v, F.lit(k)) for k, v in LEVEL_RANK.items()])
    return out.select(
        "user_id", "total_alerts", "last_alert_epoch", "last_alert_dominant_factor", "last_alert_rule",
        "max_score_seen", name.alias("max_attacker_level_seen"),
        X.severity_band(F.col("max_score_seen")).alias("max_severity_seen"), "data_exfiltration_ever",
        "alerts_last_24h", "alerts_last_7d", "alerts_last_30d")


def recording_counts(risk: DataFrame, cfg: Config = Config()) -> DataFrame:
    """One row: risk rows that enter a user's history, and rows skipped."""
    recorded = F.coalesce((F.col("target_type") == "user") & (F.col("target_id") != "")
                          & (F.col("total_score") >= cfg.alert_score), F.lit(False))
    passed_over = (F.col("target_type") != "user") | (F.col("total_score") < cfg.alert_score)
    return risk.agg(F.count_if(recorded).alias("recorded"), F.count_if(passed_over).alias("skipped"))


def trust_level(first_seen: Column, alerts: Column, as_of: int) -> Column:
    age = F.floor((F.lit(as_of) - first_seen) / 86400)
    return (F.when(F.coalesce(alerts, F.lit(0)) > 0, "suspicious").when(first_seen.isNull(), "new")
            .when(age < 7, "new").when(age < 14, "learning").otherwise("established"))


def user_profiles(state: State, as_of: int, history: DataFrame | None = None, cfg: Config = Config()) -> DataFrame:
    """The nested profile document of every user, including users known only from alerts.

    Without a ``history`` it is made from the state's alerts, if there are any.
    """
    if history is None and "alerts" in state:
        history = history_of(state["alerts"], as_of)
    endpoint = F.struct("rank", "path", "count", "last_seen")
    paths = (top_endpoints(state["endpoints"], cfg).groupBy("user_id")
             .agg(F.array_sort(F.collect_list(endpoint)).alias("e"))
             .select("user_id", F.transform("e", lambda e: e.dropFields("rank")).alias("typical_endpoints")))
    doc = (behavior(totals_of(state["windows"])).join(state["claims"], "user_id", "left")
           .join(recent_tokens(state["tokens"], cfg), "user_id", "left").join(paths, "user_id", "left")
           .join(location(state["ips"], cfg), "user_id", "left"))
    if history is None:
        history = state["windows"].select("user_id").limit(0).select(
            "user_id", *[F.lit(None).cast(t).alias(c) for c, t in (
                ("total_alerts", "bigint"), ("last_alert_epoch", "bigint"), ("last_alert_dominant_factor", "string"),
                ("last_alert_rule", "string"), ("max_score_seen", "int"), ("max_attacker_level_seen", "string"),
                ("max_severity_seen", "string"), ("data_exfiltration_ever", "boolean"),
                ("alerts_last_24h", "bigint"), ("alerts_last_7d", "bigint"), ("alerts_last_30d", "bigint"))])
    doc = doc.join(history, "user_id", "full_outer")
    zero = F.lit(0).cast("bigint")

    def count(name: str) -> Column:
        return F.coalesce(name, zero).alias(name)

    return doc.select(
        "user_id", "first_seen", "last_seen", "total_active_days",
        F.struct("known_jtis", F.size("known_jtis").alias("known_jti_count"), "known_lsids",
                 "known_lsid_count", "known_kids",
                 *[F.col(c).alias(f"typical_{c}") for c in CLAIMS],
                 "first_auth", "last_auth").alias("jwt_pattern"),
        F.struct("requests_total", "success_total", "error_total", "error_ratio", "response_bytes_total",
                 "response_bytes_max", "response_bytes_avg", "active_hours", "active_hour_count",
                 "circular_mean_hour", "circular_stdev_hour", "typical_endpoints",
                 F.size("typical_endpoints").alias("unique_uri_count"),
                 F.struct(*STATUS).alias("status_distribution"), "requests_per_window_mean",
                 "requests_per_window_max").alias("behavior"),
        F.struct("known_ips", "known_ip_count", "known_countries", "known_asns", "known_ip_classes",
                 "primary_ip").alias("location"),
        F.struct(count("total_alerts"), count("alerts_last_24h"), count("alerts_last_7d"), count("alerts_last_30d"),
                 "last_alert_epoch", "last_alert_dominant_factor", "last_alert_rule", "max_score_seen",
                 "max_attacker_level_seen", "max_severity_seen",
                 F.coalesce("data_exfiltration_ever", F.lit(False)).alias("data_exfiltration_ever"),
                 F.lit(0.0).alias("anomaly_score"),
                 trust_level(F.col("first_seen"), F.col("total_alerts"), as_of).alias("trust_level")).alias("risk"),
        F.struct(count("data_points_count"), F.lit("v1").alias("profile_version"),
                 F.lit("v1").alias("schema_version")).alias("ingest_meta"))
