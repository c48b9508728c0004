"""Token rules as data: a rule is a name, a predicate and what it reports.

Two sets exist. TOKEN_RULES score a user window at the time the log arrived. ALERT_RULES raise one alert per
log against an ``as_of`` clock. A user extends either by appending to the tuple.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.config import Config
from logwarden.functions.scalar import difference

Expr = Callable[[Config, Column], Column]


@dataclass(frozen=True)
class TokenRule:
    name: str
    score: int
    matches: Expr
    reason: Expr


@dataclass(frozen=True)
class AlertRule:
    name: str
    severity: str
    rfc: str | None
    mitre: str | None
    matches: Expr
    reason: Expr
    evidence: Expr


def _iat() -> Column:
    return F.col("jwt_issued_at")


def _exp() -> Column:
    return F.col("jwt_expires_at")


def _auth() -> Column:
    return F.col("auth_time")


def _ttl() -> Column:
    return difference(_exp(), _iat())


def _has(text: Column) -> Column:
    return text.isNotNull() & (text != "")


def _bad_audience(cfg: Config, _now: Column) -> Column:
    return (F.size("audiences") > 0) & ~F.array_contains("audiences", cfg.expected_audience)


def _missing_jti(_cfg: Config, _now: Column) -> Column:
    return _has(F.col("user_id")) & ~_has(F.col("jwt_id"))


def _say(template: str, *args: Column) -> Column:
    return F.format_string(template, *args)


def _days(seconds: Column) -> Column:
    return F.floor(seconds / 86400).cast("bigint")


# Rule names, scores and the 60 s / 1 day tolerances.
TOKEN_RULES: tuple[TokenRule, ...] = (
    TokenRule("T001", 80, lambda c, now: _exp() < now,
              lambda c, now: _say("expired token (%d s after expiry)", difference(now, _exp()))),
    TokenRule("T002", 70, lambda c, now: _ttl() > c.long_ttl,
              lambda c, now: _say(f"long-lived token (TTL %d s, normal {c.normal_ttl} s)", _ttl())),
    TokenRule("T003", 80, lambda c, now: _iat() > now + 60,
              lambda c, now: _say("token issued in the future (%d s ahead)", difference(_iat(), now))),
    TokenRule("T004", 30, lambda c, now: difference(now, _auth()) > 86400,
              lambda c, now: _say("stale authentication (%d days ago)", _days(difference(now, _auth())))),
    TokenRule("T005", 70, _bad_audience,
              lambda c, now: F.concat(F.lit("wrong audience: "), F.to_json("audiences"))),
    TokenRule("T006", 20, _missing_jti, lambda c, now: F.lit("jti claim missing")),
    TokenRule("T007", 80, lambda c, now: _ttl() > c.abnormal_ttl,
              lambda c, now: _say(f"abnormal TTL (%d s, over 6 times the normal {c.normal_ttl} s)", _ttl())),
)

# Severities and the RFC / MITRE ATT&CK references. A claim of 0 counts as absent.
ALERT_RULES: tuple[AlertRule, ...] = (
    AlertRule("T001", "high", "RFC 7519 §4.1.4", "T1550.001",
              lambda c, now: (_exp() != 0) & (_exp() < now),
              lambda c, now: _say("expired token used (%d s after expiry)", difference(now, _exp())),
              lambda c, now: F.struct(_exp().alias("jwt_expires_at"), now.alias("now"),
                                      difference(now, _exp()).alias("expired_seconds_ago"))),
    AlertRule("T002", "high", "RFC 9068 §3", "T1550.001",
              lambda c, now: (_iat() != 0) & (_exp() != 0) & (_ttl() > c.alert_long_ttl),
              lambda c, now: _say("abnormally long-lived token (%d hours)", F.floor(_ttl() / 3600).cast("bigint")),
              lambda c, now: F.struct(_ttl().alias("lifetime_seconds"),
                                      F.floor(_ttl() / 3600).cast("bigint").alias("lifetime_hours"))),
    AlertRule("T003", "high", "RFC 8725 §2.7", "T1550.001",
              lambda c, now: (_iat() != 0) & (_iat() > now + 60),
              lambda c, now: _say("token issued in the future (%d s ahead)", difference(_iat(), now)),
              lambda c, now: F.struct(_iat().alias("jwt_issued_at"), now.alias("now"),
                                      difference(_iat(), now).alias("future_seconds"))),
    AlertRule("T004", "medium", "RFC 9068 §1", "T1078",
              lambda c, now: (_iat() != 0) & (_auth() != 0) & (difference(_iat(), _auth()) > c.alert_stale_auth),
              lambda c, now: _say("token issued on stale authentication (%d days)", _days(difference(_iat(), _auth()))),
              lambda c, now: F.struct(_days(difference(_iat(), _auth())).alias("auth_time_age_days"),
                                      difference(_iat(), _auth()).alias("iat_minus_auth_time"))),
    AlertRule("T005", "high", "RFC 7519 §4.1.3", "T1550.001", _bad_audience,
              lambda c, now: F.concat(F.lit("wrong audience: "), F.to_json("audiences")),
              lambda c, now: F.struct(F.lit(c.expected_audience).alias("expected"), F.col("audiences").alias("got"))),
    AlertRule("T006", "medium", "RFC 7519 §4.1.7", None, _missing_jti,
              lambda c, now: F.lit("jti claim missing from the token"),
              lambda c, now: F.struct(F.lit(True).alias("has_jwt"), F.lit(False).alias("has_jti"))),
)

VIOLATION = "array<struct<rule_no:int,rule:string,score:int,reason:string>>"
ALERT = ("array<struct<rule:string,severity:string,reason:string,rfc:string,mitre:string,cve:string,"
         "evidence:string>>")


def hit(rule: TokenRule | AlertRule, cfg: Config, now: Column) -> Column:
    """The rule's predicate as a plain boolean: a null operand does not match."""
    return F.coalesce(rule.matches(cfg, now), F.lit(False))


def violations(cfg: Config, rules: tuple[TokenRule, ...] = TOKEN_RULES) -> Column:
    """All rules one log breaks, in rule order."""
    now = F.col("receive_epoch")
    return F.array_compact(F.array(*[
        F.when(hit(r, cfg, now), F.struct(F.lit(i).alias("rule_no"), F.lit(r.name).alias("rule"),
                                          F.lit(r.score).alias("score"), r.reason(cfg, now).alias("reason")))
        for i, r in enumerate(rules)])).cast(VIOLATION)


def token_violations(logs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """One row per log and broken token rule.

    The outer explode keeps Spark from deriving a second copy of all rules as a filter.
    """
    kept = ["log_id", "user_id", "receive_epoch", "jwt_id", "uri"]
    return (logs.select(*kept, F.explode_outer(violations(cfg)).alias("v")).filter("v IS NOT NULL")
            .select(*kept, "v.rule_no", "v.rule", "v.score", "v.reason"))


def _clock(as_of: int | None) -> Column:
    return F.col("receive_epoch") if as_of is None else F.lit(as_of).cast("bigint")


def with_alerts(logs: DataFrame, cfg: Config = Config(), as_of: int | None = None,
                rules: tuple[AlertRule, ...] = ALERT_RULES) -> DataFrame:
    """Adds ``alerts``: what the per-log alerting rules say, in rule order. ``as_of`` None = arrival time."""
    now, null = _clock(as_of), F.lit(None).cast("string")
    found = F.array_compact(F.array(*[
        F.when(hit(r, cfg, now), F.struct(
            F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), r.reason(cfg, now).alias("reason"),
            (F.lit(r.rfc) if r.rfc else null).alias("rfc"), (F.lit(r.mitre) if r.mitre else null).alias("mitre"),
            null.alias("cve"), F.to_json(r.evidence(cfg, now)).alias("evidence")))
        for r in rules])).cast(ALERT)
    return logs.withColumn("alerts", found)


def matched(cfg: Config = Config(), as_of: int | None = None) -> Column:
    """Whether any per-log alerting rule fires."""
    now, out = _clock(as_of), F.lit(False)
    for r in ALERT_RULES:
        out = out | hit(r, cfg, now)
    return out


def rule_alerts(logs: DataFrame, cfg: Config = Config(), as_of: int | None = None) -> DataFrame:
    """One row per log and alert."""
    hits = with_alerts(logs, cfg, as_of)
    return hits.withColumn("alert", F.explode_outer("alerts")).drop("alerts").filter("alert IS NOT NULL")


def residual_logs(logs: DataFrame, cfg: Config = Config(), as_of: int | None = None) -> DataFrame:
    """Logs no per-log rule matched: a filter, not a set difference (the explode keeps the rules in one place)."""
    return (logs.withColumn("matched", F.explode(F.array(matched(cfg, as_of)))).filter("NOT matched")
            .drop("matched"))
