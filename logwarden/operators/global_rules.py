"""Rules over groups of logs as data: keys, the members that a group counts, measures, a condition and what it reports.

Rules that group alike (same keys, members and window) share one grouping: logs collapse to a row for each group and member
with partial measures, then to a row for each group, and all their conditions are read off that row. So a further rule on the
same keys costs no shuffle, a busy group costs its members only, and no set of members is ever held. A user extends the
list by appending to GLOBAL_RULES or by passing an own tuple.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwarden.config import Config
from logwarden.functions import scalar as X
from logwarden.operators.rules import ALERT

#: Keys and members by name. Any other name is a column of the log.
DERIVED: dict[str, Callable[[], Column]] = {"subnet": lambda: X.subnet_of(F.col("client_ip"))}


@dataclass(frozen=True)
class Measure:
    """An additive measure: ``of`` a log, and how partial values combine (sum, min or max)."""
    of: Callable[[], Column]
    combine: Callable[[str], Column] = F.sum


def count_where(condition: Callable[[], Column]) -> Measure:
    return Measure(lambda: F.when(condition(), F.lit(1)).otherwise(F.lit(0)).cast("bigint"))


@dataclass(frozen=True)
class GlobalRule:
    """``having``, ``reason`` and ``evidence`` read the group's row: its keys, ``members`` (how many different ones),
    ``request_count``, ``last_epoch``, ``win`` (of a rule with ``seconds``), the measures, and ``sample`` in evidence."""
    name: str
    severity: str
    mitre: str | None
    keys: tuple[str, ...]
    member: str
    having: Callable[[Config], Column]
    reason: Callable[[], Column]
    evidence: Callable[[], Column]
    measures: Mapping[str, Measure] = field(default_factory=dict)
    seconds: int | None = None
    sampled: bool = False

    @property
    def grouping(self) -> tuple:
        return self.keys, self.member, self.seconds


def _many_addresses(cfg: Config) -> Column:
    return F.col("members") >= cfg.cluster_min_ips


ERRORS = {"error_count": count_where(lambda: F.col("status") >= 400)}
SENSITIVE = {"sensitive_count": count_where(lambda: X.is_sensitive(F.col("uri")))}

C001 = GlobalRule(
    "C001", "high", "T1071", ("subnet",), "client_ip", _many_addresses,
    lambda: F.format_string("%d addresses active in one /24 network (%s)", "members", "subnet"),
    lambda: F.struct("subnet", F.col("members").alias("ip_count"), F.col("sample").alias("sample_ips")), sampled=True)
#: Scans that single addresses keep too small to see.
C002 = GlobalRule(
    "C002", "medium", "T1595", ("subnet",), "client_ip",
    lambda c: _many_addresses(c) & (F.col("error_count") >= c.network_min_errors)
    & (F.col("error_count") * 100 >= F.col("request_count") * c.network_error_percent),
    lambda: F.format_string("%d of %d requests failed over %d addresses of one /24 network (%s)", "error_count", "request_count", "members", "subnet"),
    lambda: F.struct("subnet", F.col("members").alias("ip_count"), "error_count", "request_count"), ERRORS)
C003 = GlobalRule(
    "C003", "high", "T1119", ("subnet",), "client_ip",
    lambda c: _many_addresses(c) & (F.col("sensitive_count") >= c.network_min_sensitive),
    lambda: F.format_string("%d sensitive records read from %d addresses of one /24 network (%s)", "sensitive_count", "members", "subnet"),
    lambda: F.struct("subnet", F.col("members").alias("ip_count"), "sensitive_count"), SENSITIVE)
#: One session in several networks within a day.
S001 = GlobalRule(
    "S001", "high", "T1539", ("session_id",), "subnet", lambda c: F.col("members") >= c.session_min_networks,
    lambda: F.format_string("session %s used from %d networks in a day", "session_id", "members"),
    lambda: F.struct("session_id", F.col("members").alias("networks"), F.col("sample").alias("sample_networks"), "win"),
    seconds=86400, sampled=True)

GLOBAL_RULES: tuple[GlobalRule, ...] = (C001,)
NETWORK_RULES: tuple[GlobalRule, ...] = (C001, C002, C003, S001)

BUILT_IN = {"request_count": Measure(lambda: F.lit(1).cast("bigint")), "last_epoch": Measure(lambda: F.col("receive_epoch"), F.max)}


def _groupings(rules: Sequence[GlobalRule]) -> dict[tuple, list[GlobalRule]]:
    out: dict[tuple, list[GlobalRule]] = {}
    for rule in rules:
        out.setdefault(rule.grouping, []).append(rule)
    return out


def _measures(rules: Sequence[GlobalRule]) -> dict[str, Measure]:
    out = dict(BUILT_IN)
    for rule in rules:
        for name, measure in rule.measures.items():
            if out.setdefault(name, measure) != measure:
                raise ValueError(f"rules of keys {rule.keys} give the measure {name!r} two meanings")
    return out


def member_rows(logs: DataFrame, rules: Sequence[GlobalRule], win: Column | None) -> DataFrame:
    """A row for each group and member with partial measures. Logs without a key, member or window (null or empty) are left out."""
    keys, member, _ = rules[0].grouping
    measures = _measures(rules)
    needed = {**{k: DERIVED[k]() if k in DERIVED else F.col(k) for k in keys},
              "member": DERIVED[member]() if member in DERIVED else F.col(member)}
    rows = logs.select(*[c.alias(n) for n, c in needed.items()], *([win.alias("win")] if win is not None else []),
                       *[m.of().alias(f"m_{n}") for n, m in measures.items()])
    for name in needed:
        rows = rows.filter(F.col(name).cast("string") != "")
    if win is not None:
        rows = rows.filter("win IS NOT NULL")
    return rows.groupBy(*_group_keys(rules, win), "member").agg(*[m.combine(f"m_{n}").alias(n) for n, m in measures.items()])


def _group_keys(rules: Sequence[GlobalRule], win: Column | None) -> list[str]:
    return [*rules[0].keys, *(["win"] if win is not None else [])]


def group_rows(members: DataFrame, rules: Sequence[GlobalRule], win: Column | None, cfg: Config) -> DataFrame:
    """A row for each group that meets the condition of any rule."""
    groups = members.groupBy(*_group_keys(rules, win)).agg(
        F.count(F.lit(1)).alias("members"), *[m.combine(n).alias(n) for n, m in _measures(rules).items()])
    return groups.filter(reduce(lambda a, b: a | b, [F.coalesce(r.having(cfg), F.lit(False)) for r in rules]))


def _with_sample(groups: DataFrame, members: DataFrame, keys: list[str], cfg: Config) -> DataFrame:
    first = Window.partitionBy(*keys).orderBy("member")
    sample = (members.select(*keys, "member").withColumn("rn", F.row_number().over(first)).filter(F.col("rn") <= cfg.cluster_samples)
              .groupBy(*keys).agg(F.array_sort(F.collect_list("member")).alias("sample")))
    return groups.join(sample, keys)


def _fired(groups: DataFrame, rules: Sequence[GlobalRule], cfg: Config) -> DataFrame:
    """(rule, receive_epoch, win, alert), a row for each group and rule that fires."""
    null = F.lit(None).cast("string")
    found = F.array_compact(F.array(*[
        F.when(F.coalesce(r.having(cfg), F.lit(False)), F.struct(
            F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), r.reason().alias("reason"), null.alias("rfc"),
            (F.lit(r.mitre) if r.mitre else null).alias("mitre"), null.alias("cve"), F.to_json(r.evidence()).alias("evidence")))
        for r in rules])).cast(ALERT)
    win = F.col("win") if "win" in groups.columns else F.lit(None).cast("bigint").alias("win")
    return groups.select(F.col("last_epoch").alias("receive_epoch"), win, F.explode(found).alias("alert"))


def global_alerts(logs: DataFrame, cfg: Config = Config(), rules: Sequence[GlobalRule] = GLOBAL_RULES) -> DataFrame:
    """(receive_epoch, win, alert) of all rules. ``receive_epoch`` is the group's last log. No rules give no rows."""
    out = logs.sparkSession.createDataFrame([], f"receive_epoch bigint, win bigint, alert {ALERT[6:-1]}")
    for (keys, _, seconds), alike in _groupings(rules).items():
        win = None if seconds is None else X.window_start(F.col("receive_epoch"), seconds)
        members = member_rows(logs, alike, win)
        groups = group_rows(members, alike, win, cfg)
        if any(r.sampled for r in alike):
            groups = _with_sample(groups, members, _group_keys(alike, win), cfg)
        out = out.unionByName(_fired(groups, alike, cfg))
    return out


def stream_groups(logs: DataFrame, event_time: str, cfg: Config, rules: Sequence[GlobalRule], seconds: int) -> DataFrame:
    """The alerts of a stream with a watermark on ``event_time``, when it passes a group's window: that of the rule, else
    ``seconds``. Two chained aggregations, so state is small rows; evidence has no sample, which would need the members again."""
    frames = []
    for (keys, _, own), alike in _groupings(rules).items():
        win = F.window(event_time, f"{own or seconds} seconds")
        groups = group_rows(member_rows(logs, alike, win), alike, win, cfg)
        groups = groups.withColumns({"win": F.unix_seconds("win.start"), "sample": F.lit(None).cast("array<string>")})
        frames.append(_fired(groups, alike, cfg))
    return reduce(DataFrame.unionByName, frames)
