"""The rule job: per-log alerts, alerts of global rules, review requests."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame

from logwarden.config import Config
from logwarden.operators.alerts import alert_documents
from logwarden.operators.global_rules import GLOBAL_RULES, GlobalRule, global_alerts
from logwarden.operators.review import review_requests, review_verdicts
from logwarden.operators.rules import residual_logs, rule_alerts
from logwarden.sources.sinks import write_daily


def rule_documents(logs: DataFrame, cfg: Config = Config(), as_of: int | None = None,
                   rules: Sequence[GlobalRule] = GLOBAL_RULES) -> DataFrame:
    """Alert records of the per-log rules and of the global ones."""
    per_log = alert_documents(rule_alerts(logs, cfg, as_of), "rule_engine", 1, as_of)
    return per_log.unionByName(alert_documents(global_alerts(logs, cfg, rules), "global", 1, as_of))


def review_batch(logs: DataFrame, cfg: Config = Config(), as_of: int | None = None) -> DataFrame:
    """Review requests from the logs no rule matched."""
    return review_requests(residual_logs(logs, cfg, as_of), cfg)


def run_rules(logs: DataFrame, root: str, run: str, cfg: Config = Config(), as_of: int | None = None,
              day: dt.date | None = None, rules: Sequence[GlobalRule] = GLOBAL_RULES) -> dict:
    return {"alerts": write_daily(rule_documents(logs, cfg, as_of, rules), f"{root}/alerts", run, day),
            "requests": write_daily(review_batch(logs, cfg, as_of), f"{root}/review_requests", run, day)}


def save_verdicts(requests: DataFrame, answers: DataFrame, root: str, run: str, cfg: Config = Config(),
                  as_of: int | None = None, day: dt.date | None = None) -> dict:
    """Files the reviewer's alerts beside the rule alerts (use a run name of its own)."""
    docs = alert_documents(review_verdicts(requests, answers, cfg), "llm", 2, as_of)
    return write_daily(docs, f"{root}/alerts", run, day)
