import json
import random
import re

from pyspark.sql import functions as F

from helpers import make_logs, rows
from logwarden.config import SUSPICIOUS_MARKERS, Config
from logwarden.operators import review as R

T0 = 1778000100


def gate(logs):
    if any(m in g["uri"] for g in logs for m in SUSPICIOUS_MARKERS):
        return True
    n = len(logs)
    if n < 3:
        return False
    if n > 200 or sum(g["status"] >= 400 for g in logs) / n > 0.3:
        return True
    paths = {g["uri"].split("?")[0] for g in logs}
    if len(paths) > 15 or (len(paths) == 1 and n >= 20):
        return True
    ids = {m.group(1) for m in (re.search(r"/api/users/(\d+)", g["uri"]) for g in logs) if m}
    return len(ids - {logs[0]["user_id"]}) >= 2


def test_gate_against_brute_force(spark):
    rng = random.Random(7)
    shapes = [
        lambda i: {"uri": "/same"}, lambda i: {"uri": f"/p{i}"}, lambda i: {"uri": f"/p{i % 3}?x={i}"},
        lambda i: {"uri": f"/api/users/{i % 3}"}, lambda i: {"uri": f"/api/users/{i % 2}"},
        lambda i: {"status": rng.choice([200, 500]), "uri": f"/p{i % 4}"},
        lambda i: {"status": 404 if i % 4 == 0 else 200, "uri": f"/p{i % 4}"},
        lambda i: {"uri": rng.choice(SUSPICIOUS_MARKERS) if i == 1 else f"/q{i % 2}"}]
    users = {}
    for u in range(60):
        shape, n = shapes[u % len(shapes)], rng.choice([1, 2, 3, 10, 16, 19, 20, 25, 201])
        users[str(u)] = [{"status": 200, **shape(i), "user_id": str(u), "receive_epoch": T0 + i} for i in range(n)]
    df = make_logs(spark, [g for v in users.values() for g in v] + [{"user_id": "", "uri": "/admin/"}])
    got = {r["user_id"] for r in rows(R.review_candidates(df))}
    assert got == {u for u, v in users.items() if gate(v)}


def test_request_text(spark):
    logs = [{"user_id": "u", "receive_epoch": T0 + i, "uri": "/admin/" + "x" * 100, "status": 404,
             "client_ip": "1.2.3.4", "timestamp": f"2026-05-13T09:13:{i:02}Z"} for i in range(25)]
    got = rows(R.review_requests(make_logs(spark, logs)))[0]
    lines = got["log_lines"].split("\n")
    assert lines[0] == "  1. [2026-05-13T09:13:00] GET /admin/" + "x" * 73 + " → 404 (IP: 1.2.3.4)"
    assert len(lines) == 21 and lines[20] == "  ... (the first 20 of 25 are shown)"
    assert got["log"]["log_id"] == 0 and "user u, 25 requests:" in got["prompt"] and lines[19] in got["prompt"]


def test_verdicts(spark):
    anomaly = {"is_anomaly": True, "severity": "high", "rule_label": "U-LLM-IDOR", "reason": "r",
               "evidence": ["e1", "e2"], "mitre_attack": "T1190"}
    answers = {
        "plain": json.dumps(anomaly), "fenced": "Sure:\n```json\n" + json.dumps(anomaly) + "\n```\nbye",
        "bare fence": "```\n" + json.dumps(anomaly) + "\n```", "defaults": '{"is_anomaly": true}',
        "null fields": '{"is_anomaly": true, "rule_label": null, "severity": null}',
        "normal": '{"is_anomaly": false}', "missing": '{"severity": "high"}', "broken": '{"is_anomaly": tru',
        "not an object": "[1, 2]", "truthy": '{"is_anomaly": "false", "reason": "strings are true"}',
        "zero": '{"is_anomaly": 0}', "no json": "nothing wrong", "empty": ""}
    logs = make_logs(spark, [{"user_id": u, "receive_epoch": T0, "uri": "/admin/x"} for u in answers])
    texts = spark.createDataFrame([(u, 0, t) for u, t in answers.items()],
                                  "user_id string, review_win bigint, text string")
    got = {r["user_id"]: r for r in rows(R.review_verdicts(R.review_requests(logs), texts, Config(reviewer="m")))}
    assert set(got) == {"plain", "fenced", "bare fence", "defaults", "null fields", "truthy"}
    for name in ("plain", "fenced", "bare fence"):
        alert = got[name]["alert"]
        assert (alert["rule"], alert["severity"], alert["mitre"], alert["reason"]) == (
            "U-LLM-IDOR", "high", "T1190", "r")
        assert json.loads(alert["evidence"]) == {"user_id": name, "log_count": 1, "llm_evidence": ["e1", "e2"],
                                                 "model": "m"}
    default = got["defaults"]["alert"]
    assert (default["rule"], default["severity"], default["reason"], default["mitre"]) == (
        "U-LLM", "medium", "", None)
    assert got["null fields"]["alert"]["rule"] is None and got["null fields"]["alert"]["severity"] is None


def test_review_windows_split_a_user(spark):
    logs = make_logs(spark, [{"user_id": "u", "receive_epoch": T0 + d * 86400, "uri": "/admin/"} for d in range(3)])
    got = R.review_candidates(logs, Config(review_window=86400)).select(F.count_distinct("review_win")).first()[0]
    assert got == 3
