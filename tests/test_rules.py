import json

from pyspark.sql import functions as F

from helpers import make_logs, rows
from logwarden.config import Config
from logwarden.operators import alerts as A
from logwarden.operators import rules as R
from logwarden.operators.user_windows import user_windows, violation_samples

NOW = 1782003600
CFG = Config()


def log(**changes):
    """A log at NOW with a token that breaks no rule: three minutes old, valid for seven more."""
    sound = dict(receive_epoch=NOW, user_id="someone", jwt_id="sound", audiences=[CFG.expected_audience], jwt_issued_at=NOW - 180,
                 jwt_expires_at=NOW + 420, auth_time=NOW - 3600)
    return sound | changes


def names(spark, *logs):
    got = rows(R.token_violations(make_logs(spark, logs), CFG).orderBy("log_id", "rule_no"))
    return [[g["rule"] for g in got if g["log_id"] == i] for i in range(len(logs))]


def test_token_rules(spark):
    assert names(spark, log(), log(jwt_expires_at=NOW - 100), log(jwt_expires_at=NOW + 7200), log(jwt_id=None),
                 log(audiences=["https://evil.example"]), log(jwt_issued_at=NOW + 61, jwt_expires_at=NOW + 661),
                 log(auth_time=NOW - 86401), log(receive_epoch=None), log(user_id=None, jwt_id=None),
                 log(jwt_issued_at=-(2**63), jwt_expires_at=2**62)) == [
        [], ["T001"], ["T002", "T007"], ["T006"], ["T005"], ["T003"], ["T004"], [], [], ["T002", "T007"]]


def test_window_violation(spark):
    mixed = [log(), log(), log(jwt_expires_at=NOW - 100), log(jwt_expires_at=NOW + 7200)]
    w = rows(user_windows(make_logs(spark, mixed), CFG))[0]
    assert w["violation_score"] == 80 and w["triggered_rules"] == ["T001", "T002", "T007"]
    w = rows(user_windows(make_logs(spark, [log()] * 5), CFG))[0]
    assert w["violation_score"] == 0 and w["triggered_rules"] == []


def test_violation_samples_are_the_first_ten(spark):
    logs = [log(receive_epoch=NOW + i % 3, jwt_id=None, uri=f"/{i}") for i in range(30)]
    got = rows(violation_samples(make_logs(spark, logs), CFG))[0]["violation_samples"]
    want = sorted(range(30), key=lambda i: (i % 3, i))[:10]
    assert [s["uri"] for s in got] == [f"/{i}" for i in want] and got[0]["rule"] == "T006"


def test_alert_rules(spark):
    logs = [log(), log(jwt_expires_at=NOW - 5), log(jwt_expires_at=NOW - 100 + 86401),
            log(jwt_issued_at=NOW + 61), log(auth_time=NOW - 100 - 86400 * 31),
            log(audiences=["https://evil.example"]), log(jwt_id=""), log(jwt_expires_at=0, jwt_issued_at=0)]
    df = make_logs(spark, logs)
    got = rows(R.rule_alerts(df, CFG).orderBy("log_id", "alert.rule"))
    assert [(g["log_id"], g["alert"]["rule"]) for g in got] == [
        (1, "T001"), (2, "T002"), (3, "T003"), (4, "T004"), (5, "T005"), (6, "T006")]
    assert json.loads(got[0]["alert"]["evidence"]) == {
        "jwt_expires_at": NOW - 5, "now": NOW, "expired_seconds_ago": 5}
    assert json.loads(got[4]["alert"]["evidence"]) == {"expected": "https://api.example",
                                                       "got": ["https://evil.example"]}
    assert got[5]["alert"]["mitre"] is None and got[3]["alert"]["severity"] == "medium"
    assert sorted(r["log_id"] for r in rows(R.residual_logs(df, CFG))) == [0, 7]
    later = rows(R.rule_alerts(df, CFG, as_of=NOW + 10**6))
    assert sum(g["alert"]["rule"] == "T001" for g in later) == 7
    summary = rows(A.run_summary(df, A.subnet_clusters(df, CFG), CFG))[0]
    assert summary == {"total_logs": 8, "rule_matched": 6, "passed_to_review": 2, "global_alerts": 0}


def test_subnet_cluster(spark):
    logs = [log(client_ip=f"10.1.2.{i}") for i in range(12)] + [log(client_ip=f"10.9.9.{i}") for i in range(4)]
    logs += [log(client_ip="::1"), log(client_ip=""), log(client_ip=None)] + [log(client_ip="10.1.2.3")] * 20
    got = rows(A.subnet_clusters(make_logs(spark, logs), CFG))
    assert len(got) == 1 and got[0]["subnet"] == "10.1.2.0/24" and got[0]["ip_count"] == 12
    assert got[0]["sample_ips"] == sorted(f"10.1.2.{i}" for i in range(12))[:10]


def test_alert_documents_and_recent(spark):
    logs = make_logs(spark, [log(receive_epoch=NOW + i, jwt_id=None, client_ip="1.2.3.4") for i in range(150)])
    docs = A.alert_documents(R.rule_alerts(logs, CFG), "rule_engine", 1)
    one = rows(docs.orderBy("alert_epoch"))[0]
    assert one["detection"] == {"reason": "jti claim missing from the token", "rfc": "RFC 7519 §4.1.7",
                                "mitre": None, "cve": None}
    assert one["ip"] == "1.2.3.4" and one["alert_type"] == "rule_engine" and one["layer"] == 1
    recent = rows(A.recent_alerts(docs, NOW + 200, hours=1, severity="medium"))
    assert [r["alert_epoch"] for r in recent] == [NOW + 149 - i for i in range(100)]
    assert rows(A.recent_alerts(docs, NOW + 200, severity="high")) == []
    stamped = A.alert_documents(R.rule_alerts(logs, CFG), "rule_engine", 1, as_of=NOW + 999)
    assert stamped.select("alert_epoch").distinct().collect()[0][0] == NOW + 999


def test_rules_are_extensible(spark):
    extra = R.TokenRule("T900", 40, lambda c, now: F.col("method") == "TRACE", lambda c, now: F.lit("trace"))
    df = make_logs(spark, [log(method="TRACE"), log()])
    got = df.select("log_id", F.explode(R.violations(CFG, (*R.TOKEN_RULES, extra))).alias("v")).collect()
    assert [(r.log_id, r.v.rule) for r in got] == [(0, "T900")]
