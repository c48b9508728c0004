import json
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from helpers import make_logs, rows
from logwarden.config import Config
from logwarden.operators import global_rules as G
from logwarden.plans.rule_batch import rule_documents

CFG, NOW = Config(), 1782003600 - 1782003600 % 86400


def traffic():
    """A busy network, one whose requests fail, one that reads records, odd addresses, and a session in three networks."""
    logs = [dict(client_ip=f"10.1.1.{i % 12}", receive_epoch=NOW + i) for i in range(400)]
    logs += [dict(client_ip=f"10.2.2.{i % 6}", status=404 if i % 5 == 0 else 200, receive_epoch=NOW + i) for i in range(150)]
    logs += [dict(client_ip=f"10.3.3.{i % 5}", uri=f"/api/orders/{i}", receive_epoch=NOW + i) for i in range(25)]
    logs += [dict(client_ip=f"10.4.4.{i % 4}", status=500, uri="/api/orders/1", receive_epoch=NOW + i) for i in range(90)]
    logs += [dict(client_ip=ip, receive_epoch=NOW) for ip in (None, "", "::1", "localhost")]
    logs += [dict(client_ip=f"172.16.{i}.1", session_id="s1", receive_epoch=NOW + 3600 * i) for i in range(4)]
    logs += [dict(client_ip=f"172.16.{i}.1", session_id="s2", receive_epoch=NOW + 86400 * i) for i in range(4)]
    return logs + [dict(client_ip="172.16.9.1", session_id=s, receive_epoch=NOW) for s in (None, "")] + logs[:50]


def plain(logs):
    """The four rules, log by log."""
    nets, sessions = defaultdict(list), defaultdict(set)
    for log in logs:
        ip = log.get("client_ip") or ""
        if "." not in ip:
            continue
        net = ip.rpartition(".")[0] + ".0/24"
        nets[net].append(log)
        if log.get("session_id"):
            sessions[log["session_id"], log["receive_epoch"] // 86400].add(net)
    out = set()
    for net, seen in nets.items():
        if len({x["client_ip"] for x in seen}) >= 5:
            errors, records = sum(x.get("status", 200) >= 400 for x in seen), sum("/orders/" in x.get("uri", "") for x in seen)
            out |= {("C001", net)} | ({("C002", net)} if errors >= 20 and 10 * errors >= len(seen) else set())
            out |= {("C003", net)} if records >= 20 else set()
    return out | {("S001", s) for (s, _), found in sessions.items() if len(found) >= 3}


def found(df):
    return {(r["alert"]["rule"], next(iter(json.loads(r["alert"]["evidence"]).values()))) for r in rows(df)}


def test_rules_equal_a_plain_reading(spark):
    got = G.global_alerts(make_logs(spark, traffic()), CFG, G.NETWORK_RULES)
    assert found(got) == plain(traffic()) and {r for r, _ in found(got)} == {"C001", "C002", "C003", "S001"}
    assert got.count() == len(plain(traffic()))
    one = next(r for r in rows(got) if r["alert"]["rule"] == "S001")
    assert json.loads(one["alert"]["evidence"]) == {"session_id": "s1", "networks": 4, "win": NOW,
                                                    "sample_networks": [f"172.16.{i}.0/24" for i in range(4)]}
    assert one["win"] == NOW and one["receive_epoch"] == NOW + 3 * 3600


def test_rules_of_equal_keys_share_a_grouping(spark):
    def aggregations(rules):
        plan = G.global_alerts(make_logs(spark, traffic()), CFG, rules)._jdf.queryExecution().optimizedPlan().toString()
        return sum(line.lstrip(" :+-").startswith("Aggregate") for line in plan.split("\n"))
    assert aggregations((G.C002, G.C003)) == aggregations((G.C002,)) == 2
    assert aggregations((G.C001, G.C002, G.C003)) == aggregations((G.C001,))


def test_a_rule_of_ones_own_and_none(spark):
    logs = make_logs(spark, [dict(user_id="u", uri=f"/{i % 7}", bytes_sent=i, receive_epoch=NOW + i) for i in range(30)])
    peak = {"largest": G.Measure(lambda: F.col("bytes_sent"), F.max)}
    rule = G.GlobalRule("X1", "low", None, ("user_id", "method"), "uri", lambda c: F.col("largest") > 28, lambda: F.lit("large"),
                        lambda: F.struct("user_id", "members", "largest", "request_count"), peak, seconds=3600)
    (one,) = rows(G.global_alerts(logs, CFG, (rule,)))
    assert json.loads(one["alert"]["evidence"]) == {"user_id": "u", "members": 7, "largest": 29, "request_count": 30}
    assert one["alert"]["mitre"] is None and rows(G.global_alerts(logs, CFG, ())) == []
    assert rows(G.global_alerts(logs.limit(0), CFG, (rule, *G.NETWORK_RULES))) == []
    docs = rows(rule_documents(logs, CFG, rules=(rule,)).filter("alert_type = 'global'"))
    assert [d["rule"] for d in docs] == ["X1"]


def test_a_measure_has_one_meaning(spark):
    other = G.GlobalRule("X2", "low", None, ("subnet",), "client_ip", lambda c: F.lit(True), lambda: F.lit(""), lambda: F.struct("subnet"),
                         {"error_count": G.count_where(lambda: F.col("status") >= 500)})
    with pytest.raises(ValueError, match="error_count"):
        G.global_alerts(make_logs(spark, traffic()), CFG, (G.C002, other))
