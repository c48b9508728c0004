from collections import defaultdict
import random

from helpers import make_logs, rows
from logwarden.config import Config
from logwarden.operators import ip_windows as I
from logwarden.operators import user_windows as U

CFG = Config()
T0 = 1778000100  # start of a 5-minute window


def sample(spark):
    """A quiet user, one whose token shows up elsewhere, and logs without user or time."""
    there = {"receive_epoch": T0 + 40, "client_ip": "203.0.113.8", "ip_class": "cloud", "ip_country": "FR"}
    logs = [{"user_id": "quiet", "receive_epoch": T0 + 17 * i, "client_ip": "192.0.2.77", "ip_class": "home", "ip_country": "KR",
             "jwt_id": "mine"} for i in range(6)]
    logs += [{"user_id": "moved", "receive_epoch": T0 + 3, "client_ip": "192.0.2.5", "ip_class": "home", "ip_country": "KR",
              "jwt_id": "both", "uri": "/api/addresses/9"},
             {"user_id": "moved", "jwt_id": "both", "status": 503, "baseline_eligible": False, **there},
             {"user_id": "moved", "receive_epoch": T0 + 41, "jwt_id": "", "client_ip": "", "status": 301},
             {"user_id": "", "receive_epoch": T0}, {"user_id": None, "receive_epoch": T0}, {"user_id": "quiet", "receive_epoch": None}]
    return make_logs(spark, logs)


def test_user_events(spark):
    got = {r["target_id"]: r for r in rows(U.user_events(sample(spark), CFG))}
    assert set(got) == {"quiet", "moved", ""}
    a, b = got["quiet"], got["moved"]
    assert (a["request_count"], a["ip_count"], a["jti_count"], a["unique_uris_count"]) == (6, 1, 1, 1)
    assert a["token_replay_meta"] == {"jti_count_with_class_crossing": 0, "jti_count_with_country_crossing": 0}
    assert b["token_replay_meta"] == {"jti_count_with_class_crossing": 1, "jti_count_with_country_crossing": 1}
    assert (b["request_count"], b["success_count"], b["error_count"], b["error_rate"]) == (3, 1, 1, 0.3333)
    assert (b["ip_count"], b["jti_count"], b["unique_uris_count"], b["suspicious_uri_count"]) == (2, 1, 2, 1)
    assert a["is_baseline_eligible"] and not b["is_baseline_eligible"] and b["response_bytes_avg"] == 2000.0
    assert got[""]["jti_count"] == 0 and got[""]["token_violation"]["violating_samples"] == []
    where = {(r["jti"], r["crossing_type"], r["kind"], r["member"]) for r in rows(U.replay_samples(sample(spark)))}
    assert where == {("both", "ip_class", k, m) for k, m in (
        ("ip_set", "192.0.2.5"), ("ip_set", "203.0.113.8"), ("ip_class_set", "home"), ("ip_class_set", "cloud"),
        ("ip_country_set", "KR"), ("ip_country_set", "FR"))}


def test_country_only_crossing_and_missing_ip(spark):
    base = {"user_id": "C", "receive_epoch": T0, "ip_class": "cloud"}
    logs = make_logs(spark, [
        {**base, "jwt_id": "j1", "client_ip": "1.1.1.1", "ip_country": "US"},
        {**base, "jwt_id": "j1", "client_ip": "1.1.1.2", "ip_country": "KR"},
        {**base, "jwt_id": "j2", "client_ip": None, "ip_country": "US"},   # no address: not a replay
        {**base, "jwt_id": "j2", "client_ip": "", "ip_country": "KR"}])
    got = rows(U.replay_samples(logs))
    assert {(g["jti"], g["crossing_type"]) for g in got} == {("j1", "ip_country")}
    w = rows(U.user_windows(logs, CFG))[0]
    assert (w["class_crossings"], w["country_crossings"]) == (0, 1)


def test_large_sets_are_rows(spark):
    """One user holds most rows: documents count exactly, the member rows are complete."""
    logs = [{"user_id": "hot", "receive_epoch": T0, "jwt_id": f"j{i:04}", "client_ip": f"10.{i // 250}.0.{i % 250}"} for i in range(2000)]
    logs += [{"user_id": f"u{i}", "receive_epoch": T0, "jwt_id": f"j{i}"} for i in range(5)]
    df = make_logs(spark, logs)
    got = {r["target_id"]: r for r in rows(U.user_events(df, CFG))}
    assert (got["hot"]["jti_count"], got["hot"]["ip_count"]) == (2000, 2000)
    members = U.user_members(df).filter("user_id = 'hot'")
    assert members.filter("kind = 'jti_set'").count() == 2000 == members.filter("kind = 'ip_set'").count()


def test_samples_are_trimmed_before_the_shuffle(spark):
    plan = U.user_events(sample(spark), CFG)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_user_window_aggregation_is_hash_based(spark):
    plan = U.user_windows(sample(spark), CFG)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and plan.count("Exchange") == 2


def test_ip_events(spark):
    logs = [{"client_ip": "203.0.113.4", "ip_class": "cloud", "receive_epoch": T0 + 5 * i, "uri": f"/api/orders/{i}", "user_id": f"taken{i}",
             "user_agent": "bot"} for i in range(45)]
    logs += [{"client_ip": "192.0.2.31", "ip_class": "home", "receive_epoch": T0 + 40 * i, "user_id": "resident", "user_agent": "phone",
              "method": "POST" if i else "GET"} for i in range(4)]
    logs += [{"client_ip": "", "receive_epoch": T0}, {"client_ip": "192.0.2.200", "receive_epoch": None}]
    df = make_logs(spark, logs)
    got = {(r["target_id"], r["window_size"]): r for r in rows(I.ip_events(df))}
    assert len(got) == 6
    swept, home = got["203.0.113.4", "5min"], got["192.0.2.31", "24h"]
    assert (swept["unique_subs_count"], swept["suspicious_uri_count"], swept["ip_class"]) == (45, 45, "cloud")
    assert (home["unique_subs_count"], home["request_count"], home["ip_class"]) == (1, 4, "home")
    members = {(r["client_ip"], r["kind"], r["member"]) for r in rows(I.ip_members(df).filter("window_size = '1h'"))}
    assert {m for ip, k, m in members if (ip, k) == ("192.0.2.31", "request_methods")} == {"GET", "POST"}
    assert {m for ip, k, m in members if (ip, k) == ("203.0.113.4", "ua_set")} == {"bot"}
    assert sum((ip, k) == ("203.0.113.4", "sub_set") for ip, k, _ in members) == 45


def test_ip_head_is_the_first_log_nulls_included(spark):
    logs = [{"client_ip": "1.1.1.1", "receive_epoch": T0 + 9, "ip_class": "cloud", "ip_org": "late"},
            {"client_ip": "1.1.1.1", "receive_epoch": T0 + 2, "ip_class": None, "ip_org": "early"},
            {"client_ip": "1.1.1.1", "receive_epoch": T0 + 400, "ip_class": "unknown", "ip_org": "later"}]
    got = {(r["window_size"], r["win"]): r for r in rows(I.ip_windows(make_logs(spark, logs)))}
    first = got[("5min", T0)]
    assert first["ip_class"] is None and first["ip_org"] == "early"
    assert got[("5min", T0 + 300)]["ip_org"] == "later" and got[("24h", T0 - T0 % 86400)]["ip_org"] == "early"


def test_ip_windows_against_brute_force(spark):
    rng = random.Random(5)
    logs = [{"client_ip": "hot" if rng.random() < .4 else f"ip{rng.randint(0, 5)}",
             "receive_epoch": T0 + rng.randint(0, 200000), "user_id": rng.choice([None, "", "a", "b", "c", "d"]),
             "status": rng.choice([200, 404]), "bytes_sent": rng.randint(0, 99)} for _ in range(600)]
    want = defaultdict(lambda: [0, 0, set(), 0])
    for g in logs:
        for label, s in (("5min", 300), ("1h", 3600), ("24h", 86400)):
            w = want[(g["client_ip"], label, g["receive_epoch"] // s * s)]
            w[0] += 1
            w[1] += g["status"] >= 400
            w[2] |= {g["user_id"]} - {None, ""}
            w[3] += g["bytes_sent"]
    got = {(r["target_id"], r["window_size"], r["win"]): [r["request_count"], r["error_count"],
           r["unique_subs_count"], r["response_bytes_total"]] for r in rows(I.ip_windows(make_logs(spark, logs)))}
    assert got == {k: [v[0], v[1], len(v[2]), v[3]] for k, v in want.items()}
