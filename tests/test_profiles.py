import math
import random

from pyspark.sql import functions as F

from helpers import make_logs, rows
from logwarden.config import Config
from logwarden.operators import profiles as P

CFG = Config()
T0 = 1778000100
DAY = 86400


def circular(hours):
    angles = [h * 2 * math.pi / 24 for h in hours]
    s, c = (sum(f(a) for a in angles) / len(angles) for f in (math.sin, math.cos))
    r = math.hypot(s, c)
    return round((math.atan2(s, c) * 24 / (2 * math.pi)) % 24, 3), round(
        0.0 if r >= 1 else math.sqrt(-2 * math.log(r)) * 24 / (2 * math.pi), 3)


def test_circular_hours(spark):
    sets = [[22, 23, 0, 1, 2], [12, 13, 14], [5], list(range(24)), [0, 12], []]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "i int, h array<int>")
    mean, spread = P.circular_hours(F.col("h"))
    got = [(r.m, r.s) for r in df.select("i", mean.alias("m"), spread.alias("s")).orderBy("i").collect()]
    assert got[0] == (circular(sets[0])[0] % 24, circular(sets[0])[1]) and got[0][0] == 0.0
    assert got[1] == circular(sets[1]) and 12 <= got[1][0] <= 14
    assert got[2] == (5.0, 0.0)
    assert got[3] == (0.0, 12.0) and got[4] == (0.0, 12.0)  # evenly spread: no direction
    assert got[5] == (None, None)


def test_trust_levels(spark):
    now = T0 + 100 * DAY
    df = spark.createDataFrame([(0, now - 3 * DAY, 0), (1, now - 10 * DAY, 0), (2, now - 20 * DAY, None),
                                (3, now - 20 * DAY, 1), (4, now - 3 * DAY, 5), (5, None, None)],
                               "i int, seen bigint, alerts int")
    level = P.trust_level(F.col("seen"), F.col("alerts"), now)
    assert [r.t for r in df.select("i", level.alias("t")).orderBy("i").collect()] == [
        "new", "learning", "established", "suspicious", "suspicious", "new"]


def test_recent_tokens_and_endpoints(spark):
    logs = make_logs(spark, [{"user_id": "u", "receive_epoch": T0 + i * 300, "jwt_id": f"jti-{i:02}",
                              "kid": f"k{i % 7}", "uri": f"/p{i % 40}?q={i}"} for i in range(80)]
                     + [{"user_id": "u", "receive_epoch": T0 + 90 * 300, "jwt_id": "jti-05", "uri": "/p0"}])
    got = rows(P.recent_tokens(P.profile_state(logs)["tokens"], CFG))[0]
    assert got["known_jtis"] == [f"jti-{i:02}" for i in range(31, 80)] + ["jti-05"]
    assert got["known_kids"] == [f"k{i % 7}" for i in range(75, 80)] and got["known_lsids"] == []
    top = rows(P.top_endpoints(P.profile_state(logs)["endpoints"], CFG).orderBy("rank"))
    assert len(top) == 30 and (top[0]["path"], top[0]["count"]) == ("/p0", 3) and top[1]["count"] == 2


def random_logs(rng, n, start=T0, span=6 * DAY):
    out = []
    for i in range(n):
        at = start + rng.randint(0, span)
        out.append({"log_id": rng.randint(0, 10**9), "user_id": rng.choice(["hot"] * 5 + ["a", "b", "", None]),
                    "receive_epoch": at, "jwt_id": rng.choice([None, "", f"j{rng.randint(0, 90)}"]),
                    "kid": rng.choice(["k1", "k2"]), "session_id": f"s{rng.randint(0, 30)}",
                    "client_ip": rng.choice(["", None, f"1.1.{rng.randint(0, 40)}.1"]),
                    "ip_class": rng.choice([None, "", "cloud"]), "ip_country": rng.choice(["KR", None]),
                    "uri": f"/p{rng.randint(0, 50)}", "status": rng.choice([200, 201, 302, 404, 500, 0]),
                    "bytes_sent": rng.randint(0, 5000), "auth_time": rng.choice([None, 0, at - 50]),
                    "jwt_issued_at": at, "jwt_expires_at": rng.choice([at + 600, at, None]),
                    "issuer": rng.choice(["i1", "", None]), "audiences": rng.choice([[], ["a1"], ["a2"]])})
    return out


def document(state):
    return sorted((repr(r) for r in rows(P.user_profiles(state, T0 + 30 * DAY, cfg=CFG))))


def test_partials_add_up_in_any_order_and_repeats_change_nothing(spark):
    logs = list({g["log_id"]: g for g in random_logs(random.Random(3), 500)}.values())
    cut = T0 + 3 * DAY + 77  # inside a window
    early = make_logs(spark, [g for g in logs if g["receive_epoch"] < cut])
    late = make_logs(spark, [g for g in logs if g["receive_epoch"] >= cut])
    everything = make_logs(spark, logs)
    whole = document(P.profile_state(everything))
    a, b = P.partials(early), P.partials(late)
    assert document(P.merged(P.together(a, b))) == whole == document(P.merged(P.together(b, a)))
    again = P.partials(P.unseen(everything.unionByName(late), a["seen"]))  # repeats, and overlaps ``early`` completely
    assert document(P.merged(P.together(a, again))) == whole
    odd = make_logs(spark, [g for i, g in enumerate(logs) if i % 2])
    even = make_logs(spark, [g for i, g in enumerate(logs) if not i % 2])
    assert document(P.merged(P.together(P.partials(odd), P.partials(even)))) == whole


def test_known_sets_come_from_all_addresses(spark):
    busy = [{"user_id": "u", "receive_epoch": T0 + i, "client_ip": f"192.0.2.{i % 25}", "ip_country": "KR", "ip_class": "home"} for i in range(75)]
    once = [{"user_id": "u", "receive_epoch": T0, "client_ip": "203.0.113.1", "ip_country": "RU", "ip_class": "cloud"}]
    loc = rows(P.user_profiles(P.profile_state(make_logs(spark, busy + once)), T0))[0]["location"]
    assert loc["known_countries"] == ["KR", "RU"] and loc["known_ip_classes"] == ["cloud", "home"] and loc["known_ip_count"] == 20


def test_sessions_are_counted_beyond_the_list(spark):
    logs = make_logs(spark, [{"user_id": "u", "receive_epoch": T0 + 300 * i, "session_id": f"s{i:02}"} for i in range(33)])
    jwt = rows(P.user_profiles(P.profile_state(logs), T0))[0]["jwt_pattern"]
    assert jwt["known_lsid_count"] == 33 and jwt["known_lsids"] == [f"s{i:02}" for i in range(13, 33)]


def test_profile_facts(spark):
    logs = make_logs(spark, [
        {"user_id": "u", "receive_epoch": T0, "status": 200, "bytes_sent": 100, "client_ip": "1.1.1.1",
         "issuer": "first", "client_id": "c1", "auth_time": T0 - 9, "jwt_issued_at": 5, "jwt_expires_at": 605,
         "audiences": ["x"]},
        {"user_id": "u", "receive_epoch": T0 + 1, "status": 302, "bytes_sent": 50, "client_ip": "1.1.1.1",
         "ip_class": "cloud", "issuer": "not the head", "auth_time": T0 - 30},
        {"user_id": "u", "receive_epoch": T0 + 2 * DAY, "status": 500, "bytes_sent": 0, "client_ip": "2.2.2.2",
         "ip_class": "cgnat_kr", "ip_country": "KR", "issuer": "", "client_id": "c2", "auth_time": T0 + DAY}])
    got = rows(P.user_profiles(P.profile_state(logs), T0 + 10 * DAY))[0]
    b, j, loc = got["behavior"], got["jwt_pattern"], got["location"]
    assert (b["requests_total"], b["success_total"], b["error_total"], b["error_ratio"]) == (3, 1, 1, 0.3333)
    assert b["status_distribution"] == {"s2xx": 1, "s3xx": 1, "s4xx": 0, "s5xx": 1}
    assert (b["requests_per_window_mean"], b["requests_per_window_max"]) == (1.5, 2)
    assert (j["typical_issuer"], j["typical_client_id"], j["typical_token_lifetime"]) == ("first", "c2", 600)
    assert (j["first_auth"], j["last_auth"], j["typical_audiences"]) == (T0 - 30, T0 + DAY, ["x"])
    assert loc["primary_ip"] == "1.1.1.1" and loc["known_ip_classes"] == ["cgnat_kr", "cloud"]
    assert loc["known_ips"][0]["ip_class"] == "cloud" and loc["known_ips"][0]["first_seen"] == T0
    assert got["total_active_days"] == 3 and got["risk"]["trust_level"] == "learning"


def test_alert_history(spark):
    risk = spark.createDataFrame([
        ("user", "u", 100, 80, "token_replay", "L2", False, []),
        ("user", "u", 200, 60, "token_violation", "L4", True, ["T002", "T007"]),
        ("user", "u", 300, 55, "request_burst", "L4(Slow & Low)", False, None),
        ("user", "u", 400, 49, "token_violation", "L4", True, ["T001"]),
        ("ip", "u", 500, 100, "ip_user_diversity", "L4", True, None), ("user", "", 1, 90, "x", "L2", False, None)],
        "target_type string, target_id string, win bigint, total_score int, dominant_factor string, "
        "attacker_level string, data_exfiltration_detected boolean, triggered_rules array<string>")
    got = rows(P.alert_history(risk, CFG, as_of=86400 + 150))
    assert got == [{
        "user_id": "u", "total_alerts": 3, "last_alert_epoch": 300, "last_alert_dominant_factor": "request_burst",
        "last_alert_rule": "T002", "max_score_seen": 80, "max_attacker_level_seen": "L4",
        "max_severity_seen": "critical", "data_exfiltration_ever": True, "alerts_last_24h": 2, "alerts_last_7d": 3,
        "alerts_last_30d": 3}]
    assert rows(P.recording_counts(risk, CFG)) == [{"recorded": 3, "skipped": 2}]
    state = P.profile_state(make_logs(spark, [{"user_id": "other", "receive_epoch": T0}]))
    both = {r["user_id"]: r for r in rows(P.user_profiles(state, T0, P.alert_history(risk, CFG)))}
    assert set(both) == {"u", "other"} and both["u"]["risk"]["trust_level"] == "suspicious"
    assert both["u"]["first_seen"] is None and both["other"]["risk"]["total_alerts"] == 0
