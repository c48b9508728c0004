import datetime as dt
import glob
import json
import os
import random

from pyspark.sql import functions as F

from helpers import access, logs_of_docs, make_logs, raw_frame, rows
from logwarden.config import Config
from logwarden.operators import profiles as P
from logwarden.operators.baseline import compute_baseline
from logwarden.operators.ip_windows import ip_windows
from logwarden.operators.scoring import risk_scores
from logwarden.operators.user_windows import user_windows
from logwarden.plans import scoring as SC
from logwarden.plans.rule_batch import review_batch, run_rules, save_verdicts
from logwarden.plans.scoring import run_scoring, score_logs, update_profiles
from logwarden.sources import logs as scans
from logwarden.sources.sinks import write_daily
from logwarden.streaming import jobs, windows as ST

T0 = 1781049600
DAY = dt.date(2026, 6, 10)


def documents(seed=2, n=300, span=7200, numbered=True):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        at, user = T0 + rng.randint(0, span), rng.choice(["hot"] * 4 + ["a", "b", "c"])
        where = rng.choice([dict(ip_class="cgnat_kr", ip_country="KR", client_ip="192.0.2.1"),
                            dict(ip_class="cloud", ip_country="US", client_ip=f"203.0.113.{rng.randint(1, 9)}")])
        doc = access(at, user, rng.choice([None, f"{user}-{at // 3600}"]), issued=at - rng.choice([0, 30, 9000]),
                     uri=rng.choice(["/api/orders/1", "/admin/x", "/p"]), bytes_sent=rng.randint(0, 999), status=rng.choice([200, 404]), **where)
        out.append({"log_id": i, **doc} if numbered else doc)
    return out


def clock():
    """A log so late that it closes every window."""
    return {"log_id": 9999, **access(T0 + 10 * 86400, "clock", "t")}


def table(df):
    return sorted(repr(r) for r in rows(df))


def test_daily_sink_replaces_its_run_on_any_day(spark, tmp_path):
    df, path = spark.range(3), str(tmp_path / "t")
    assert write_daily(df, path, "r1", DAY)["saved"] == 3
    assert write_daily(df, path, "r1", DAY + dt.timedelta(days=1))["saved"] == 3  # a retry after midnight
    assert write_daily(spark.range(2), path, "2026-06-10T00:00", DAY)["saved"] == 2
    assert write_daily(spark.range(0), path, "r3", DAY)["saved"] == 0
    assert sorted((r.id, r.run, str(r.ingest_date)) for r in spark.read.parquet(path).collect()) == [
        (0, "2026-06-10T00:00", "2026-06-10"), (0, "r1", "2026-06-11"), (1, "2026-06-10T00:00", "2026-06-10"), (1, "r1", "2026-06-11"),
        (2, "r1", "2026-06-11")]


def test_range_scans(spark, tmp_path):
    docs = documents()
    raw = raw_frame(spark, docs).withColumn("dt", F.to_date(F.substring("@timestamp", 1, 10)))
    raw.write.partitionBy("dt").parquet(str(tmp_path / "days"))
    raw.drop("dt").write.parquet(str(tmp_path / "flat"))
    inside = [d["log_id"] for d in docs if "2026-06-10T00:10:00Z" <= d["@timestamp"] <= "2026-06-10T00:20:00Z"]
    for folder, filters in (("days", ["PartitionFilters: [isnotnull(dt", "GreaterThanOrEqual(`@timestamp`,2026-06-09)"]),
                            ("flat", ["PartitionFilters: []", "GreaterThanOrEqual(`@timestamp`,2026-06-09), LessThan(`@timestamp`"])):
        got = scans.read_logs(spark, str(tmp_path / folder), T0 + 600, T0 + 1200)
        assert sorted(r["log_id"] for r in rows(got)) == sorted(inside)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert all(f in plan for f in filters), plan
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text("\n".join(json.dumps(d) for d in docs))
    everything = scans.read_logs(spark, str(tmp_path / "j"), T0, T0 + 7200, fmt="json")
    assert everything.count() == 300
    first = scans.in_range(everything, T0, T0 + 7200, limit=7)
    order = sorted(docs, key=lambda d: (d["@timestamp"], d["log_id"]))[:7]
    assert [r["log_id"] for r in rows(first)] == [d["log_id"] for d in order]
    assert scans.of_user(everything, "a", T0 + 7200, 60).count() == sum(
        d["jwt"]["sub"] == "a" and d["@timestamp"] >= "2026-06-10T01:00:00Z" for d in docs)


def test_scoring_job_twice(spark, tmp_path):
    root, work, cfg = str(tmp_path / "out"), str(tmp_path / "work"), Config()
    logs = logs_of_docs(spark, documents())
    first = run_scoring(logs, root, "r1", work, cfg, day=DAY, as_of="2026-06-10T12:00:00Z")
    again = run_scoring(logs, root, "r1", work, cfg, day=DAY + dt.timedelta(days=1), as_of="2026-06-10T12:00:00Z")
    assert first["user_events"]["saved"] == again["user_events"]["saved"] > 0
    assert spark.read.parquet(f"{root}/user_events").count() == first["user_events"]["saved"]
    stored = spark.read.parquet(f"{root}/baseline")
    assert stored.count() == 6
    direct = score_logs(logs, work, cfg, as_of="2026-06-10T12:00:00Z")
    keep = ["target_type", "target_id", "window_start", "window_size", "total_score", "dominant_factor",
            "factor_breakdown", "attacker_level", "ip_user_diversity_meta", "ip_class"]
    assert table(again["risk"].select(*keep)) == table(direct.select(*keep))
    # two runs of a baseline: the newest counts
    write_daily(stored.drop("run", "ingest_date").withColumn("mean", F.lit(-1.0)), f"{root}/baseline", "r0", DAY)
    users, ips = user_windows(logs, cfg), ip_windows(logs)
    assert table(risk_scores(users, ips, spark.read.parquet(f"{root}/baseline"), cfg).select(*keep)) == table(direct.select(*keep))
    # the job's last step: alerts are recorded once for each window, profiles written
    done = first["profiles"]
    alerts = direct.filter("target_type = 'user' AND total_score >= 50").count()
    assert (done["created"], done["failed"], done["recorded"], done["skipped"]) == (4, 0, alerts, direct.count() - alerts) and alerts > 0
    assert done["updated"] == users.count() and (again["profiles"]["created"], again["profiles"]["updated"]) == (0, 0)
    profiles = {r["user_id"]: r for r in rows(spark.read.parquet(f"{root}/user_profiles"))}
    assert sum(p["risk"]["total_alerts"] for p in profiles.values()) == alerts
    assert profiles["hot"]["risk"]["trust_level"] == "suspicious"
    assert "risk" in run_scoring(logs, root, "dry", work, cfg, write=False)


def test_job_keeps_every_member(spark, tmp_path):
    logs = make_logs(spark, [{"user_id": "hot", "receive_epoch": T0, "jwt_id": f"j{i}", "client_ip": "203.0.113.3", "user_agent": f"a{i}"} for i in range(2000)]
                     + [{"user_id": "hot", "receive_epoch": T0 + 1, "jwt_id": f"j{i}", "client_ip": "192.0.2.3", "ip_class": c}
                        for i in range(700) for c in ("home", "cloud")])
    run_scoring(logs, str(tmp_path), "r", str(tmp_path / "work"), day=DAY)
    members = spark.read.parquet(f"{tmp_path}/user_members")
    assert members.filter("kind = 'jti_set'").count() == 2000
    assert spark.read.parquet(f"{tmp_path}/ip_members").filter("kind = 'ua_set' AND window_size = '24h'").count() == 2000
    assert spark.read.parquet(f"{tmp_path}/replay_samples").select("jti").distinct().count() == 700


def test_scoring_plans_stay_small(spark, tmp_path):
    logs, work = logs_of_docs(spark, documents()), str(tmp_path)
    risk = SC.score_with_feedback(logs, work)
    plans = [risk, risk.filter("total_score >= 50"), P.alert_history(risk), score_logs(logs, work)]
    assert max(len(df._jdf.queryExecution().optimizedPlan().toString()) for df in plans) < 200_000


def test_logs_without_an_id(spark):
    """Windows, claims and profiles are those of the same documents with ids; deliveries are told from documents."""
    docs = list({d["@timestamp"]: d for d in documents(n=200)}.values())  # one log a second, so ids don't decide the order
    bare = [{k: v for k, v in d.items() if k != "log_id"} for d in docs]
    with_id, without = logs_of_docs(spark, docs), logs_of_docs(spark, bare + bare[:50])
    assert without.select("log_id").distinct().count() == len(docs) and without.filter("log_id IS NULL OR log_id < 0").isEmpty()
    once = without.dropDuplicates(["log_id"])
    assert table(user_windows(once)) == table(user_windows(with_id))
    assert table(ip_windows(once)) == table(ip_windows(with_id))
    assert table(P.user_profiles(P.profile_state(once), T0)) == table(P.user_profiles(P.profile_state(with_id), T0))


def test_rule_job(spark, tmp_path):
    logs, root = logs_of_docs(spark, documents()), str(tmp_path)
    out = run_rules(logs, root, "r1", day=DAY)
    assert out["alerts"]["saved"] == spark.read.parquet(f"{root}/alerts").count() > 0
    requests = review_batch(logs)
    answers = requests.select("user_id", "review_win", F.lit('{"is_anomaly": true}').alias("text"))
    saved = save_verdicts(requests, answers, root, "r1-review", day=DAY)
    stored = spark.read.parquet(f"{root}/alerts")
    assert saved["saved"] == requests.count() == stored.filter("alert_type = 'llm' AND layer = 2").count() > 0


def feed(tmp_path, *batches):
    folder = tmp_path / "in"
    folder.mkdir()
    for i, docs in enumerate(batches):
        file = folder / f"{i:03}.json"
        file.write_text("\n".join(json.dumps(d) for d in docs))
        os.utime(file, (1700000000 + i, 1700000000 + i))  # Spark reads files in this order
    return str(folder)


def drain(df, tmp_path, name):
    query = ST.write_stream(df, str(tmp_path / name), str(tmp_path / f"{name}-state"))
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(str(tmp_path / name))


def test_stream_equals_batch(spark, tmp_path):
    docs = sorted(documents(), key=lambda d: d["@timestamp"])
    tick = clock()
    # the second file repeats the end of the first, as an overlapping poll would
    folder = feed(tmp_path, docs[:150], docs[140:], [tick])
    logs = ST.stream_logs(spark, folder, files_per_trigger=1)
    batch = logs_of_docs(spark, docs)
    assert table(drain(ST.stream_user_windows(logs), tmp_path, "u")) == table(user_windows(batch))
    got = drain(ST.stream_ip_windows(logs, "24h"), tmp_path, "i")
    assert table(got) == table(ip_windows(batch).filter("window_size = '24h'").select(*got.columns))


def test_late_logs_are_dropped(spark, tmp_path):
    def doc(log_id, at):
        return [{"log_id": log_id, **access(at, "a", "j")}]

    # Spark compares late rows with the watermark of the batch before
    folder = feed(tmp_path, doc(1, T0 + 3600), doc(2, T0 + 3601), doc(3, T0), doc(4, T0 + 86400))
    got = rows(drain(ST.stream_user_windows(ST.stream_logs(spark, folder, files_per_trigger=1)), tmp_path, "u"))
    assert [(g["win"], g["request_count"]) for g in got] == [(T0 + 3600, 2)]


def test_streaming_jobs(spark, tmp_path):
    docs = sorted(documents(), key=lambda d: d["@timestamp"])
    tick = clock()
    folder = feed(tmp_path, docs[:150], docs[145:], [tick])
    logs = ST.stream_logs(spark, folder, files_per_trigger=1)
    batch = logs_of_docs(spark, docs)
    users = user_windows(batch)
    baseline = compute_baseline(users, ip_windows(batch))
    stored = str(tmp_path / "baseline")
    baseline.write.parquet(stored)
    for query in jobs.score_streams(logs, spark.read.parquet(stored), str(tmp_path), str(tmp_path / "s1")):
        query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "risk_scores"))
    want = risk_scores(users, ip_windows(batch), baseline)
    keep = ["target_type", "target_id", "window_start", "window_size", "total_score", "dominant_factor", "attacker_level"]
    assert table(got.select(*keep)) == table(want.select(*keep))
    store, work = str(tmp_path / "profiles"), str(tmp_path / "work")
    whole = table(P.user_profiles(P.profile_state(logs_of_docs(spark, [*docs, tick])), T0))
    for checkpoint in ("s2", "s3"):  # from a new checkpoint everything comes again, under another stream's name
        jobs.profile_stream(logs, store, str(tmp_path / checkpoint), work).awaitTermination()
        assert table(P.user_profiles(P.merged(SC.read_parts(spark, store)), T0)) == whole
    names = {r.run for r in SC.committed(spark, store).collect()}
    assert len(names) >= 6 and len({n.rsplit("-", 1)[0] for n in names}) == 2


def test_a_drain_emits_what_the_last_one_held_back(spark, tmp_path):
    """Append mode holds a window until the watermark passes it; the next drain of the same checkpoint emits it."""
    docs = sorted(documents(), key=lambda d: d["@timestamp"])
    folder = feed(tmp_path, docs)
    logs = ST.stream_logs(spark, folder, files_per_trigger=1)
    held = user_windows(logs_of_docs(spark, docs)).count() - drain(ST.stream_user_windows(logs), tmp_path, "u").count()
    assert held > 0
    (tmp_path / "in" / "zzz.json").write_text(json.dumps(clock()))
    assert table(drain(ST.stream_user_windows(logs), tmp_path, "u")) == table(user_windows(logs_of_docs(spark, docs)))


def test_profiles_of_any_split(spark, tmp_path):
    """Batches that end inside a window, overlap, repeat and come late: every log counts once."""
    docs, store, work = documents(n=200), str(tmp_path / "p"), str(tmp_path / "work")
    logs = logs_of_docs(spark, docs)
    whole = table(P.user_profiles(P.profile_state(logs), T0))
    cut = F.col("receive_epoch") < T0 + 3600 + 77
    late = F.col("log_id") % 10 == 3
    assert update_profiles(spark, logs.filter(cut & ~late), store, "a", work)["version"] == 1
    assert update_profiles(spark, logs.filter(~late), store, "b", work)["created"] == 0
    assert update_profiles(spark, logs.filter(late), store, "c", work)["updated"] > 0
    assert update_profiles(spark, logs, store, "a", work)["updated"] == 0  # a repeated run
    assert table(P.user_profiles(P.merged(SC.read_parts(spark, store)), T0)) == whole
    assert SC.compact_profiles(spark, store, DAY) == 5
    assert table(P.user_profiles(P.merged(SC.read_parts(spark, store)), T0)) == whole
    assert update_profiles(spark, logs, store, "d", work)["updated"] == 0  # ids seen outlive the compaction
    one = rows(SC.profile_of(spark, store, "hot", T0))
    assert len(one) == 1 and repr(one[0]) in whole
    assert SC.profile_exists(spark, store, "hot") and not SC.profile_exists(spark, store, "nobody")
    assert rows(SC.profile_of(spark, store, "nobody", T0)) == [] and not SC.profile_exists(spark, str(tmp_path / "new"), "hot")


def test_a_day_is_added_without_touching_others(spark, tmp_path):
    store, work = str(tmp_path / "p"), str(tmp_path / "work")
    files = lambda: {f: os.path.getmtime(f) for f in glob.glob(f"{store}/*/commit=*/day=*/*.parquet")}
    update_profiles(spark, logs_of_docs(spark, documents(n=50)), store, "a", work)
    before = files()
    later = [{**d, "log_id": 1000 + i, "@timestamp": d["@timestamp"].replace("06-10", "06-12")} for i, d in enumerate(documents(seed=5, n=50))]
    update_profiles(spark, logs_of_docs(spark, later), store, "b", work)
    after = files()
    assert all(after[f] == t for f, t in before.items())
    assert {f.split("day=")[1][:10] for f in after if f not in before} == {"2026-06-12"}
