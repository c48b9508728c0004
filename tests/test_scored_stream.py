"""The stream that files windows, risk, alerts and profiles in one store, against the batch job."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from helpers import logs_of_docs, raw_frame, rows
from logwarden.config import Config
from logwarden.operators import profiles as P
from logwarden.operators.baseline import compute_baseline
from logwarden.operators.ip_windows import ip_windows
from logwarden.operators.normalize import normalize_logs
from logwarden.operators.scoring import risk_scores
from logwarden.operators.user_windows import user_windows
from logwarden.sources import sinks
from logwarden.sources.sinks import StoreConflict, committed, write_commit
from logwarden.streaming import scored as S
from logwarden.streaming import windows as ST
from test_jobs import T0, documents, feed, table

KEEP = ["target_type", "target_id", "window_start", "window_size", "total_score", "dominant_factor", "factor_breakdown", "attacker_level",
        "triggered_rules", "ip_user_diversity_meta", "ip_class", "ip_country"]
CFG = Config(min_samples=5)


@pytest.fixture
def pii(spark):
    return spark.createDataFrame([("hot", 12, 0, False), ("a", 0, 6, False)], "user_id string, email long, phone long, doorlock_with_address boolean")


def batch_of(spark, docs, pii):
    logs = logs_of_docs(spark, docs)
    users, ips = user_windows(logs, CFG), ip_windows(logs)
    baseline = compute_baseline(users, ips, CFG)
    risk = risk_scores(users, ips, baseline, CFG, pii)
    history = P.alert_history(risk, CFG, T0)
    return baseline, table(risk.select(*KEEP)), table(P.user_profiles(P.profile_state(logs), T0, history, CFG))


def test_stream_with_late_logs_equals_batch(spark, tmp_path, pii):
    docs = sorted(documents(n=150, span=20_000), key=lambda d: d["@timestamp"])
    rnd = random.Random(3)
    late = [d for d in docs[:80] if rnd.random() < 0.05]
    rest = [d for d in docs if d not in late]
    baseline, want, profiles = batch_of(spark, docs, pii)
    part, path, work = len(rest) // 2, str(tmp_path / "store"), str(tmp_path / "work")
    parts = [rest[:part], rest[part - 20:], late]  # the second repeats the end of the first
    for p in parts:
        rnd.shuffle(p)
    folder = feed(tmp_path, *parts)
    logs = ST.stream_logs(spark, folder, files_per_trigger=1)
    S.risk_stream(logs, path, str(tmp_path / "c1"), work, baseline, pii, CFG).awaitTermination()
    before = S.stored_risk(spark, path, CFG).count()
    S.close_windows(spark, path, work, baseline, pii, CFG)
    risk = S.stored_risk(spark, path, CFG)
    assert before < risk.count() and table(risk.select(*KEEP)) == want
    assert table(S.stored_profiles(spark, path, T0, CFG)) == profiles
    filed = rows(S.late_logs(spark, path, CFG))
    assert sorted(r["log_id"] for r in filed) == sorted(d["log_id"] for d in late) and all(r["seconds_late"] > 300 for r in filed)
    assert sum(r["logs"] for r in rows(S.late_counts(spark, path, CFG))) == len(late) > 2
    # a late log withdraws what was scored without it
    versions = rows(S.read_store(spark, path, ["risk"], CFG)["risk"].groupBy(*S.TARGET).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    assert versions
    # the same files under a new checkpoint are other batches of the same logs
    S.risk_stream(logs, path, str(tmp_path / "c2"), work, baseline, pii, CFG).awaitTermination()
    assert table(S.stored_risk(spark, path, CFG).select(*KEEP)) == want and table(S.stored_profiles(spark, path, T0, CFG)) == profiles
    assert S.late_logs(spark, path, CFG).count() == len(late)
    # and a compaction changes neither
    S.compact_store(spark, path, dt.date(2026, 6, 11), CFG)
    assert table(S.stored_risk(spark, path, CFG).select(*KEEP)) == want and table(S.stored_profiles(spark, path, T0, CFG)) == profiles


def test_any_batch_again_changes_nothing(spark, tmp_path, pii):
    docs = documents(n=120, span=4000)
    path, work = str(tmp_path / "store"), str(tmp_path / "work")
    baseline, _, _ = batch_of(spark, docs, pii)
    halves = [logs_of_docs(spark, docs[:60]), logs_of_docs(spark, docs[60:])]
    for i, half in enumerate(halves):
        assert S.file_batch(spark, half, f"b{i}", path, work, baseline, pii, CFG)["logs"] == 60
    want = table(S.stored_risk(spark, path, CFG)), table(S.stored_profiles(spark, path, T0, CFG)), S.late_logs(spark, path, CFG).count()
    for name in ("b0", "b1"):
        assert S.file_batch(spark, halves[int(name[1])], name, path, work, baseline, pii, CFG)["version"] is None
    assert S.file_batch(spark, halves[0], "under another name", path, work, baseline, pii, CFG)["logs"] == 0
    assert S.file_batch(spark, halves[0].limit(0), "nothing", path, work, baseline, pii, CFG)["late"] == 0
    assert want == (table(S.stored_risk(spark, path, CFG)), table(S.stored_profiles(spark, path, T0, CFG)), S.late_logs(spark, path, CFG).count())


def test_a_failed_batch_does_not_count(spark, tmp_path, pii, monkeypatch):
    docs = documents(n=60, span=2000)
    path, work = str(tmp_path / "store"), str(tmp_path / "work")
    baseline, want, profiles = batch_of(spark, docs, pii)
    logs = logs_of_docs(spark, docs)

    def lost(*_args, **_more):
        raise RuntimeError("the driver is lost before the commit")

    monkeypatch.setattr(S, "finish_commit", lost)
    with pytest.raises(RuntimeError):
        S.file_batch(spark, logs, "b", path, work, baseline, pii, CFG)
    monkeypatch.undo()
    assert S.stored_risk(spark, path, CFG).count() == 0 and S.store_clock(spark, path, CFG) is None
    S.file_batch(spark, logs, "b", path, work, baseline, pii, CFG)
    S.close_windows(spark, path, work, baseline, pii, CFG)
    assert table(S.stored_risk(spark, path, CFG).select(*KEEP)) == want and table(S.stored_profiles(spark, path, T0, CFG)) == profiles


def test_a_second_writer_is_refused(spark, tmp_path):
    path = str(tmp_path / "store")
    rows_ = spark.range(3).select("id", F.lit(dt.date(2026, 1, 1)).alias("day"))
    assert write_commit(spark, path, {"t": rows_}, "a") == 1
    assert write_commit(spark, path, {"t": rows_}, "b", after=1) == 2
    with pytest.raises(StoreConflict):
        write_commit(spark, path, {"t": rows_}, "c", after=1)  # has read version 1 only
    sinks.write_parts(path, "late-comer", {"t": rows_})
    spark.range(1).select(F.lit("x").alias("commit"), F.lit("y").alias("run"), F.lit(None).cast("date").alias("through")).write.parquet(f"{path}/commits/version=3")
    with pytest.raises(StoreConflict):
        sinks.finish_commit(spark, path, "late-comer", "c", 2)
    assert committed(spark, path).count() == 3


def test_faults_are_not_a_new_store(spark, tmp_path):
    path = str(tmp_path / "store")
    (tmp_path / "store").mkdir()
    (tmp_path / "store" / "commits").mkdir()
    (tmp_path / "store" / "commits" / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        committed(spark, path).collect()
    assert committed(spark, str(tmp_path / "none")).count() == 0


def test_scans_read_what_a_query_uses(spark, tmp_path):
    raw_frame(spark, documents(n=20)).write.parquet(str(tmp_path / "raw"))
    logs = normalize_logs(spark.read.parquet(str(tmp_path / "raw")), numbered=True)
    plan = logs.select("client_ip", "receive_epoch")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<@timestamp:string,client_ip:string>" in plan and "xxhash64" not in plan
    plan = logs.select("log_id", "user_id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<log_id:bigint" in plan and "user_agent" not in plan.split("ReadSchema")[1] and "xxhash64" not in plan
