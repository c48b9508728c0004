"""The baseline of stored days against the baseline of their windows."""

import datetime as dt
import random

import pytest

from helpers import rows
from logwarden.config import BASELINE_METRICS, Config
from logwarden.operators.baseline import compute_baseline
from logwarden.plans import baseline_days as BD
from logwarden.sources.sinks import Snapshot, StoreConflict

CFG, DAY, START = Config(), 86400, dt.date(2026, 5, 1)
EPOCH = int(dt.datetime(2026, 5, 1, tzinfo=dt.timezone.utc).timestamp())
USERS = "target_id string, win bigint, window_size string, request_count bigint, response_bytes_total bigint, is_baseline_eligible boolean"
IPS = "target_id string, win bigint, window_size string, unique_subs_count bigint, response_bytes_total bigint, is_baseline_eligible boolean"


def windows(spark, days, seed=1, scale=1):
    """Windows of a few targets on each day; one target holds a third of them, some are not eligible or say nothing."""
    rng, users, ips = random.Random(seed), [], []
    for day in days:
        for i in range(120):
            target = "busy" if i % 3 == 0 else f"u{rng.randrange(9)}"
            win = EPOCH + day * DAY + 300 * rng.randrange(288)
            users.append((target, win, "5min", rng.randrange(1, 40) * scale, rng.randrange(10**9), rng.choice([True, True, None, False])))
            for size, seconds in (("5min", 300), ("1h", 3600), ("24h", DAY)):
                ips.append((rng.choice(["10.0.0.1", "busy", None]), win - win % seconds, size, rng.randrange(6) * scale,
                            rng.choice([None, rng.randrange(10**9)]), True))
    return spark.createDataFrame(users, USERS), spark.createDataFrame(ips, IPS)


def upto(df, first, last):
    lo, hi = EPOCH + first * DAY, EPOCH + (last + 1) * DAY
    return df.filter(f"win >= {lo} AND win < {hi}")


def day(n):
    return START + dt.timedelta(days=n)


def by_metric(df):
    return {r["metric"]: {k: v for k, v in r.items() if k != "computed_at"} for r in rows(df)}


@pytest.fixture(scope="module")
def filed(spark, tmp_path_factory):
    users, ips = windows(spark, range(6))
    users, ips = users.cache(), ips.cache()
    path = str(tmp_path_factory.mktemp("baseline") / "store")
    for run, first, last in (("a", 0, 1), ("b", 2, 4), ("c", 5, 5)):
        BD.file_days(spark, users, ips, path, run, day(first), day(last))
    return path, users, ips


@pytest.mark.parametrize("first, last", [(0, 5), (1, 3), (4, 4)])
def test_days_give_the_baseline_of_their_windows(spark, filed, first, last):
    path, users, ips = filed
    want = by_metric(compute_baseline(upto(users, first, last), upto(ips, first, last), CFG))
    assert by_metric(BD.baseline_of_days(spark, path, day(first), day(last), CFG)) == want
    assert want["request_burst"]["sample_count"] > 50


def test_shares_of_excluded_targets_are_taken_out(spark, filed):
    path, users, ips = filed
    hot = spark.createDataFrame([("busy",), ("u3",), ("u3",), ("unknown",), (None,)], "target_id string")
    want = by_metric(compute_baseline(upto(users, 1, 4), upto(ips, 1, 4), CFG, hot))
    assert by_metric(BD.baseline_of_days(spark, path, day(1), day(4), CFG, hot)) == want
    assert want != by_metric(BD.baseline_of_days(spark, path, day(1), day(4), CFG))
    nobody = spark.createDataFrame([], "target_id string")
    assert by_metric(BD.baseline_of_days(spark, path, day(1), day(4), CFG, nobody)) == by_metric(
        BD.baseline_of_days(spark, path, day(1), day(4), CFG))


def test_a_day_filed_again_replaces_itself_only(spark, tmp_path):
    path = str(tmp_path / "store")
    users, ips = windows(spark, range(3))
    BD.file_days(spark, users, ips, path, "first", day(0), day(2))
    again, more = windows(spark, [1], seed=2, scale=3)
    BD.file_days(spark, again, more, path, "day 1 with late logs", day(1), day(1))
    both = [upto(a, 0, 0).unionByName(upto(a, 2, 2)).unionByName(b) for a, b in ((users, again), (ips, more))]
    assert by_metric(BD.baseline_of_days(spark, path, day(0), day(2), CFG)) == by_metric(compute_baseline(*both, CFG))
    # the same again changes nothing; a day without windows loses what it had
    BD.file_days(spark, again, more, path, "day 1 with late logs", day(1), day(1))
    assert by_metric(BD.baseline_of_days(spark, path, day(0), day(2), CFG)) == by_metric(compute_baseline(*both, CFG))
    BD.file_days(spark, again.limit(0), more.limit(0), path, "emptied", day(1), day(1))
    rest = [upto(a, 0, 0).unionByName(upto(a, 2, 2)) for a in (users, ips)]
    assert by_metric(BD.baseline_of_days(spark, path, day(0), day(2), CFG)) == by_metric(compute_baseline(*rest, CFG))
    days = {r["day"]: r["windows"] for r in rows(BD.filed_days(Snapshot(spark, path), day(0), day(2)))}
    assert days[day(1)] == 0 and days[day(0)] == upto(users, 0, 0).count() + upto(ips, 0, 0).count()


def test_a_new_store_is_cold(spark, tmp_path):
    got = by_metric(BD.baseline_of_days(spark, str(tmp_path / "none"), day(0), day(9), CFG))
    assert set(got) == set(BASELINE_METRICS) and all(r["cold_start"] and r["sample_count"] == 0 for r in got.values())


def test_large_equal_values_have_no_deviation(spark, tmp_path):
    path = str(tmp_path / "store")
    users = spark.createDataFrame([("u", EPOCH, "5min", 7, 2**50 + 1, True)] * 5, USERS)
    BD.file_days(spark, users, spark.createDataFrame([], IPS), path, "one", day(0), day(0))
    got = by_metric(BD.baseline_of_days(spark, path, day(0), day(0), CFG))["response_size_burst"]
    assert got["std"] == 0.0 and got["mean"] == float(2**50 + 1) and got["sample_count"] == 5


def test_a_write_from_an_old_version_is_refused(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    users, ips = windows(spark, [0])
    BD.file_days(spark, users, ips, path, "one", day(0), day(0))
    parts = BD.day_parts(users, ips, day(0), day(0))
    with pytest.raises(StoreConflict):
        BD.write_commit(spark, path, parts, "late writer", after=0)


def test_an_exclusion_reads_its_slots_only(spark, filed):
    path = filed[0]
    hot = spark.createDataFrame([("busy",)], "target_id string")
    plan = BD.counts_of_days(Snapshot(spark, path), day(0), day(5), hot)._jdf.queryExecution().executedPlan().toString()
    assert "slot" in plan and "PushedFilters" in plan and any("slot" in line and "PushedFilters" in line for line in plan.split("\n"))
