"""Logs stored by user: the same rows as a scan, and how few rows of the files are read for them."""

from pyspark.sql import functions as F

from helpers import make_logs, rows
from logwarden.plans import scoring as SC
from logwarden.sources import events as E
from logwarden.sources.user_layout import store_by_user, stored_logs_of

DAY0 = 1778630400  # midnight UTC
DAY = 86400


def leaves(plan):
    """The scans of an executed plan, inside finished adaptive stages too."""
    found, todo = [], [plan]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(p.plan())
        elif name == "FileSourceScanExec":
            found.append(p)
        else:
            children = p.children()
            todo += [children.apply(i) for i in range(children.size())]
    return found


def rows_read(df):
    """Runs a query; gives its rows and how many its scans have read from files."""
    got = rows(df)
    return got, sum(s.metrics().apply("numOutputRows").value() for s in leaves(df._jdf.queryExecution().executedPlan()))


def test_a_user_is_read_without_the_rest(spark, tmp_path):
    logs, path = E.event_logs(spark, "/root/testdata/sf0.01"), str(tmp_path / "store")
    start, end = 1704844800, 1705103999
    store_by_user(logs, path, "all", rows_per_file=20)
    whole = logs.filter(F.col("receive_epoch").between(start, end))
    got, read = rows_read(stored_logs_of(spark, path, "8", start, end))
    want = rows(whole.filter("user_id = '8'").select(*(got[0] if got else [])))
    assert got and sorted(got, key=lambda r: r["log_id"]) == sorted(want, key=lambda r: r["log_id"])
    assert read <= whole.count() / 8, read
    none, read = rows_read(stored_logs_of(spark, path, "80000", start, end))
    assert none == [] and read <= whole.count() / 50, read


def test_absent_users_are_told_by_bloom_filters(spark, tmp_path):
    """Every file spans the whole range of users, so only the filters can tell."""
    path = str(tmp_path / "store")
    users = spark.range(0, 200_000).select(F.concat(F.lit("u"), F.lpad((F.col("id") * 2).cast("string"), 8, "0")).alias("user_id"))
    logs = users.select("user_id", F.lit(DAY0).cast("bigint").alias("receive_epoch"), F.xxhash64("user_id").alias("log_id"))
    store_by_user(logs.repartition(1), path, "one", rows_per_file=1_000_000)
    total = skipped = 0
    for n in range(1, 100_001, 20_000):
        got, read = rows_read(stored_logs_of(spark, path, f"u{n:08d}", DAY0, DAY0))
        assert got == []
        total, skipped = total + 1, skipped + (read == 0)
    assert total == 5 and skipped >= 4
    assert len(rows(stored_logs_of(spark, path, "u00000040", DAY0, DAY0))) == 1


def test_edges_of_a_store_by_user(spark, tmp_path):
    """Users and times without a value, a hot user, a run written again, days and second bounds, other session zones."""
    path = str(tmp_path / "store")
    some = [{"user_id": u, "receive_epoch": t} for u, t in [
        ("a", DAY0), ("a", DAY0 + DAY - 1), ("a", DAY0 + DAY), (None, DAY0), ("b", None), ("b", DAY0 + 5), ("", DAY0 + 6)]]
    hot = [{"user_id": "hot", "receive_epoch": DAY0 + i} for i in range(300)]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Pacific/Auckland")
        store_by_user(make_logs(spark, some), path, "2026-05-13")
        store_by_user(make_logs(spark, some + hot), path, "2026-05-13", rows_per_file=50)
        store_by_user(make_logs(spark, [{"log_id": 900, "user_id": "a", "receive_epoch": DAY0 + 1}]), path, "second")
        of = lambda user, start, end: sorted(r.receive_epoch - DAY0 for r in stored_logs_of(spark, path, user, start, end).collect())
        assert of("a", DAY0, DAY0 + DAY - 1) == [0, 1, DAY - 1] and of("a", DAY0 + DAY, DAY0 + 2 * DAY) == [DAY]
        assert of("b", 0, DAY0 + DAY) == [5] and of("", DAY0, DAY0 + DAY) == [6] and of("nobody", DAY0, DAY0 + DAY) == []
        assert of("hot", DAY0 + 10, DAY0 + 12) == [10, 11, 12] and len(of("hot", DAY0, DAY0 + DAY)) == 300
        assert set(stored_logs_of(spark, path, "a", DAY0, DAY0).columns) == set(make_logs(spark, some).columns)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_an_empty_batch_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    store_by_user(make_logs(spark, [{"user_id": "a", "receive_epoch": DAY0}]), path, "first")
    store_by_user(make_logs(spark, []), path, "empty")
    assert stored_logs_of(spark, path, "a", DAY0, DAY0).count() == 1


def test_a_profile_reads_little_of_its_store(spark, tmp_path):
    path, work = str(tmp_path / "profiles"), str(tmp_path / "work")
    logs = E.event_logs(spark, "/root/testdata/sf0.01").filter(F.col("receive_epoch") < 1704240000)
    SC.update_profiles(spark, logs, path, "first", work)
    stored = SC.read_parts(spark, path)["windows"]
    got, read = rows_read(stored.filter(F.col("user_id") == "no such user"))
    assert got == [] and read <= stored.count() / 20 + 1, read  # and the commit's own row
