"""What stores cost as they grow: files, shuffles of whole rows, sorts of whole rows."""

import datetime as dt
import glob

from pyspark.sql import functions as F

from helpers import make_logs
from logwarden.operators import profiles as P
from logwarden.sources.sinks import Snapshot, write_commit
from logwarden.streaming import scored as S

DAY0 = dt.date(2026, 5, 1)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_commit_has_about_a_file_for_each_day(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.range(0, 900, 1, 8).select(F.col("id").cast("string").alias("user_id"), F.date_add(F.lit(DAY0), (F.col("id") % 3).cast("int")).alias("day"))
    write_commit(spark, path, {"t": rows}, "a")
    assert len(glob.glob(f"{path}/t/commit=*/day=*/*.parquet")) == 3
    part = Snapshot(spark, path).part("t", rows.schema)
    assert part.count() == 900 and "SortMergeJoin" not in plan(part) and "BroadcastHashJoin" in plan(part)


def test_newest_risk_sorts_no_rows(spark):
    rows = [("user", "a", "5min", 0, 10, 1), ("user", "a", "5min", 0, 20, 3), ("user", "a", "5min", 0, 15, 2), ("user", "b", "5min", 0, 7, 1), ("ip", "a", "5min", 0, 9, 2)]
    risk = spark.createDataFrame([(*r, "note", DAY0) for r in rows], "target_type string, target_id string, window_size string, win long, total_score int, version long, "
                                 "note string, day date")
    newest = S.newest_risk(risk)
    assert newest.columns == [*S.TARGET, "total_score", "note"] and "SortAggregate" not in plan(newest)
    assert sorted((r.target_type, r.target_id, r.total_score) for r in newest.collect()) == [("ip", "a", 9), ("user", "a", 20), ("user", "b", 7)]


def test_logs_come_once_and_are_not_sorted_for_it(spark):
    single = make_logs(spark, [{"log_id": i, "receive_epoch": 5, "user_id": "u"} for i in range(4)])
    assert "Aggregate" not in plan(P.once_each(single)) and P.once_each(single).count() == 4
    several = single.unionByName(make_logs(spark, [{"log_id": i, "receive_epoch": t, "user_id": "u"} for i, t in ((1, 5), (1, 5), (1, 6), (None, 5), (None, 5), (None, 6))]))
    got = sorted((r.log_id is None, r.log_id or 0, r.receive_epoch) for r in P.once_each(several).collect())
    assert got == [(False, 0, 5), (False, 1, 5), (False, 1, 6), (False, 2, 5), (False, 3, 5), (True, 0, 5), (True, 0, 6)]
