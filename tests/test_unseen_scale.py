"""What telling new logs from known ones costs in memory of a task."""

from helpers import make_logs
from logwarden.operators import profiles as P
from logwarden.plans import queries

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_known_ids_are_dealt_out_and_logs_not_sorted(spark):
    logs = make_logs(spark, [{"log_id": i, "receive_epoch": 5 + i // 4, "user_id": "u"} for i in range(8)] + [{"log_id": 99, "receive_epoch": 5, "user_id": ""}])
    known = make_logs(spark, [{"log_id": i, "receive_epoch": t, "user_id": "u"} for i, t in ((1, 5), (1, 5), (2, 6), (7, 6))]).select(*P.IDENTITY)
    new = P.unseen(logs, known)
    assert "ShuffledHashJoin" in plan(new) and "Broadcast" not in plan(new) and "Sort " not in plan(new)
    assert sorted((r.log_id, r.receive_epoch) for r in new.collect()) == [(0, 5), (2, 5), (3, 5), (4, 6), (5, 6), (6, 6)]  # id 2 of another second is another log
    assert P.unseen(logs, None).count() == P.unseen(logs, known.limit(0)).count() == 8
    earlier = P.unseen(logs, known.filter("receive_epoch < 6"))  # logs of second 6 pass without being looked up
    assert sorted(r.log_id for r in earlier.collect()) == [0, 2, 3, 4, 5, 6, 7]


def test_upsert_counts_write_the_columns_they_count(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "work_of", lambda _: str(tmp_path))
    assert queries.profile_upsert_counts(spark, SF).count() == 1
    staged = [p for p in tmp_path.iterdir() if p.name.startswith("profile-")]
    assert len(staged) == 3 and all(set(spark.read.parquet(str(p)).columns) == {*P.IDENTITY, "user_id"} for p in staged)
