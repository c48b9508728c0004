"""The stream that files closed windows of all lengths, against the batch."""

import glob
import random

from helpers import logs_of_docs
from logwarden.operators.ip_windows import ip_windows
from logwarden.operators.user_windows import user_windows
from logwarden.plans import queries
from logwarden.streaming import closed as C
from logwarden.streaming import windows as ST
from test_jobs import T0, clock, documents, feed, table

SF = "/root/testdata/sf0.001"


def both(pair):
    return [table(df) for df in pair]


def batch_of(spark, docs):
    logs = logs_of_docs(spark, docs)
    return user_windows(logs), ip_windows(logs)


def stream(spark, tmp_path, folder, path="closed", checkpoint="checkpoint"):
    logs = ST.stream_logs(spark, folder, files_per_trigger=1)
    C.closing_stream(logs, str(tmp_path / path), str(tmp_path / checkpoint), str(tmp_path / "work")).awaitTermination()
    return str(tmp_path / path)


def test_deliveries_that_overlap_equal_batch(spark, tmp_path):
    docs = sorted(documents(n=160, span=100_000), key=lambda d: d["@timestamp"])
    rnd = random.Random(4)
    parts = [docs[:60], docs[59:120] + docs[80:90], docs[119:]]  # each repeats the newest log before, the second some of its own
    for p in parts:
        rnd.shuffle(p)
    path = stream(spark, tmp_path, feed(tmp_path, *parts))
    closed, left, want = C.closed_windows(spark, path), C.open_windows(spark, path), batch_of(spark, docs)
    assert all(df.count() for df in (*closed, *left))
    assert both(a.unionByName(b) for a, b in zip(closed, left)) == both(want)
    # what is closed is what the stream of one length closes
    alone = [ST.stream_user_windows(ST.stream_logs(spark, str(tmp_path / "in"), files_per_trigger=1)), *(
        ST.stream_ip_windows(ST.stream_logs(spark, str(tmp_path / "in"), files_per_trigger=1), size) for size in ("5min", "1h", "24h"))]
    got = []
    for i, df in enumerate(alone):
        ST.write_stream(df, str(tmp_path / f"alone-{i}"), str(tmp_path / f"state-{i}")).awaitTermination()
        got.append(table(spark.read.schema(df.schema).parquet(str(tmp_path / f"alone-{i}"))))
    assert [table(closed[0].select(*alone[0].columns)), table(closed[1].select(*alone[1].columns))] == [got[0], sorted(got[1] + got[2] + got[3])]


def test_late_logs_are_left_out_and_closed_windows_stay(spark, tmp_path):
    docs = [d | {"log_id": i} for i, d in enumerate(documents(n=40, span=3000))]
    late = [d | {"log_id": 500 + i} for i, d in enumerate(documents(seed=5, n=10, span=3000))]
    path = stream(spark, tmp_path, feed(tmp_path, docs + [clock()], late, docs[:5]))
    assert both(C.closed_windows(spark, path)) == both(df.filter(df.win < T0 + 9 * 86400) for df in batch_of(spark, docs))
    assert [df.count() for df in C.open_windows(spark, path)] == [1, 3]  # those of the log that moved the clock


def test_a_batch_again_replaces_itself(spark, tmp_path):
    docs = sorted(documents(n=90, span=90_000), key=lambda d: d["@timestamp"])
    path, work, halves = str(tmp_path / "closed"), str(tmp_path / "work"), (docs[:50], docs[49:])
    for number, half in ((0, halves[0]), (0, halves[0]), (1, halves[1]), (1, halves[1])):
        C.close_batch(spark, logs_of_docs(spark, half), number, path, work)
    C.close_batch(spark, logs_of_docs(spark, []), 2, path, work)
    assert both(a.unionByName(b) for a, b in zip(C.closed_windows(spark, path), C.open_windows(spark, path))) == both(batch_of(spark, docs))


def test_nothing_comes(spark, tmp_path):
    path = str(tmp_path / "closed")
    C.close_batch(spark, logs_of_docs(spark, []), 0, path, str(tmp_path / "work"))
    assert [df.count() for df in (*C.closed_windows(spark, path), *C.open_windows(spark, path))] == [0, 0, 0, 0]


def test_risk_of_streams_reads_its_events_once_and_keeps_no_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "work_of", lambda _: str(tmp_path))
    assert queries.REGISTRY["streaming_risk_scores"](spark, SF).count() > 1000
    assert len(glob.glob(f"{tmp_path}/**/sources/0/0", recursive=True)) == 1
    assert not glob.glob(f"{tmp_path}/**/state/*", recursive=True)


def test_events_in_a_folder_of_files_are_streamed(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "sf" / "events.parquet"))
    events.limit(7).write.parquet(str(tmp_path / "sf" / "others.parquet"))
    df = ST.dedup(queries._event_stream(spark, str(tmp_path / "sf"))).select("log_id")
    ST.write_stream(df, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.schema(df.schema).parquet(str(tmp_path / "out")).count() == events.count() > 0
