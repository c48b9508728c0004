import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import access, raw_frame, rows
from logwarden.functions import scalar as X
from logwarden.functions.labels import factor_label
from logwarden.operators.normalize import normalize_logs, token_fields


def evaluate(spark, values, kind, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in df.select("i", fn(F.col("v")).alias("out")).orderBy("i").collect()]


def test_casts(spark):
    texts = ["200", " 200 ", "+5", "-7", "", "abc", "200.0", None, "99999999999999999999"]
    assert evaluate(spark, texts, "string", X.safe_int) == [200, 200, 5, -7, 0, 0, 0, 0, 0]
    texts = ["0.05", "1e3", ".5", "12d", "0x1p3", "n/a", "", None, "inf", "-2."]
    assert evaluate(spark, texts, "string", X.safe_float) == [
        0.05, 1000.0, 0.5, 0.0, 0.0, 0.0, 0.0, 0.0, float("inf"), -2.0]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Seoul"])
def test_time_is_independent_of_the_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        texts = ["2026-05-13T09:13:13Z", "2026-05-13T18:13:13.9+09:00", "2026-05-13T09:13:13", "2026-05-13",
                 "2024-03-10T02:30:00", "T09:13:13", "2026-05", "bad", "", None]
        assert evaluate(spark, texts, "string", X.iso_to_epoch) == [
            1778663593, 1778663593, 1778663593, 1778630400, 1710037800, None, None, None, None, None]
        assert evaluate(spark, [1778663593, 1710037800], "bigint", X.epoch_to_iso) == [
            "2026-05-13T09:13:13Z", "2024-03-10T02:30:00Z"]
        assert evaluate(spark, ["2024-03-10 02:30:00.7"], "string",
                        lambda c: X.epoch_of_ntz(c.cast("timestamp_ntz"))) == [1710037800]
        assert evaluate(spark, [1778663593], "bigint", X.hour_of_day) == [9]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("digits", [0, 1, 3, 4])
def test_rounding_equals_the_binary_definition(spark, digits):
    rng = random.Random(digits)
    values = [0.00625, 2.675, 0.125, 2.5, -0.00625, -2.5, 1 / 3, 0.0, 12345678.12345]
    values += [a / b for a, b in ((rng.randint(0, 5000), rng.randint(1, 3200)) for _ in range(3000))]
    values += [rng.randint(-10**6, 10**6) / 2**rng.randint(0, 8) for _ in range(1000)]
    got = evaluate(spark, values, "double", lambda c: X.round_half_even(c, digits))
    assert got == [float(round(v, digits)) for v in values]


def test_difference_saturates(spark):
    df = spark.createDataFrame([(2**62, -(2**62) - 5), (-(2**63), 9), (5, 3), (None, 1)], "a bigint, b bigint")
    got = [r.d for r in df.select(X.difference(F.col("a"), F.col("b")).alias("d")).collect()]
    assert got == [2**63 - 1, -(2**63), 2, None]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 3)] * 5), min_size=1, max_size=20))
def test_argmax_prefers_the_first(spark, tuples):
    names = ["a", "b", "c", "d", "e"]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(tuples)], "i int, a int, b int, c int, d int, e int")
    got = df.select("i", X.argmax_name([(n, F.col(n)) for n in names]).alias("m")).orderBy("i").collect()
    assert [r.m for r in got] == [names[max(range(5), key=lambda k: (t[k], -k))] for t in tuples]


def test_uri_helpers(spark):
    uris = ["/api/orders/14", "/api/orders/x", "/admin/x", "/api/users/12?x=1", "/a?b?c", ""]
    assert evaluate(spark, uris, "string", X.is_sensitive) == [True, False, False, False, False, False]
    assert evaluate(spark, uris, "string", X.is_suspicious) == [False, False, True, False, False, False]
    assert evaluate(spark, uris, "string", X.accessed_user)[3] == "12"
    assert evaluate(spark, uris, "string", X.path_of)[3:] == ["/api/users/12", "/a", ""]
    assert evaluate(spark, ["10.0.1.7", "::1"], "string", X.subnet_of) == ["10.0.1.0/24", None]
    assert evaluate(spark, [200, 302, 404, 503, 0, 700], "int", X.status_class) == [
        "s2xx", "s3xx", "s4xx", "s5xx", None, None]
    assert evaluate(spark, [29, 30, 50, 80], "int", X.severity_band) == ["low", "medium", "high", "critical"]
    assert evaluate(spark, ["token_replay", "none"], "string", factor_label) == ["토큰재현(Replay)", None]


def test_token_derivation(spark):
    now = 1778056393
    df = spark.createDataFrame([(now - 30, now + 14370), (now - 20000, now - 5600), (None, None),
                                (now - 59, now + 59), (now - 90000, now + 60)], "iat bigint, exp bigint")
    got = [(r.token_lifecycle, r.token_status) for r in df.select(
        *[c.alias(n) for n, c in token_fields(F.col("iat"), F.col("exp"), F.lit(now)).items()]).collect()]
    assert got == [("fresh", "valid"), ("aging", "expired"), (None, None), ("fresh", "expiring_soon"),
                   ("stale", "valid")]


def test_normalize_defaults(spark):
    doc = {"log_id": 1, **access(1778663593, "u", "j")}
    bare = {"log_id": 2, "@timestamp": "broken", "status": "-", "bytes_sent": "", "jwt": {"exp": 100}}
    full, empty = rows(normalize_logs(raw_frame(spark, [doc, bare])).orderBy("log_id"))
    assert (full["status"], full["bytes_sent"], full["response_time"], full["receive_epoch"]) == (
        200, 512, 0.2, 1778663593)
    assert full["session_id"] == "session of u" and full["audiences"] == ["https://api.example"]
    assert (empty["receive_epoch"], empty["method"], empty["uri"], empty["status"]) == (None, "", "", 0)
    assert empty["baseline_eligible"] is True and empty["audiences"] == [] and empty["user_id"] is None
    assert empty["token_ttl_seconds"] == 100 and empty["token_status"] == "valid"  # no arrival time counts as 0
    assert empty["token_lifecycle"] is None
