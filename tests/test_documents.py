import datetime as dt
import json

from helpers import PLAIN, access, rows
from logwarden.operators.normalize import normalize_logs
from logwarden.sources import documents as D

NOW = 1782003600


def lines_of(spark, *lines):
    return spark.createDataFrame([(x,) for x in lines], "value string")


def parsed(spark, *lines):
    order = {x: i for i, x in enumerate(lines)}
    return sorted(rows(D.parse_lines(lines_of(spark, *lines))), key=lambda r: order[r["line"]])


def doc(**fields):
    return json.dumps(access(NOW, "u", "t") | fields)


def python_int(value):
    try:
        return int(value)
    except (TypeError, ValueError):
        return 0


def python_float(value):
    try:
        return float(value)
    except (TypeError, ValueError):
        return 0.0


VALUES = [200, 200.7, -3.9, "200", " 201 ", "200.7", "", None, True, False, 0, 2**62, 1.5e3, "x", "-7"]


def test_numbers_as_a_dynamic_language_reads_them(spark):
    lines = [doc(log_id=i, status=v, bytes_sent=v, response_time=v) for i, v in enumerate(VALUES)]
    raw = D.parse_lines(lines_of(spark, *lines))
    assert raw.filter("reason IS NOT NULL").count() == 0
    got = {r["log_id"]: r for r in rows(normalize_logs(raw.drop("line", "reason")))}
    for i, v in enumerate(VALUES):
        assert got[i]["status"] == got[i]["bytes_sent"] == python_int(v), v
        assert got[i]["response_time"] == python_float(v), v


def test_every_line_is_a_document_or_a_reject(spark):
    lines = [doc(), "", "  ", "{", "[1]", "7", "null", '"text"', doc()[:-1], doc(uri={"a": 1}), doc(jwt={"iat": "soon", "exp": [1]}),
             doc(jwt="token"), doc(jwt=""), doc(jwt=[]), doc(jwt=None), doc(uri=[1], provenance=3), doc(extra={"any": 1}), "{}"]
    want = [None, "empty", "empty", "not json", "not an object", "not an object", "not an object", "not an object", "not json",
            "unreadable: uri", "unreadable: jwt.iat, jwt.exp", "unreadable: jwt", None, None, None, "unreadable: uri, provenance", None, None]
    got = parsed(spark, *lines)
    assert [r["reason"] for r in got] == want
    assert rows(D.parse_lines(lines_of(spark, None)))[0]["reason"] == "empty"
    assert got[12]["jwt"] is None and got[0]["jwt"]["sub"] == "u" and got[0]["client_ip"] == PLAIN["client_ip"]


def test_claims(spark):
    (r,) = parsed(spark, doc(jwt={"aud": "https://one.example", "amr": ["a", "b"], "iat": 12.9, "exp": "34", "ext": {"LSID": 5, "v": 1}}))
    assert r["reason"] is None
    assert (r["jwt"]["aud"], r["jwt"]["amr"], r["jwt"]["scp"]) == (["https://one.example"], ["a", "b"], None)
    assert (r["jwt"]["iat"], r["jwt"]["exp"], r["jwt"]["ext"]["LSID"], r["jwt"]["ext"]["v"]) == (12, 34, "5", 1)


def test_same_documents_as_the_fixed_schema_gives(spark, tmp_path):
    docs = [access(NOW + i, f"u{i % 3}" if i % 4 else None, "t", status=200 + i, uri=f"/orders/{i}") for i in range(30)]
    (tmp_path / "logs.json").write_text("\n".join(json.dumps(d) for d in docs))
    from logwarden.sources.logs import read_raw
    fixed = normalize_logs(read_raw(spark, str(tmp_path), "json")).drop("log_id")
    lenient = normalize_logs(D.parse_lines(spark.read.text(str(tmp_path))).drop("line", "reason")).drop("log_id")
    assert sorted(map(str, rows(fixed))) == sorted(map(str, rows(lenient)))


def test_ingest_adds_up_and_repeats(spark, tmp_path):
    lines = lines_of(spark, *[doc(log_id=i) for i in range(20)], "{", "", None, doc(uri=[]))
    for day in (1, 2):
        out = D.ingest_lines(lines, str(tmp_path / "root"), "one", str(tmp_path / "work"), dt.date(2026, 5, day))
        assert (out["raw"]["saved"], out["rejected"]["saved"]) == (20, 4)
    raw, rejected = D.ingested(spark, str(tmp_path / "root"), "one")
    assert normalize_logs(raw).count() == 20 and sorted(r["reason"] for r in rows(rejected)) == ["empty", "empty", "not json", "unreadable: uri"]
    none = D.ingest_lines(lines.limit(0), str(tmp_path / "root"), "none", str(tmp_path / "work"))
    assert none["raw"]["saved"] == none["rejected"]["saved"] == 0
