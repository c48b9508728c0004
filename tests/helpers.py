"""Small fixtures."""

import datetime as dt
import json

from pyspark.sql import types as T

from logwarden.operators.normalize import normalize_logs
from logwarden.schema import raw_schema

LOG = T.StructType([T.StructField(n, t) for n, t in [
    ("log_id", T.LongType()), ("timestamp", T.StringType()), ("receive_epoch", T.LongType()),
    ("method", T.StringType()), ("uri", T.StringType()), ("status", T.LongType()), ("bytes_sent", T.LongType()),
    ("user_agent", T.StringType()), ("client_ip", T.StringType()), ("ip_class", T.StringType()),
    ("ip_asn", T.StringType()), ("ip_org", T.StringType()), ("ip_country", T.StringType()),
    ("is_nat_whitelisted", T.BooleanType()), ("baseline_eligible", T.BooleanType()), ("user_id", T.StringType()),
    ("jwt_id", T.StringType()), ("session_id", T.StringType()), ("client_id", T.StringType()),
    ("alg", T.StringType()), ("kid", T.StringType()), ("jwt_issued_at", T.LongType()),
    ("jwt_expires_at", T.LongType()), ("auth_time", T.LongType()), ("acr", T.StringType()),
    ("amr", T.ArrayType(T.StringType())), ("scopes", T.ArrayType(T.StringType())),
    ("audiences", T.ArrayType(T.StringType())), ("issuer", T.StringType())]])

DEFAULTS = {"timestamp": "2026-05-13T09:13:13Z", "method": "GET", "uri": "/api/products", "status": 200,
            "bytes_sent": 2000, "baseline_eligible": True, "audiences": [], "amr": [], "scopes": []}


def make_logs(spark, rows):
    names = LOG.fieldNames()
    filled = []
    for i, row in enumerate(rows):
        full = {"log_id": i, **DEFAULTS, **row}
        assert set(full) <= set(names), set(full) - set(names)
        filled.append(tuple(full.get(n) for n in names))
    return spark.createDataFrame(filled, LOG)


#: What a raw document holds unless a test says otherwise; numbers of the request are strings.
PLAIN = {"method": "GET", "uri": "/catalogue", "status": "200", "bytes_sent": "512", "response_time": "0.2", "user_agent": "test client",
         "client_ip": "192.0.2.10", "ip": "172.16.4.4", "ip_class": "cloud", "ip_country": "US", "ip_asn": "AS64510", "ip_org": "test net",
         "is_nat_whitelisted": False}


def access(at, user=None, token=None, issued=None, eligible=True, **fields):
    """A raw document of an instant: PLAIN with ``fields``, and the claims of a ten-minute token of ``user``."""
    doc = {**PLAIN, "@timestamp": dt.datetime.fromtimestamp(at, dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"),
           **{k: str(v) if k in ("status", "bytes_sent") else v for k, v in fields.items()}}
    if user is not None:
        start = at if issued is None else issued
        doc["jwt"] = dict(sub=user, jti=token, iat=start, nbf=start, exp=start + 600, auth_time=start, iss="https://issuer.test/",
                          aud=["https://api.example"], client_id="tests", alg="RS256", kid="one", typ="JWT", acr="aal2", amr=["otp"],
                          scp=["read"], ext={"LSID": f"session of {user}", "fiat": start, "v": 1})
    doc["provenance"] = {"source": "tests", "baseline_eligible": eligible}
    return doc


def raw_frame(spark, docs):
    lines = spark.createDataFrame([(json.dumps(d),) for d in docs], "line string")
    from pyspark.sql import functions as F
    return lines.select(F.from_json("line", raw_schema()).alias("d")).select("d.*")


def logs_of_docs(spark, docs):
    return normalize_logs(raw_frame(spark, docs))


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]
