"""Access-log documents derived from the ``events`` test table.

The test tables hold no access log. Each event becomes one raw document, deterministically; some break each
rule on purpose. FIXTURES.md section 5 states the same derivation as SQL over the normalised columns.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.functions.scalar import epoch_of_ntz, epoch_to_iso
from logwarden.operators.normalize import normalize_logs

EXPECTED_AUDIENCE = "https://api.example"


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def raw_documents(events: DataFrame) -> DataFrame:
    k, uid, ep, kind, eid, issued = (F.col(c) for c in ("k", "uid", "ep", "event_type", "event_id", "issued"))
    parsed = F.struct(F.get_json_object("props", "$.k").cast("int").alias("k"), epoch_of_ntz(F.col("ts")).alias("ep"))
    base = (events.select("event_id", F.col("user_id").alias("uid"), "event_type", "value",
                          F.inline(F.array(parsed)))  # parsed once, see normalize_logs
            .withColumn("issued", ep - (k % 9) * 60))
    uri = (F.when(kind == "click", _text("/api/products?p=", k % 20))
           .when(kind == "view", _text("/api/users/", F.when(k < 25, uid).otherwise((uid + k) % 150)))
           .when(kind == "purchase", _text("/api/orders/", k + 140000000))
           .when(kind == "signup", _text("/api/addresses/", k))
           .when(k < 2, _text("/admin/", k)).otherwise(_text("/api/x/", k % 7)))
    status = (F.when(kind == "error", F.when(k < 50, "500").otherwise("404"))
              .when((kind == "signup") & (k < 10), "302").otherwise("200"))
    ip = (F.when(k < 10, F.lit("203.0.113.50")).when(k < 70, _text("118.235.82.", k % 6))
          .otherwise(_text("13.124.0.", k % 10)))
    iat = F.when(eid % 211 == 0, ep + 4000).otherwise(issued)
    exp = (F.when(eid % 211 == 0, ep + 4600).when(eid % 107 == 0, ep - 1).when(eid % 103 == 0, ep + 7200)
           .when(eid % 101 == 0, issued + 2400).otherwise(issued + 600))
    auth = F.when(eid % 109 == 0, ep - 90000).when(eid % 113 == 0, ep - 2700000).otherwise(issued)
    audience = F.when(eid % 127 == 0, F.lit("https://other.example")).otherwise(EXPECTED_AUDIENCE)

    def claims(**fields: Column) -> Column:
        """A struct whose fields are null on unsigned requests. Spark drops the fields a query does not read."""
        return F.struct(*[F.when(eid % 97 != 0, c).alias(n) for n, c in fields.items()])

    jwt = claims(
        alg=F.lit("ES256"), kid=F.when(k < 95, "key-1").otherwise("key-2"), typ=F.lit("JWT"),
        sub=uid.cast("string"), jti=F.when(eid % 53 != 0, _text("jti-", uid, "-", F.floor(ep / 86400))),
        iat=iat, exp=exp, auth_time=auth, nbf=iat, iss=F.lit("https://auth.example/"), aud=F.array(audience),
        client_id=F.when(kind == "click", "web").otherwise("app"), scp=F.array(F.lit("openid"), F.lit("core")),
        acr=F.lit("aal1"), amr=F.array(F.lit("pwd")),
        ext=F.struct(_text("lsid-", uid).alias("LSID"), iat.alias("fiat"), F.lit(2).alias("v")))
    return base.select(
        eid.alias("log_id"), epoch_to_iso(ep).alias("@timestamp"),
        F.when(kind == "purchase", "POST").when(kind == "signup", "PUT").otherwise("GET").alias("method"),
        uri.alias("uri"), status.alias("status"),
        F.when(eid % 131 == 0, "n/a").otherwise((F.col("value") / 100).cast("string")).alias("response_time"),
        F.floor(F.col("value") * 100).cast("string").alias("bytes_sent"),
        _text("ua-", k % 4).alias("user_agent"), ip.alias("client_ip"), _text("10.0.1.", k % 3).alias("ip"),
        F.when(k < 10, "unknown").when(k < 70, "cgnat_kr").otherwise("cloud").alias("ip_class"),
        F.when(k < 10, "AS64500").when(k < 70, "AS4766").otherwise("AS16509").alias("ip_asn"),
        F.when(k >= 70, "cloud host").when(k >= 10, "carrier").alias("ip_org"),
        F.when((k >= 10) & (k < 70), "KR").otherwise("US").alias("ip_country"),
        ((k >= 10) & (k < 70)).alias("is_nat_whitelisted"), jwt.alias("jwt"),
        F.struct(F.lit("events").alias("source"), F.when(eid % 89 == 0, "replayed").alias("scenario"),
                 F.when(eid % 89 == 0, F.lit(False)).alias("baseline_eligible")).alias("provenance"))


def event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised logs of the test table."""
    return normalize_logs(raw_documents(read_events(spark, sf_dir)), numbered=True)


def events_between(events: DataFrame, start: int, end: int) -> DataFrame:
    """Events of the closed range in whole seconds; the comparison on ``ts`` reaches the parquet scan."""
    def instant(epoch: int) -> Column:
        return F.lit(dt.datetime.fromtimestamp(epoch, dt.timezone.utc).replace(tzinfo=None)).cast("timestamp_ntz")

    return events.filter((F.col("ts") >= instant(start)) & (F.col("ts") < instant(end + 1)))


def before(epoch: int) -> Column:
    """Events before an instant."""
    return F.col("ts") < F.lit(dt.datetime.fromtimestamp(epoch, dt.timezone.utc).replace(tzinfo=None)).cast("timestamp_ntz")


def pii_signals(events: DataFrame) -> DataFrame:
    """Per-user counts of personal data in responses, derived from the events."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    return events.groupBy(F.col("user_id").cast("string").alias("user_id")).agg(
        F.count_if((kind == "purchase") & (k < 50)).alias("email"),
        F.count_if((kind == "signup") & (k < 30)).alias("phone"),
        F.bool_or((kind == "error") & (k == 0)).alias("doorlock_with_address"))
