"""Raw nested documents to flat logs: one projection, no Python per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.functions import scalar as X


def token_fields(iat: Column, exp: Column, now: Column) -> dict[str, Column]:
    age, ttl = X.difference(now, iat), X.difference(exp, now)
    return {
        "token_lifecycle": X.token_lifecycle(age),
        "token_status": X.token_status(ttl),
        "token_age_seconds": age,
        "token_ttl_seconds": ttl,
    }


def identity(raw: DataFrame, numbered: bool = False) -> Column:
    """The store's document number; where there is none, a number derived from the whole document.

    The derived one is the same wherever and whenever the document is read, so equal documents count as one delivery. It has
    63 bits, so logs are told apart by it and ``receive_epoch`` together (IDENTITY): only logs of one second can collide.
    """
    if numbered:
        return F.col("log_id")
    derived = F.xxhash64(*(f"`{c}`" for c in raw.columns if c != "log_id")).bitwiseAND(F.lit(2**63 - 1))
    return F.coalesce("log_id", derived) if "log_id" in raw.columns else derived


#: What two deliveries of one log share and no other log has.
IDENTITY = ["log_id", "receive_epoch"]


def normalize_logs(raw: DataFrame, provenance: str = "provenance", numbered: bool = False) -> DataFrame:
    """``numbered`` says that every document has its ``log_id``. Otherwise whole documents are read, to derive ids that are
    missing; ingest jobs do that once and store the result."""
    text, jwt = F.col, lambda name: F.col(f"jwt.{name}")
    empty = F.array().cast("array<string>")
    # A one-element inline: Spark copies a projected expression into every filter and constraint pushed below it, and
    # would parse the timestamp and hash the document many times per row. It never copies through a generator, whose
    # columns are computed for every query; so an id that is there stays outside.
    once = F.struct(*([] if numbered else [identity(raw).alias("log_id")]), X.iso_to_epoch(text("@timestamp")).alias("receive_epoch"))
    stamped = raw.select(*(f"`{c}`" for c in raw.columns if numbered or c != "log_id"), F.inline(F.array(once)))
    now = F.coalesce("receive_epoch", F.lit(0).cast("bigint"))
    derived = token_fields(jwt("iat"), jwt("exp"), now)
    return stamped.select(
        "log_id",
        text("@timestamp").alias("timestamp"),
        "receive_epoch",
        F.timestamp_seconds("receive_epoch").alias("receive_ts"),
        F.coalesce("method", F.lit("")).alias("method"),
        F.coalesce("uri", F.lit("")).alias("uri"),
        X.safe_int(text("status")).alias("status"),
        X.safe_float(text("response_time")).alias("response_time"),
        X.safe_int(text("bytes_sent")).alias("bytes_sent"),
        "user_agent",
        "client_ip",
        text("ip").alias("alb_ip"),
        "ip_class", "ip_asn", "ip_org", "ip_country", "is_nat_whitelisted",
        text(f"{provenance}.scenario").alias("seed_scenario"),
        F.coalesce(text(f"{provenance}.baseline_eligible"), F.lit(True)).alias("baseline_eligible"),
        jwt("sub").alias("user_id"),
        jwt("jti").alias("jwt_id"),
        jwt("ext.LSID").alias("session_id"),
        jwt("client_id").alias("client_id"),
        jwt("alg").alias("alg"),
        jwt("kid").alias("kid"),
        jwt("iat").alias("jwt_issued_at"),
        jwt("exp").alias("jwt_expires_at"),
        jwt("auth_time").alias("auth_time"),
        jwt("acr").alias("acr"),
        F.coalesce(jwt("amr"), empty).alias("amr"),
        F.coalesce(jwt("scp"), empty).alias("scopes"),
        F.coalesce(jwt("aud"), empty).alias("audiences"),
        jwt("iss").alias("issuer"),
        *[c.alias(name) for name, c in derived.items()],
    )
