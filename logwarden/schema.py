"""Schemas of the raw document and of the normalised log."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, B = T.StringType(), T.LongType(), T.BooleanType()

JWT = T.StructType([
    T.StructField("alg", S), T.StructField("kid", S), T.StructField("typ", S),
    T.StructField("sub", S), T.StructField("jti", S),
    T.StructField("iat", L), T.StructField("exp", L), T.StructField("auth_time", L), T.StructField("nbf", L),
    T.StructField("iss", S), T.StructField("aud", T.ArrayType(S)), T.StructField("client_id", S),
    T.StructField("scp", T.ArrayType(S)), T.StructField("acr", S), T.StructField("amr", T.ArrayType(S)),
    T.StructField("ext", T.StructType([
        T.StructField("LSID", S), T.StructField("fiat", L), T.StructField("v", T.IntegerType()),
    ])),
])

PROVENANCE = T.StructType([
    T.StructField("source", S), T.StructField("scenario", S), T.StructField("baseline_eligible", B),
])


def raw_schema(provenance: str = "provenance") -> T.StructType:
    """Schema of one raw access-log document; numbers of the request arrive as strings.

    ``provenance`` is the name of the optional struct that says where seeded traffic came from.
    ``log_id`` is the store's own document number: it orders logs of the same second.
    """
    return T.StructType([
        T.StructField("log_id", L),
        T.StructField("@timestamp", S),
        T.StructField("method", S), T.StructField("uri", S), T.StructField("status", S),
        T.StructField("response_time", S), T.StructField("bytes_sent", S), T.StructField("user_agent", S),
        T.StructField("client_ip", S), T.StructField("ip", S),
        T.StructField("ip_class", S), T.StructField("ip_asn", S), T.StructField("ip_org", S),
        T.StructField("ip_country", S), T.StructField("is_nat_whitelisted", B),
        T.StructField("jwt", JWT),
        T.StructField(provenance, PROVENANCE),
    ])
