"""Column expressions shared by the operators. None depends on the session time zone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from logwarden.config import SUSPICIOUS_MARKERS

# Patterns of the URI predicates.
SENSITIVE_URI = r"/(addresses|orders)/\d+"
USER_URI = r"/api/users/(\d+)"

_FLOAT_TEXT = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)\s*$"
_ZONE = r"(?i)\d(z|[+-]\d{2}(:?\d{2})?)$"
_MAX, _MIN = 2**63 - 1, -(2**63)


def safe_int(c: Column) -> Column:
    """Integer text to bigint; anything else is 0."""
    return F.coalesce(c.try_cast("bigint"), F.lit(0).cast("bigint"))


def safe_float(c: Column) -> Column:
    """Decimal text to double; anything else (also Java's '12d') is 0.0."""
    return F.coalesce(F.when(c.rlike(_FLOAT_TEXT), c.try_cast("double")), F.lit(0.0))


def iso_to_epoch(c: Column) -> Column:
    """ISO text to epoch seconds; without a zone it is UTC; null when it is not a full date."""
    clock = (F.when(F.endswith(c, F.lit("Z")), c).when(F.length(c) == 10, F.concat(c, F.lit("T00:00:00Z")))
             .when(c.rlike(_ZONE), c).otherwise(F.concat(c, F.lit("Z"))))
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), F.unix_seconds(clock.try_cast("timestamp")))


def epoch_to_iso(c: Column) -> Column:
    wall = F.timestamp_add("SECOND", c, F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))
    return F.concat(F.replace(wall.cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))


def epoch_of_ntz(c: Column) -> Column:
    """Zone-less timestamp, read as UTC, to epoch seconds (fraction dropped)."""
    since = c - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    return F.floor(since.cast("interval second").cast("decimal(20,6)")).cast("bigint")


def day_of(epoch: Column) -> Column:
    """The UTC date of an instant."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(epoch / 86400).cast("int"))


def log_position() -> Column:
    """Order of logs by time, then by id, as one number."""
    return F.expr("CAST(CAST(receive_epoch AS DECIMAL(13,0)) * CAST('10000000000000000000' AS DECIMAL(20,0)) "
                  "+ log_id AS DECIMAL(38,0))")


def window_start(epoch: Column, seconds: int) -> Column:
    return epoch - F.pmod(epoch, F.lit(seconds))


def hour_of_day(epoch: Column) -> Column:
    return F.floor(F.pmod(epoch, F.lit(86400)) / 3600).cast("int")


def difference(a: Column, b: Column) -> Column:
    """a - b on bigint claims that anyone may forge: saturates instead of failing the job."""
    bound = F.when(a > 0, F.lit(_MAX)).otherwise(F.lit(_MIN))
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(F.try_subtract(a, b), bound))


def filled(c: Column) -> Column:
    """The string when it is neither null nor empty, else null."""
    return F.when(c != "", c)


def is_sensitive(uri: Column) -> Column:
    return F.coalesce(uri.rlike(SENSITIVE_URI), F.lit(False))


def is_suspicious(uri: Column) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(uri, F.lit(m)) for m in SUSPICIOUS_MARKERS]),
                      F.lit(False))


def path_of(uri: Column) -> Column:
    return F.substring_index(uri, "?", 1)


def accessed_user(uri: Column) -> Column:
    return filled(F.regexp_extract(uri, USER_URI, 1))


def subnet_of(ip: Column) -> Column:
    return F.when(F.contains(ip, F.lit(".")), F.regexp_replace(ip, r"\.[^.]*$", ".0/24"))


def status_class(status: Column) -> Column:
    """s2xx to s5xx; null for every other status."""
    k = F.floor(status / 100)
    return F.when(k.between(2, 5), F.concat(F.lit("s"), k.cast("string"), F.lit("xx")))


def round_half_even(x: Column, digits: int) -> Column:
    """Round a double by its exact binary value, ties to even.

    Spark's ``bround`` works on the shortest decimal text, so 0.00625 counts as a tie although the double lies
    above it. Here the rounding error of ``x * 10**digits`` is recovered exactly (two-product) and decides
    what only looks like a tie.
    """
    if digits == 0:
        return F.rint(x)
    return F.transform(F.array(x), lambda v: _half_even(v, digits))[0]  # binds the value, which is used many times


def _half_even(x: Column, digits: int) -> Column:
    m = float(10**digits)
    split = 134217729.0  # 2**27 + 1
    p = x * F.lit(m)
    c = x * F.lit(split)
    xh = c - (c - x)
    xl = x - xh
    err = (xh * F.lit(m) - p) + xl * F.lit(m)  # 10**digits fits in 26 bits, so it needs no split
    base = F.floor(p).cast("double")
    rest = p - base
    even = F.pmod(base, F.lit(2.0)) == 0.0
    up = (rest > 0.5) | ((rest == 0.5) & ((err > 0.0) | ((err == 0.0) & ~even)))
    return F.when(up, base + 1.0).otherwise(base) / F.lit(m)


def token_lifecycle(age: Column) -> Column:
    return (F.when(age < 60, "fresh").when(age < 3600, "active").when(age < 86400, "aging")
            .when(age.isNotNull(), "stale"))


def token_status(ttl: Column) -> Column:
    return F.when(ttl < 0, "expired").when(ttl < 60, "expiring_soon").when(ttl.isNotNull(), "valid")


def severity_band(score: Column) -> Column:
    return (F.when(score >= 80, "critical").when(score >= 50, "high").when(score >= 30, "medium")
            .otherwise("low"))


def argmax_name(pairs: list[tuple[str, Column]]) -> Column:
    """Name of the largest value; the first of equals wins. The first value no later one exceeds is the maximum."""
    out = F.lit(pairs[-1][0])
    for i in range(len(pairs) - 2, -1, -1):
        holds = reduce(lambda a, b: a & b, [pairs[i][1] >= later for _, later in pairs[i + 1:]])
        out = F.when(holds, pairs[i][0]).otherwise(out)
    return out
