"""Per-user 5-minute windows.

``user_windows`` is the table that baselines, scoring and profiles read: plain measures, two hash aggregations
over one scan. ``user_events`` is the document: exact counts and the first violations. Sets of any size are rows of
``user_members`` and ``replay_samples``, keyed by the window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwarden.config import USER_WINDOW, Config
from logwarden.functions import scalar as X
from logwarden.operators.members import member_rows
from logwarden.operators.rules import TOKEN_RULES, hit, token_violations

KEYS = ["user_id", "win"]


def keyed(logs: DataFrame) -> DataFrame:
    """Logs that belong to a user window, with its start."""
    return (logs.filter(F.col("user_id").isNotNull() & F.col("receive_epoch").isNotNull())
            .withColumn("win", X.window_start(F.col("receive_epoch"), USER_WINDOW[1])))


def token_measures(logs: DataFrame, cfg: Config = Config(), keys: list[str] | None = None) -> DataFrame:
    """Measures per (window, jti). They merge: see ``merged_tokens``.

    Everything the window needs is additive over jti, so the token-replay test costs no extra pass, and a hot
    user's rows spread over its tokens. A jti crosses a class (or country) border when its smallest and
    largest value differ; 64-bit hashes stand for the strings because Spark hash-aggregates only fixed-width
    buffers and would sort all logs otherwise.
    """
    now = F.col("receive_epoch")
    jti = X.filled(F.col("jwt_id"))

    def code(name: str):
        return F.when(F.col(name) != "", F.xxhash64(name))

    return (logs.withColumn("jti", jti).groupBy(*(keys or KEYS), "jti").agg(
        F.count(F.lit(1)).alias("request_count"),
        F.count_if(F.col("status").between(200, 299)).alias("success_count"),
        F.count_if(F.col("status") >= 400).alias("error_count"),
        F.count_if(X.is_sensitive(F.col("uri"))).alias("suspicious_uri_count"),
        F.sum("bytes_sent").alias("response_bytes_total"),
        F.max("bytes_sent").alias("response_bytes_max"),
        F.bool_and(F.coalesce("baseline_eligible", F.lit(True))).alias("is_baseline_eligible"),
        F.bool_or(F.coalesce(F.col("client_ip") != "", F.lit(False))).alias("has_ip"),
        F.min(code("ip_class")).alias("class_lo"), F.max(code("ip_class")).alias("class_hi"),
        F.min(code("ip_country")).alias("country_lo"), F.max(code("ip_country")).alias("country_hi"),
        *[F.bool_or(hit(r, cfg, now)).alias(r.name) for r in TOKEN_RULES]))


def crossings(tokens: DataFrame) -> DataFrame:
    """Whether a token was seen on both sides of a class or country border in the window."""
    def differ(name: str) -> Column:
        return F.coalesce(F.col("jti").isNotNull() & F.col("has_ip") & (F.col(f"{name}_lo") != F.col(f"{name}_hi")), F.lit(False))

    return tokens.withColumns({f"crossed_{name}": differ(name) for name in ("class", "country")})


def token_grain(logs: DataFrame, cfg: Config = Config(), keys: list[str] | None = None) -> DataFrame:
    return crossings(token_measures(logs, cfg, keys))


def merged_tokens(rows: DataFrame) -> DataFrame:
    """Partial measures of several batches as those of one."""
    return rows.groupBy(*KEYS, "jti").agg(
        *[F.sum(c).alias(c) for c in ("request_count", "success_count", "error_count", "suspicious_uri_count", "response_bytes_total")],
        F.max("response_bytes_max").alias("response_bytes_max"), F.bool_and("is_baseline_eligible").alias("is_baseline_eligible"),
        F.bool_or("has_ip").alias("has_ip"), *[f(f"{name}_{end}").alias(f"{name}_{end}") for name in ("class", "country") for end, f in (("lo", F.min), ("hi", F.max))],
        *[F.bool_or(r.name).alias(r.name) for r in TOKEN_RULES])


def windows_of_tokens(rows: DataFrame, cfg: Config = Config()) -> DataFrame:
    """The windows that partial token rows add up to."""
    return finish(window_measures(crossings(merged_tokens(rows))), cfg)


def window_measures(tokens: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rolls the per-token measures up to the window."""
    return tokens.groupBy(*(keys or KEYS)).agg(
        *[F.sum(c).alias(c) for c in ("request_count", "success_count", "error_count", "suspicious_uri_count",
                                      "response_bytes_total")],
        F.max("response_bytes_max").alias("response_bytes_max"),
        F.bool_and("is_baseline_eligible").alias("is_baseline_eligible"),
        F.count("jti").alias("jti_count"),
        F.count_if("crossed_class").alias("class_crossings"),
        F.count_if("crossed_country").alias("country_crossings"),
        *[F.bool_or(r.name).alias(r.name) for r in TOKEN_RULES],
    )


def finish(windows: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Violation score and rule list from the per-rule flags, and the target columns."""
    fired = [F.when(F.col(r.name), F.lit(r.score)) for r in TOKEN_RULES]
    return windows.select(
        F.col("user_id").alias("target_id"), "win",
        X.epoch_to_iso(F.col("win")).alias("window_start"), F.lit(USER_WINDOW[0]).alias("window_size"),
        "request_count", "success_count", "error_count", "suspicious_uri_count",
        "response_bytes_total", "response_bytes_max", "is_baseline_eligible", "jti_count",
        "class_crossings", "country_crossings",
        F.least(F.lit(cfg.violation_cap), F.coalesce(F.greatest(*fired), F.lit(0))).alias("violation_score"),
        F.array_sort(F.array_compact(F.array(*[F.when(F.col(r.name), F.lit(r.name)) for r in TOKEN_RULES]))
                     ).alias("triggered_rules"),
    )


def user_windows(logs: DataFrame, cfg: Config = Config()) -> DataFrame:
    return finish(window_measures(token_grain(keyed(logs), cfg)), cfg)


def user_members(logs: DataFrame) -> DataFrame:
    """Whole sets as rows: (user_id, win, kind, member)."""
    return member_rows(keyed(logs), KEYS, {
        "ip_set": F.col("client_ip"), "jti_set": F.col("jwt_id"), "alg_set": F.col("alg"), "kid_set": F.col("kid")})


def replay_samples(logs: DataFrame) -> DataFrame:
    """Where tokens seen across a class or country border were seen: (user_id, win, jti, crossing_type, kind, member).

    Tokens that cross are found on hashes, as in ``token_grain``; only their logs are then opened.
    """
    token = [*KEYS, "jti"]
    rows = keyed(logs).withColumn("jti", X.filled(F.col("jwt_id"))).filter("jti IS NOT NULL")
    code = lambda name: F.when(F.col(name) != "", F.xxhash64(name))
    crossed = (rows.groupBy(*token).agg(
        F.bool_or(F.coalesce(F.col("client_ip") != "", F.lit(False))).alias("has_ip"),
        *(f(code(name)).alias(f"{name}_{end}") for name in ("ip_class", "ip_country") for end, f in (("lo", F.min), ("hi", F.max))))
        .filter("has_ip AND (ip_class_lo <> ip_class_hi OR ip_country_lo <> ip_country_hi)")
        .select(*token, F.when(F.col("ip_class_lo") != F.col("ip_class_hi"), "ip_class").otherwise("ip_country").alias("crossing_type")))
    return member_rows(rows.join(crossed, token), [*token, "crossing_type"], {
        "ip_set": F.col("client_ip"), "ip_class_set": F.col("ip_class"), "ip_country_set": F.col("ip_country")})


def violation_samples(logs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """The first violations of each window, by (time, log, rule)."""
    first = Window.partitionBy(*KEYS).orderBy("receive_epoch", "log_id", "rule_no")
    rows = (keyed(token_violations(logs, cfg)).withColumn("rn", F.row_number().over(first))
            .filter(F.col("rn") <= cfg.violation_samples))
    sample = F.struct("rn", "rule", "score", "reason", F.col("jwt_id").alias("jti"), "uri")
    return rows.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(sample)),
                                               lambda s: s.dropFields("rn")).alias("violation_samples"))


def user_events(logs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """The user-window document."""
    uri = F.concat(F.lit("u"), F.coalesce("uri", F.lit("")))  # the empty URI counts as one
    counts = (member_rows(keyed(logs), KEYS, {"ip": F.col("client_ip"), "uri": uri}).groupBy(*KEYS)
              .agg(F.count_if(F.col("kind") == "uri").alias("unique_uris_count"), F.count_if(F.col("kind") == "ip").alias("ip_count")))
    samples = violation_samples(logs, cfg)
    doc = (user_windows(logs, cfg).withColumnRenamed("target_id", "user_id").join(counts, KEYS)
           .join(samples, KEYS, "left"))
    violation_list = F.coalesce("violation_samples", F.array().cast(samples.schema["violation_samples"].dataType))
    requests = F.col("request_count")
    return doc.select(
        F.col("window_start").alias("@timestamp"),
        F.lit("user").alias("target_type"), F.col("user_id").alias("target_id"), "win", "window_start",
        "window_size", "request_count", "success_count", "error_count",
        X.round_half_even(F.col("error_count") / requests, 4).alias("error_rate"),
        "unique_uris_count", "suspicious_uri_count", "ip_count", "jti_count", "response_bytes_total",
        X.round_half_even(F.col("response_bytes_total") / requests, 1).alias("response_bytes_avg"),
        "response_bytes_max",
        F.struct(F.col("class_crossings").alias("jti_count_with_class_crossing"),
                 F.col("country_crossings").alias("jti_count_with_country_crossing")).alias("token_replay_meta"),
        F.struct(F.col("violation_score").alias("score"), F.col("triggered_rules"),
                 violation_list.alias("violating_samples")).alias("token_violation"),
        "is_baseline_eligible",
    )


def windows_of(events: DataFrame) -> DataFrame:
    """The scoring columns of stored user-window documents."""
    return events.select(
        "target_id", "win", "window_start", "window_size", "request_count", "success_count", "error_count",
        "suspicious_uri_count", "response_bytes_total", "response_bytes_max", "is_baseline_eligible", "jti_count",
        F.col("token_replay_meta.jti_count_with_class_crossing").alias("class_crossings"),
        F.col("token_replay_meta.jti_count_with_country_crossing").alias("country_crossings"),
        F.col("token_violation.score").alias("violation_score"),
        F.col("token_violation.triggered_rules").alias("triggered_rules"))
