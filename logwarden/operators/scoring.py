"""Seven factors, their combination, attacker levels: column arithmetic on window tables.

The baseline is six numbers' worth of distributions. They are read first and stand in the plan as constants, so scoring
adds no join and no shuffle, and filters on scores copy numbers only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.config import BASELINE_METRICS, FACTORS, IP_WINDOWS, Config
from logwarden.functions.scalar import argmax_name, round_half_even


DIST = "struct<sample_count: bigint, mean: double, std: double, cold_start: boolean>"


def distributions(baseline: DataFrame) -> dict[str, Column]:
    """metric -> distribution, as constants. Of several runs the newest counts; six rows at most are fetched."""
    order = [F.col(c) for c in ("ingest_date", "run", "computed_at") if c in baseline.columns] or [F.lit(0)]
    newest = (baseline.filter(F.col("metric").isin(*BASELINE_METRICS)).groupBy("metric")
              .agg(F.max_by(F.struct("sample_count", "mean", "std", "cold_start"), F.struct(*order)).alias("d")))
    return {r["metric"]: F.struct(*(F.lit(r["d"][c]).alias(c) for c in ("sample_count", "mean", "std", "cold_start"))).cast(DIST)
            for r in newest.collect()}


# The column each distribution is compared with.
MEASURES = {"requests": "request_count", "bytes": "response_bytes_total", "subs": "unique_subs_count"}


def _with_dist(df: DataFrame, **dists: Column) -> DataFrame:
    """Adds d_x (distribution) and z_x (z-score) for each measure; both null where there is no distribution."""
    rows = df.withColumns({f"d_{x}": d for x, d in dists.items()})
    return rows.withColumns({f"z_{x}": zscore(F.col(MEASURES[x]), F.col(f"d_{x}")) for x in dists})


def zscore(value: Column, dist: Column) -> Column:
    """Null without a distribution, on a cold start, or when the deviation is 0."""
    usable = dist.isNotNull() & ~F.coalesce(dist["cold_start"], F.lit(False)) & (dist["std"] != 0.0)
    return F.when(usable, (value - dist["mean"]) / dist["std"])


def burst(z: Column, weight: int, cap: int) -> Column:
    """Points above two deviations, rounded half to even and capped; 0 without a z-score."""
    points = F.rint(F.greatest(F.lit(0.0), z - 2) * weight)
    return F.coalesce(F.least(F.lit(float(cap)), points).cast("int"), F.lit(0))


def request_burst(z: Column) -> Column:
    return burst(z, 5, 25)


def response_size_burst(z: Column) -> Column:
    return burst(z, 6, 30)


def cumulative_exfil(z: Column) -> Column:
    return burst(z, 10, 50)


def token_replay(class_crossings: Column, country_crossings: Column) -> Column:
    return F.when((class_crossings > 0) | (country_crossings > 0), 80).otherwise(0)


def diversity_raw(subjects: Column, z: Column) -> Column:
    cold = F.when(subjects >= 10, 70).when(subjects >= 5, 30).otherwise(0)
    warm = F.when(z < 3, 0).when(z < 6, 70).otherwise(100)
    return F.when(z.isNull(), cold).otherwise(warm)


def response_sensitivity(email: Column, phone: Column, doorlock: Column) -> Column:
    email, phone = F.coalesce(email, F.lit(0)), F.coalesce(phone, F.lit(0))
    severe = F.coalesce(doorlock, F.lit(False)) | (email >= 10) | (phone >= 10)
    return F.when(severe, 70).when(phone >= 5, 50).otherwise(0)


def combine(f: dict[str, Column]) -> tuple[Column, Column]:
    """Total score and dominant factor from the seven factor columns."""
    override = F.greatest(f["ip_user_diversity"], f["response_sensitivity"]).cast("double")
    weight = F.lit(0.3)
    stat = f["request_burst"] + f["response_size_burst"] + f["cumulative_exfil"]
    additive = (f["token_violation"] + f["token_replay"]) + weight * stat
    total = F.least(F.lit(100.0), F.rint(F.greatest(override, additive))).cast("int")
    strongest = argmax_name([
        ("token_violation", f["token_violation"]),
        ("token_replay", f["token_replay"]),
        ("request_burst", weight * f["request_burst"]),
        ("response_size_burst", weight * f["response_size_burst"]),
        ("cumulative_exfil", weight * f["cumulative_exfil"]),
    ])
    overriding = F.when(f["ip_user_diversity"] >= f["response_sensitivity"], "ip_user_diversity").otherwise(
        "response_sensitivity")
    dominant = F.when(total == 0, None).when(override >= additive, overriding).otherwise(strongest)
    return total, dominant


def secondary_factor(f: dict[str, Column]) -> Column:
    """Largest unweighted factor other than response_sensitivity; null when all are 0."""
    rest = [(k, f[k]) for k in FACTORS if k != "response_sensitivity"]
    return F.when(F.greatest(*[c for _, c in rest]) > 0, argmax_name(rest))


def attacker_level(f: dict[str, Column], dominant: Column, window_size: Column) -> Column:
    # The four levels.
    leading = F.when(dominant == "response_sensitivity", secondary_factor(f)).otherwise(dominant)
    slow = F.lit("L4(Slow & Low)")
    return (F.when(dominant.isNull(), "L0")
            .when(leading.isNull(), "L4")
            .when(leading == "ip_user_diversity", F.when(window_size == "24h", slow).otherwise("L4"))
            .when(leading == "cumulative_exfil", slow)
            .when(leading.isin("token_replay", "token_violation", "request_burst", "response_size_burst"), "L2")
            .otherwise("L0"))


def classify(scored: DataFrame) -> DataFrame:
    """Adds level and exfiltration flags to rows that have the factor columns and ``dominant_factor``."""
    f = {k: F.col(k) for k in FACTORS}
    rs = f["response_sensitivity"]
    return scored.withColumns({
        "attacker_level": attacker_level(f, F.col("dominant_factor"), F.col("window_size")),
        "data_exfiltration_detected": rs >= 70, "suspected_exfiltration": (rs >= 50) & (rs < 70)})


def _total(df: DataFrame) -> DataFrame:
    total, dominant = combine({k: F.col(k) for k in FACTORS})
    return df.withColumns({"total_score": total, "dominant_factor": dominant})


def user_factors(users: DataFrame, baseline: DataFrame, pii: DataFrame | None = None) -> DataFrame:
    """Factor columns of user windows. ``pii`` = (user_id, email, phone, doorlock_with_address), one row a user."""
    none = F.lit(0)
    known, absent = distributions(baseline), F.lit(None).cast(DIST)
    rows = _with_dist(users, requests=known.get("request_burst", absent), bytes=known.get("response_size_burst", absent))
    if pii is None:
        sensitivity = none
    else:
        signals = pii.select(F.col("user_id").alias("target_id"), "email", "phone", "doorlock_with_address")
        rows = rows.join(signals, "target_id", "left")
        sensitivity = response_sensitivity(F.col("email"), F.col("phone"), F.col("doorlock_with_address"))
    return rows.withColumns({
        "token_violation": F.col("violation_score"),
        "request_burst": request_burst(F.col("z_requests")),
        "token_replay": token_replay(F.col("class_crossings"), F.col("country_crossings")),
        "response_size_burst": response_size_burst(F.col("z_bytes")),
        "ip_user_diversity": none, "response_sensitivity": sensitivity, "cumulative_exfil": none,
    }).drop("d_requests", "z_requests", "d_bytes", "z_bytes")


def ip_factors(ips: DataFrame, baseline: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Factor columns of IP windows and the record behind ip_user_diversity."""
    none = F.lit(0)
    day = F.col("window_size") == "24h"
    known, absent = distributions(baseline), F.lit(None).cast(DIST)
    subs = F.coalesce(*(F.when(F.col("window_size") == label, known.get(f"ip_user_diversity_{label}", absent)) for label, _ in IP_WINDOWS))
    rows = (_with_dist(ips, subs=subs, bytes=F.when(day, known.get("cumulative_exfil", absent)))
            .withColumn("raw", diversity_raw(F.col("unique_subs_count"), F.col("z_subs")))
            .withColumn("capped", F.coalesce(F.col("ip_class").isin(*cfg.soft_capped_classes), F.lit(False))
                        & (F.col("raw") > cfg.soft_cap)))
    meta = F.struct(
        F.col("raw").alias("raw_score"), "capped",
        F.when(F.col("capped"), F.concat(F.lit("ip_class="), "ip_class", F.lit(" whitelist soft cap"))).alias("cap_reason"),
        F.col("unique_subs_count").alias("unique_subs_raw"),
        round_half_even(F.col("z_subs"), 3).alias("zscore"),
        F.col("d_subs.mean").alias("baseline_mean"), F.col("d_subs.std").alias("baseline_std"),
        F.coalesce(F.col("d_subs.sample_count"), F.lit(0).cast("bigint")).alias("baseline_sample_count"),
        F.col("z_subs").isNull().alias("cold_start_fallback_applied"))
    return rows.withColumns({
        "token_violation": none, "request_burst": none, "token_replay": none, "response_size_burst": none,
        "ip_user_diversity": F.when(F.col("capped"), F.lit(cfg.soft_cap)).otherwise(F.col("raw")),
        "response_sensitivity": none, "cumulative_exfil": cumulative_exfil(F.col("z_bytes")),
        "ip_user_diversity_meta": meta,
    }).drop("d_subs", "z_subs", "d_bytes", "z_bytes", "raw", "capped")


def score_users(users: DataFrame, baseline: DataFrame, pii: DataFrame | None = None) -> DataFrame:
    rows = classify(_total(user_factors(users, baseline, pii)))
    replay = [F.col("class_crossings").alias("jti_count_with_class_crossing"),
              F.col("country_crossings").alias("jti_count_with_country_crossing")]
    return _document(rows, "user", ["triggered_rules",
                                    F.struct(F.struct(*replay).alias("token_replay")).alias("evidence")])


def score_ips(ips: DataFrame, baseline: DataFrame, cfg: Config = Config()) -> DataFrame:
    rows = classify(_total(ip_factors(ips, baseline, cfg)))
    return _document(rows, "ip", ["ip_user_diversity_meta", "ip_class", "ip_asn", "ip_org", "ip_country",
                                  "is_nat_whitelisted"])


def _document(rows: DataFrame, target_type: str, extra: list) -> DataFrame:
    return rows.select(
        F.col("window_start").alias("@timestamp"), F.lit(target_type).alias("target_type"), "target_id", "win",
        "window_start", "window_size", "total_score", "dominant_factor",
        F.struct(*FACTORS).alias("factor_breakdown"), "attacker_level",
        "data_exfiltration_detected", "suspected_exfiltration", *extra)


def risk_scores(users: DataFrame, ips: DataFrame, baseline: DataFrame, cfg: Config = Config(),
                pii: DataFrame | None = None, as_of: str | None = None) -> DataFrame:
    """User and IP risk documents in one table."""
    return (score_users(users, baseline, pii)
            .unionByName(score_ips(ips, baseline, cfg), allowMissingColumns=True)
            .withColumn("computed_at", F.lit(as_of).cast("string")))


def alerting(risk: DataFrame, cfg: Config = Config(), floor: DataFrame | None = None) -> DataFrame:
    """Rows at or above the alert score. ``floor`` is an optional one-row (p99) that may raise it."""
    score = F.col("total_score")
    if floor is None:
        return risk.filter(score >= cfg.alert_score)
    return risk.filter(score >= F.greatest(F.lit(float(cfg.alert_score)),
                                           F.coalesce(floor.select("p99").scalar(), F.lit(0.0))))


def score_p99(risk: DataFrame) -> DataFrame:
    """One row with the exact nearest-rank p99 of the total score."""
    from logwarden.operators.baseline import percentiles
    return percentiles(risk.select(F.lit("total_score").alias("metric"),
                                   F.col("total_score").cast("bigint").alias("value"))).select("p99")


def risk_summary(risk: DataFrame, cfg: Config = Config()) -> DataFrame:
    return risk.agg(
        F.count(F.lit(1)).alias("total_docs"),
        F.count_if(F.col("total_score") >= cfg.alert_score).alias("alert_count"),
        F.coalesce(F.max("total_score"), F.lit(0)).alias("max_score"),
        F.count_if("data_exfiltration_detected").alias("exfil_flagged"))


def dominant_histogram(risk: DataFrame, cfg: Config = Config()) -> DataFrame:
    return (alerting(risk, cfg).groupBy(F.coalesce("dominant_factor", F.lit("none")).alias("dominant_factor"))
            .agg(F.count(F.lit(1)).alias("alerts")))
