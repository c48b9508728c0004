"""Population baselines: count, mean, population deviation and exact nearest-rank percentiles per metric."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwarden.config import BASELINE_METRICS, Config
from logwarden.functions.scalar import round_half_even

QUANTILES = {"p50": 0.50, "p95": 0.95, "p99": 0.99}
BUCKET_BITS = 12


def metric_values(users: DataFrame, ips: DataFrame, excluded: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(metric, value) over eligible windows, with the columns ``keep``; ``excluded`` lists target_id that must not shape the baseline."""
    def eligible(df: DataFrame) -> DataFrame:
        kept = df.filter(~F.col("is_baseline_eligible").eqNullSafe(False))  # pushed to the scan
        return kept if excluded is None else kept.join(excluded.select("target_id").distinct(), "target_id",
                                                       "left_anti")

    def entry(metric: Column, value: str) -> Column:
        return F.struct(metric.alias("metric"), F.col(value).cast("bigint").alias("value"))

    day = F.when(F.col("window_size") == "24h", F.lit("cumulative_exfil"))
    user_part = eligible(users).select(*keep, F.inline(F.array(
        entry(F.lit("request_burst"), "request_count"),
        entry(F.lit("response_size_burst"), "response_bytes_total"))))
    ip_part = eligible(ips).select(*keep, F.inline(F.array(
        entry(F.concat(F.lit("ip_user_diversity_"), "window_size"), "unique_subs_count"),
        entry(day, "response_bytes_total"))))
    return user_part.unionByName(ip_part).filter("metric IS NOT NULL AND value IS NOT NULL")


def _bucket(value: Column) -> Column:
    """The value with all but its leading bits cleared: monotone, and at most 2**12 buckets per power of two."""
    bits = F.greatest(F.length(F.bin(F.abs(value))) - (BUCKET_BITS + 1), F.lit(0))
    return value - F.pmod(value, F.call_function("shiftleft", F.lit(1).cast("bigint"), bits))


def percentiles(values: DataFrame) -> DataFrame:
    return percentiles_of_counts(values.groupBy("metric", "value").agg(F.count(F.lit(1)).alias("c")))


def percentiles_of_counts(counts: DataFrame) -> DataFrame:
    """sorted[min(n - 1, floor(q * n))] per metric, without sorting a metric in one task.

    ``counts`` is a histogram of exact values, (metric, value, c), counted in parallel. Its buckets (a bounded number whatever
    the data) give the running rank; only the buckets that hold a wanted rank are then opened value by value.
    """
    histogram = (counts.withColumn("bucket", _bucket(F.col("value")))
                 .filter("metric IS NOT NULL AND bucket IS NOT NULL"))  # same plan in both uses: shuffled once
    whole, upto = Window.partitionBy("metric"), Window.partitionBy("metric").orderBy("bucket")
    coarse = (histogram.groupBy("metric", "bucket").agg(F.sum("c").alias("c"))
              .withColumn("n", F.sum("c").over(whole))
              .withColumn("before", F.sum("c").over(upto) - F.col("c")))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(q).alias("q"))
                                 for name, q in QUANTILES.items()]))
    rank = F.least(F.col("n") - 1, F.floor(F.col("w.q") * F.col("n")).cast("bigint"))
    targets = (coarse.withColumn("w", wanted).withColumn("rank", rank)
               .filter((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("c")))
               .select("metric", "bucket", F.col("w.name").alias("name"),
                       (F.col("rank") - F.col("before")).alias("rest")))
    within = Window.partitionBy("metric", "name").orderBy("value")
    opened = (histogram.join(F.broadcast(targets), ["metric", "bucket"])  # 6 metrics x 3 quantiles at most
              .withColumn("seen", F.sum("c").over(within)).filter(F.col("seen") > F.col("rest")))
    picked = opened.groupBy("metric", "name").agg(F.min("value").cast("double").alias("value"))
    return picked.groupBy("metric").agg(*[
        F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in QUANTILES])


def distributions(values: DataFrame) -> DataFrame:
    moments = values.groupBy("metric").agg(
        F.count(F.lit(1)).alias("sample_count"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return rounded(moments.join(percentiles(values), "metric"))


def rounded(dist: DataFrame) -> DataFrame:
    return dist.withColumns({c: round_half_even(F.col(c), 3) for c in ("mean", "std")})


def histogram_distributions(counts: DataFrame) -> DataFrame:
    """The distributions that (metric, value, c) rows stand for. Sums are exact decimals; the deviation is taken around the mean
    in a second step over the counts, so large values lose nothing to cancellation."""
    total = F.sum(F.col("value").cast("decimal(19,0)") * F.col("c").cast("decimal(19,0)")).cast("double")
    means = counts.groupBy("metric").agg(F.sum("c").alias("sample_count"), total.alias("total"))
    means = means.select("metric", "sample_count", (F.col("total") / F.col("sample_count")).alias("mean"))
    off = F.col("value") - F.col("mean")
    spread = counts.join(F.broadcast(means), "metric").groupBy("metric").agg(F.sum(off * off * F.col("c")).alias("spread"))  # 6 metrics
    moments = means.join(spread, "metric").withColumn("std", F.sqrt(F.col("spread") / F.col("sample_count"))).drop("spread")
    return rounded(moments.join(percentiles_of_counts(counts), "metric"))


def compute_baseline(users: DataFrame, ips: DataFrame, cfg: Config = Config(),
                     excluded: DataFrame | None = None, as_of: str | None = None) -> DataFrame:
    """Six rows, one per metric, also for metrics without samples."""
    return all_metrics(distributions(metric_values(users, ips, excluded)), cfg, as_of)


def all_metrics(dist: DataFrame, cfg: Config = Config(), as_of: str | None = None) -> DataFrame:
    names = dist.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(m) for m in BASELINE_METRICS])).alias("metric"))
    count = F.coalesce("sample_count", F.lit(0).cast("bigint"))
    return names.join(dist, "metric", "left").select(
        "metric", count.alias("sample_count"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mean", "std", *QUANTILES)],
        F.lit(as_of).cast("string").alias("computed_at"), (count < cfg.min_samples).alias("cold_start"))


def high_risk_targets(risk: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Targets of an earlier round that must stay out of the next baseline."""
    return risk.filter(F.col("total_score") >= cfg.exclude_score).select("target_id").distinct()
