"""Quality rules: fixed base rules, then robust multivariate outliers per language and source."""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwarden.llm.common import fresh, same, staged
from logwarden.llm.text_stats import count_texts

#: The statistics judged, as expressions over the struct of counts, and for each the deviation that is never odd:
#: what estimates say is added to it. Sizes are left out on purpose: being long or short is no fault.
STATISTICS = {
    "word_length": (lambda c: F.log(c["word_chars"] / c["n_words"]), 0.1),
    "symbols": (lambda c: F.log1p(100 * c["n_symbols"] / c["n_words"]), 0.4),
    "marks": (lambda c: F.log1p(100 * c["n_marks"] / c["word_chars"]), 0.3),
    "capitals": (lambda c: F.log1p(100 * c["n_upper"] / c["word_chars"]), 0.4),
    "repeated_lines": (lambda c: F.log1p(100 * c["n_dup_lines"] / c["n_lines"]), 1.2),
    "repeated_words": (lambda c: F.log1p(100 * c["n_repeat_words"] / c["n_words"]), 1.2),
}
P = len(STATISTICS)
FLOORS = np.array([f for _, f in STATISTICS.values()])
#: The floors that are left in groups of very many texts, and the size of a group whose floors (squared) are half way there.
LEAST, SMALL = np.array([0.1, 0.4, 0.2, 0.4, 0.5, 0.45]), 20
VALUES = [f"x{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
ESTIMATE = "center array<double>, precision array<double>"
#: Histogram bins: width for a statistic, and bins per unit of the logarithm of a squared distance.
WIDTH, LOG_BINS = 1 / 64, 32


def chi_square_quantile(p: float, degrees: int) -> float:
    """By the cube-root (Wilson-Hilferty) approximation."""
    a = 2 / (9 * degrees)
    return degrees * (1 - a + NormalDist().inv_cdf(p) * math.sqrt(a)) ** 3


def base_failed(counts: Column) -> Column:
    """Fewer than 20 words, or over 30 percent of them inside repeated windows."""
    return (counts["n_words"] < 20) | (100 * counts["n_repeat_words"] > 30 * counts["n_words"])


def squared_distance() -> Column:
    """The Mahalanobis distance, squared, of the VALUES of a row that carries an estimate."""
    y = [F.col(x) - F.col("center")[i] for i, x in enumerate(VALUES)]
    terms = [(1 if i == j else 2) * y[i] * y[j] * F.col("precision")[i * P + j] for i, j in PAIRS]
    return sum(terms[1:], terms[0])


def with_estimate(points: DataFrame, estimates: DataFrame) -> DataFrame:
    """Points with their group's estimate. Spark broadcasts the estimates where they are small enough, else it deals both
    sides by group and splits hot groups."""
    renamed = estimates.withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    return points.join(renamed, same(points["lang"], renamed["of_lang"]) & same(points["source"], renamed["of_source"])).drop("of_lang", "of_source")


def _start(points: DataFrame) -> DataFrame:
    """Medians and quartile ranges, from a histogram of each statistic, as the first estimate."""
    each = points.select("lang", "source", F.posexplode(F.array(*VALUES)).alias("i", "x"))
    bins = each.groupBy("lang", "source", "i", F.floor(F.col("x") / WIDTH).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("lang", "source", "i")
    ranked = (bins.withColumn("upto", F.sum("n").over(own.orderBy("bin"))).withColumn("total", F.sum("n").over(own)))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), (F.col("bin") + 0.5) * WIDTH))
    spread = ranked.groupBy("lang", "source", "i").agg(at(0.5).alias("mid"), (at(0.75) - at(0.25)).alias("range"))
    floor = F.get(F.array(*map(F.lit, FLOORS.tolist())), F.col("i"))
    inverse = 1 / (F.pow(F.col("range") / 1.349, 2) + floor * floor)
    rows = (spread.select("lang", "source", F.struct("i", "mid", inverse.alias("inverse")).alias("s"))
            .groupBy("lang", "source").agg(F.array_sort(F.collect_list("s")).alias("s")))  # one entry for each statistic
    cells = F.array(*(F.col("s")[i]["inverse"] if i == j else F.lit(0.0) for i in range(P) for j in range(P)))
    return rows.select("lang", "source", F.col("s.mid").alias("center"), cells.alias("precision"))


def _histogram(points: DataFrame, estimates: DataFrame, sums: list[Column]) -> DataFrame:
    """``sums`` and counts by group and distance bin, with the running and whole count of the group."""
    binned = with_estimate(points, estimates).withColumn("bin", F.floor(F.log(squared_distance() + 1e-9) * LOG_BINS))
    bins = binned.groupBy("lang", "source", "bin").agg(F.count(F.lit(1)).alias("n"), F.first("center").alias("center"), F.first("precision").alias("precision"), *sums)
    own = Window.partitionBy("lang", "source")
    return bins.withColumn("upto", F.sum("n").over(own.orderBy("bin"))).withColumn("total", F.sum("n").over(own))


def _inverted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        centers, precisions = [], []
        for n, center, first, second in zip(frame["n"], frame["center"], frame["first"], frame["second"]):
            mean = np.array(first) / n
            cov = np.zeros((P, P))
            for (i, j), s in zip(PAIRS, second):
                cov[i, j] = cov[j, i] = s / n - mean[i] * mean[j]
            centers.append(np.array(center) + mean)
            precisions.append(np.linalg.inv(cov + np.diag(FLOORS ** 2)).ravel())
        yield pd.DataFrame({"lang": frame["lang"], "source": frame["source"], "center": centers, "precision": precisions})


def _concentrated(points: DataFrame, estimates: DataFrame, share: float) -> DataFrame:
    """One concentration step: mean and covariance of the ``share`` of each group nearest to its estimate."""
    y = [F.col(x) - F.col("center")[i] for i, x in enumerate(VALUES)]
    sums = [F.sum(v).alias(f"s{i}") for i, v in enumerate(y)] + [F.sum(y[i] * y[j]).alias(f"s{i}_{j}") for i, j in PAIRS]
    nearest = _histogram(points, estimates, sums).filter(F.col("upto") - F.col("n") < share * F.col("total"))
    total = nearest.groupBy("lang", "source").agg(
        F.sum("n").alias("n"), F.first("center").alias("center"), F.array(*(F.sum(f"s{i}") for i in range(P))).alias("first"),
        F.array(*(F.sum(f"s{i}_{j}") for i, j in PAIRS)).alias("second"))
    return total.mapInPandas(_inverted, f"lang string, source string, {ESTIMATE}")


def robust_estimates(points: DataFrame, share: float = 0.55, steps: int = 5) -> DataFrame:
    """Minimum-covariance-determinant estimates (center, precision, scale) of VALUES for each language and source.

    From medians and quartile ranges, ``steps`` concentration steps each take the ``share`` of a group nearest to the last
    estimate (by a histogram of log distances, the bin at the edge whole) and its mean and covariance, which never
    raises the determinant. A step is one pass over all points: moments are summed by group and bin before the shuffle,
    so a hot group costs as many rows as bins in each task. Groups are rows, never gathered anywhere; a step's result is
    written, so later ones don't repeat it. FLOORS are added to the covariance, so groups of any size, even of one row,
    have an estimate. ``scale`` makes the median distance what it is for normal data, but never shrinks distances'
    tolerance.
    """
    estimates = staged(_start(points), "estimates")
    for _ in range(steps):
        estimates = staged(_concentrated(points, estimates, share), "estimates")
    return _scaled(points, estimates)


def _scaled(points: DataFrame, estimates: DataFrame) -> DataFrame:
    middle = F.min(F.when(F.col("upto") >= 0.5 * F.col("total"), F.exp((F.col("bin") + 0.5) / LOG_BINS)))
    scaled = (_histogram(points, estimates, []).groupBy("lang", "source")
              .agg(F.first("center").alias("center"), F.first("precision").alias("precision"),
                   F.greatest(F.lit(1.0), middle / chi_square_quantile(0.5, P)).alias("scale")))
    return staged(scaled, "estimates")


def _lowered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        made = []
        for n, precision in zip(frame["n"], frame["precision"]):
            cov = np.linalg.inv(np.array(precision).reshape(P, P)) - np.diag(FLOORS ** 2)
            made.append(np.linalg.inv(cov + np.diag(LEAST ** 2 + (FLOORS ** 2 - LEAST ** 2) * SMALL / (n + SMALL))).ravel())
        yield pd.DataFrame({"lang": frame["lang"], "source": frame["source"], "center": frame["center"], "precision": made})


def sized_estimates(points: DataFrame) -> DataFrame:
    """Robust estimates whose floors sink from FLOORS to LEAST as the group grows, with the scale that goes with them.

    Under FLOORS repeated lines or words alone never reach the limit. Under LEAST, in a group that has few, half the lines
    repeating or 25 percent of the words do. LEAST is not 0: in a clean group the first repeated line would reject.
    """
    sizes = points.groupBy(F.col("lang").alias("size_lang"), F.col("source").alias("size_source")).agg(F.count(F.lit(1)).alias("n"))
    rows = robust_estimates(points).join(sizes, same(F.col("lang"), F.col("size_lang")) & same(F.col("source"), F.col("size_source")))
    lowered = rows.select("lang", "source", "center", "precision", "n").mapInPandas(_lowered, f"lang string, source string, {ESTIMATE}")
    return _scaled(points, staged(lowered, "estimates"))


def judge(docs: DataFrame, rate: float = 1e-7, out: str = "quality", keep: list[str] | None = None) -> DataFrame:
    """Adds the struct ``out`` to each document: its counts, base_failed, distance (squared, scaled) and kept.

    A document that passes the base rules is rejected if its transformed statistics lie further from the robust
    estimate of its language and source than normal data do at ``rate``. Counts are made once and written with the
    kept columns; estimates are over all documents that pass the base rules.

    Texts that are null, empty or blank have no words, fail the base rules and have a null distance; so do all texts
    under 20 words. Null languages and sources are groups like others; repeated rows count as often as they occur; ids
    are not looked at. An empty table stays empty. ``keep`` names the columns to carry on (all by default); one named
    ``out`` is replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != out.lower()]
    counts = fresh(docs, "counts")
    rows = staged(count_texts(docs, counts, list(dict.fromkeys([*keep, "lang", "source"]))), "counted")
    return _judged(rows, counts, rate, out, keep)


def _judged(rows: DataFrame, counts: str, rate: float, out: str, keep: list[str]) -> DataFrame:
    c = F.col(counts)
    values = [made(c).alias(x) for x, (made, _) in zip(VALUES, STATISTICS.values())]
    points = rows.filter(~base_failed(c)).select("lang", "source", *values)
    lang, source, group = (fresh(rows, x) for x in ("of_lang", "of_source", "of_group"))
    estimates = sized_estimates(points).select(F.col("lang").alias(lang), F.col("source").alias(source), F.struct("center", "precision", "scale").alias(group))
    joined = rows.join(estimates, same(F.col("lang"), F.col(lang)) & same(F.col("source"), F.col(source)), "left")
    x = [made(c) - F.col(group)["center"][i] for i, (made, _) in enumerate(STATISTICS.values())]
    terms = [(1 if i == j else 2) * x[i] * x[j] * F.col(group)["precision"][i * P + j] for i, j in PAIRS]
    distance = F.when(~base_failed(c), sum(terms[1:], terms[0]) / F.col(group)["scale"])
    limit = chi_square_quantile(1 - rate, P)
    judged = F.struct(c.alias("counts"), base_failed(c).alias("base_failed"), distance.alias("distance"),
                      (~base_failed(c) & (distance <= limit)).alias("kept"))
    return joined.select(*(f"`{c}`" for c in keep), judged.alias(out))


def good_documents(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with the columns of ``docs``."""
    out = fresh(docs, "quality")
    return judge(docs, out=out).filter(F.col(out)["kept"]).select(*(f"`{c}`" for c in docs.columns))
