"""Windows of users and of all address lengths as one stream closes them, without state in Spark's state store.

The queries of ``streaming/windows.py`` each read, parse and de-duplicate the source and keep every log of a batch in state. Here a
micro-batch does that once: the partial rows of its logs and those of windows left open give the windows that its clock closes. What
stays open is filed under the batch's number and read by later batches by day; nothing is rewritten.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from logwarden.config import USER_WINDOW, Config
from logwarden.functions import scalar as X
from logwarden.operators import ip_windows as I
from logwarden.operators import profiles as P
from logwarden.operators import user_windows as U
from logwarden.operators.normalize import IDENTITY, normalize_logs
from logwarden.plans.scoring import WINDOW_COLUMNS
from logwarden.schema import raw_schema
from logwarden.sources.sinks import stage
from logwarden.streaming.jobs import start
from logwarden.streaming.scored import dated, ends

CLOCK = T.StructType([T.StructField("clock", T.LongType())])


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table of batches with their number, ``batch``; empty before the first."""
    stored = T.StructType([*(f for f in schema if f.name != "day"), T.StructField("batch", T.LongType()), *(f for f in schema if f.name == "day")])
    try:
        return spark.read.schema(stored).parquet(path)
    except AnalysisException as error:
        if not (error.getCondition() or "").startswith("PATH_NOT_FOUND"):
            raise
        return spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in stored))


def _parts(logs: DataFrame, cfg: Config) -> dict[str, DataFrame]:
    """Partial rows of logs, which add up over batches, and the logs' ids, each with its event day."""
    return {"tokens": dated(U.token_measures(U.keyed(logs), cfg)), "subjects": dated(I.subject_rows(logs)), "firsts": dated(I.head_rows(logs)),
            "ids": logs.select(*IDENTITY, X.day_of(F.col("receive_epoch")).alias("day"))}


def _windows(parts: dict[str, DataFrame], repeated: bool, before: int | None, now: int | None, cfg: Config) -> tuple[DataFrame, DataFrame]:
    """The windows that end after ``before`` and by ``now``, as far as these are given; ``repeated`` says that rows of several
    batches may share a key."""
    def due(rows: DataFrame, end: Column) -> DataFrame:
        rows = rows if now is None else rows.filter(end <= now)
        return rows if before is None else rows.filter(end > before)

    tokens = due(parts["tokens"].drop("day"), F.col("win") + USER_WINDOW[1])
    tokens = U.merged_tokens(tokens) if repeated else tokens
    subjects, firsts = (due(I.all_lengths(parts[name].drop("day")), ends(F.col("window_size"))) for name in ("subjects", "firsts"))
    return U.finish(U.window_measures(U.crossings(tokens)), cfg), I.windows_of_rows(subjects, firsts)


def _clock(spark: SparkSession, path: str, number: int | None = None) -> int | None:
    """The event time up to which windows are closed, as of before batch ``number``; None at first."""
    clocks = _read(spark, f"{path}/clock", CLOCK)
    return (clocks if number is None else clocks.filter(F.col("batch") < number)).agg(F.max("clock")).first()[0]


def _kept(spark: SparkSession, path: str, like: dict[str, DataFrame], clock: int, number: int | None = None) -> dict[str, DataFrame]:
    """What batches (those before ``number``) have left open. Windows nest, so one that is open at ``clock`` begins on its day or later."""
    def rows(name: str, df: DataFrame) -> DataFrame:
        filed = _read(spark, f"{path}/open/{name}", df.schema).filter(F.col("day") >= X.day_of(F.lit(clock)))
        return (filed if number is None else filed.filter(F.col("batch") < number)).drop("batch")

    return {name: rows(name, df) for name, df in like.items()}


def close_batch(spark: SparkSession, logs: DataFrame, number: int, path: str, work: str, cfg: Config = Config(), lateness: int = 60) -> None:
    """Files the windows that micro-batch ``number`` closes, and what it leaves open. Run again, it replaces its own output.

    The clock is the newest log's time less ``lateness`` seconds and never goes back. Logs count once by IDENTITY. One that is not
    newer than the clock before its batch is late and is left out, as Spark leaves it out; one that comes twice is either late by
    then or among the ids kept, which are those newer than the clock.
    """
    past = _clock(spark, path, number)
    # Spark turns adaptive execution off in the session of a micro-batch; what is read with ``spark`` has it.
    new = stage(logs.filter(F.col("receive_epoch").isNotNull()).select(*WINDOW_COLUMNS), work, "closing-batch", spark)
    new = P.once_each(new if past is None else new.filter(F.col("receive_epoch") > past))
    parts = _parts(new, cfg)
    kept = None
    if past is not None:
        kept = _kept(spark, path, parts, past, number)
        known = kept["ids"].filter(F.col("receive_epoch") > past).select(*(F.col(c).alias(f"known_{c}") for c in IDENTITY))
        new = new.join(known, [F.col(c).eqNullSafe(F.col(f"known_{c}")) for c in IDENTITY], "left_anti")
        parts = _parts(new, cfg)
    newest = new.agg(F.max("receive_epoch")).first()[0]
    now = max((x for x in (past, None if newest is None else newest - lateness) if x is not None), default=None)
    if now is None:
        return
    whole = parts if kept is None else {name: rows.unionByName(kept[name]) for name, rows in parts.items()}
    for name, df in zip(("users", "addresses"), _windows(whole, kept is not None, past, now, cfg)):
        df.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
    for name, rows in parts.items():
        left = {"tokens": F.col("win") + USER_WINDOW[1] > now, "ids": F.col("receive_epoch") > now}.get(name, F.col("day") >= X.day_of(F.lit(now)))
        rows.filter(left).repartition("day").write.mode("overwrite").partitionBy("day").parquet(f"{path}/open/{name}/batch={number}")
    spark.range(1).select(F.lit(now).cast("bigint").alias("clock")).write.mode("overwrite").parquet(f"{path}/clock/batch={number}")


def closing_stream(logs: DataFrame, path: str, checkpoint: str, work: str, cfg: Config = Config(), once: bool = True,
                   every: str = "5 minutes", lateness: int = 60) -> StreamingQuery:
    """Files the windows of a stream of logs in the folder ``path``, which belongs to one checkpoint."""
    spark = logs.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        close_batch(spark, batch, number, path, work, cfg, lateness)

    return start(logs, each, checkpoint, once, every)


def _no_logs(spark: SparkSession) -> DataFrame:
    return normalize_logs(spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in raw_schema())))


def closed_windows(spark: SparkSession, path: str, cfg: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """User windows and address windows of all lengths that have been closed."""
    none = _no_logs(spark)
    users, ips = (_read(spark, f"{path}/{name}", df.schema).drop("batch") for name, df in (("users", U.user_windows(none, cfg)), ("addresses", I.ip_windows(none))))
    return users, ips


def open_windows(spark: SparkSession, path: str, cfg: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """The windows that are still open, as far as their logs have come. With ``closed_windows`` these are the windows of all logs."""
    parts, clock = _parts(_no_logs(spark), cfg), _clock(spark, path)
    return _windows(parts if clock is None else _kept(spark, path, parts, clock), True, clock, None, cfg)
