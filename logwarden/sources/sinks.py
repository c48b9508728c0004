"""Writers: runs of daily tables, staged tables and the append-only profile store, all on shared storage."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Mapping
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY = "ingest_date"
#: Bloom filters on users, as small as a file's users allow.
BY_USER = {"parquet.bloom.filter.enabled#user_id": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
COMMITS = "version bigint, commit string, run string, through date"


def run_folder(path: str, run: str) -> str:
    return f"{path}/run={quote(run, safe='')}"


def write_daily(df: DataFrame, path: str, run: str, day: dt.date | None = None) -> dict:
    """Files ``df`` under its run and the write day. Event time stays in the rows.

    ``run`` names the batch: writing a run again, on whatever day, replaces all its files, so a retried batch leaves no
    duplicates. Returns the rows written, counted while writing.
    """
    day = day or dt.datetime.now(dt.timezone.utc).date()
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.withColumn(DAY, F.lit(day)).write.partitionBy(DAY).mode("overwrite").parquet(run_folder(path, run))
    return {"saved": seen.get["rows"], "path": path, "run": run, DAY: day.isoformat()}


def read_run(spark: SparkSession, path: str, run: str, schema: T.StructType) -> DataFrame:
    """Exactly what the last write of ``run`` left, without the write day."""
    return spark.read.schema(T.StructType([*schema, T.StructField(DAY, T.DateType())])).parquet(run_folder(path, run)).drop(DAY)


def stage(df: DataFrame, work: str, name: str, reader: SparkSession | None = None) -> DataFrame:
    """Writes a table that several later steps read to the folder ``work`` and reads it back, with ``reader`` if given.

    ``work`` is shared storage, so the table outlives executors, and readers get column pruning and filters. Staged
    tables are not deleted here.
    """
    target = f"{work.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(target)
    return (reader or df.sparkSession).read.schema(df.schema).parquet(target)


# -- profile store --------------------------------------------------------------------------------------------
# Every commit adds files of its own under <part>/commit=<id>/day=<event day> and never touches others. A commit counts
# once its row is in the commit log, so a failed write leaves nothing behind that is read.

# A store has one writer at a time. Each version is a folder that only one writer can make; one whose reads are older than
# the newest version is refused, and its batch does not count.

class StoreConflict(RuntimeError):
    """Another writer has committed since this one read the store."""


def _has(error: AnalysisException, condition: str) -> bool:
    return (error.getCondition() or "").startswith(condition)


def committed(spark: SparkSession, path: str) -> DataFrame:
    """The commit log, empty for a new store."""
    try:
        return spark.read.schema(COMMITS).parquet(f"{path}/commits")
    except AnalysisException as error:
        if not _has(error, "PATH_NOT_FOUND"):
            raise
        return spark.createDataFrame([], COMMITS)


def store_version(spark: SparkSession, path: str) -> int:
    return committed(spark, path).agg(F.max("version")).first()[0] or 0


class Snapshot:
    """What of a store counts at one moment. The commit log, a short row for each commit, is read once.

    ``pending`` names a commit whose rows are written but not yet committed; they are read as of the next version.
    """

    def __init__(self, spark: SparkSession, path: str, pending: str | None = None, log: list | None = None):
        self.spark, self.path = spark, path
        self.log = committed(spark, path).select("commit", "run", "version", "through").collect() if log is None else log
        self.version = max((r[2] for r in self.log), default=0)
        self.runs = {r[1] for r in self.log}
        known = [(r[0], r[2]) for r in self.log] + ([(pending, self.version + 1)] if pending else [])
        self.commits = spark.createDataFrame(known, "commit string, version bigint")
        merged = [(r[2], r[3]) for r in self.log if r[3] is not None]
        self.compaction = max(merged) if merged else None

    def with_pending(self, commit: str) -> Snapshot:
        return Snapshot(self.spark, self.path, commit, self.log)

    def part(self, name: str, schema: T.StructType) -> DataFrame:
        """The rows of a part that count, with their event ``day`` and the ``version`` of their commit.

        After a compaction its own rows stand for the days it covers in place of those of earlier commits.
        """
        stored = T.StructType([*(f for f in schema if f.name != "day"), T.StructField("commit", T.StringType()), T.StructField("day", T.DateType())])
        try:
            rows = self.spark.read.schema(stored).parquet(f"{self.path}/{name}")
        except AnalysisException as error:
            if not _has(error, "PATH_NOT_FOUND"):
                raise
            return self.spark.createDataFrame([], stored).withColumn("version", F.lit(0).cast("bigint")).drop("commit")
        rows = rows.join(F.broadcast(self.commits), "commit")  # Spark can't tell its size and would deal all rows by their few commits
        if self.compaction is not None:
            version, through = self.compaction
            rows = rows.filter((F.col("version") >= version) | (F.col("day") > F.lit(through)))
        return rows.drop("commit")


def read_part(spark: SparkSession, path: str, part: str, schema: T.StructType) -> DataFrame:
    return Snapshot(spark, path).part(part, schema)


def write_parts(path: str, commit: str, parts: Mapping[str, DataFrame]) -> None:
    """Writes rows (each with its event ``day``) of a commit that does not count yet. Rows of a user or target lie together
    within a file, and files without a user are told by their Bloom filters. A day's rows are brought together first, so there
    are about as many files as days, and more only where a day is large; adaptive execution splits such a day."""
    for part, rows in parts.items():
        keys = [c for c in ("day", "slot", "user_id", "target_id", "client_ip") if c in rows.columns]
        rows.hint("rebalance", "day").sortWithinPartitions(*keys).write.partitionBy("day").options(**BY_USER).parquet(f"{path}/{part}/commit={commit}")


def finish_commit(spark: SparkSession, path: str, commit: str, run: str, after: int, through: dt.date | None = None) -> int:
    """Makes a commit count, if ``after`` is still the newest version. Returns its own."""
    row = spark.range(1).select(F.lit(commit).alias("commit"), F.lit(run).alias("run"), F.lit(through).cast("date").alias("through"))
    if store_version(spark, path) != after:
        raise StoreConflict(f"{path} has a newer version than {after}, which {run!r} has read")
    try:
        row.write.mode("errorifexists").parquet(f"{path}/commits/version={after + 1}")
    except AnalysisException as error:
        if not _has(error, "PATH_ALREADY_EXISTS"):
            raise
        raise StoreConflict(f"{path} has been given version {after + 1} by another writer while {run!r} was written") from error
    return after + 1


def write_commit(spark: SparkSession, path: str, parts: Mapping[str, DataFrame], run: str, through: dt.date | None = None,
                 after: int | None = None) -> int:
    """Adds rows to parts of the store as one commit. ``after`` is the version that the rows were made from."""
    after = store_version(spark, path) if after is None else after
    commit = uuid.uuid4().hex
    write_parts(path, commit, parts)
    return finish_commit(spark, path, commit, run, after, through)
