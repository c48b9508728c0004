"""Exact duplicates of texts, against a persistent index of digests."""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.llm.common import fresh, staged

#: A text that at least one in HEAVY rows has is joined by broadcast: there are at most HEAVY of those.
HEAVY = 1000


def normal_text(text: Column) -> Column:
    """What equal texts share: every run of blanks is one space; a null text is an empty one."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


class DigestIndex:
    """Digests of all texts seen, with the id of the row that stays: a table on shared storage, bucketed and sorted by
    digest, with a partition for each batch.

    Opening a folder that holds an index goes on with it, whatever session wrote it. ``buckets`` counts only when it is
    made; the default is the session's number of shuffle partitions, so that an aggregation by digest, the join and the
    files agree and the index itself is never shuffled. Adding a batch again replaces exactly that batch. One writer at
    a time: two that add the same text at once would both keep it.
    """

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint", buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.table = f"digests_{hashlib.md5(self.path.encode()).hexdigest()}"
        made = self._made()
        self.buckets, id_type = made or (buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), id_type)
        spark.sql(f"DROP TABLE IF EXISTS {self.table}")  # an outside table: its files stay
        spark.sql(f"CREATE TABLE {self.table} (digest BINARY, keep_id {id_type}, batch STRING) USING parquet PARTITIONED BY (batch) "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/digests'")
        if made is None:
            self.append(spark.createDataFrame([], f"digest binary, keep_id {id_type}"), "start")
            spark.range(1).select(F.lit(self.buckets).alias("buckets"), F.lit(id_type).alias("id_type")).write.mode("overwrite").parquet(f"{self.path}/made")
        else:
            spark.sql(f"MSCK REPAIR TABLE {self.table}")

    def _made(self) -> tuple[int, str] | None:
        try:
            return tuple(self.spark.read.schema("buckets int, id_type string").parquet(f"{self.path}/made").first())
        except AnalysisException as error:
            if (error.getCondition() or "").startswith("PATH_NOT_FOUND"):
                return None
            raise

    def known(self, batch: str) -> DataFrame:
        """(digest, keep_id) of every batch but this one."""
        return self.spark.table(self.table).filter(F.col("batch") != batch).select("digest", "keep_id")

    def append(self, rows: DataFrame, batch: str) -> None:
        """Files (digest, keep_id) as this batch, in place of what it held."""
        view = f"{self.table}_new"
        rows.select("digest", "keep_id").createOrReplaceTempView(view)
        name = batch.replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.table} PARTITION (batch = '{name}') SELECT digest, keep_id FROM {view}")
        self.spark.catalog.dropTempView(view)


def _numbered(docs: DataFrame, cols: list[str], digest: str, row: str) -> DataFrame:
    """The columns ``cols`` with digest and row number, written: a number then means the same row for every reader."""
    made = docs.withColumns({digest: F.unhex(F.sha2(normal_text(F.col("text")), 256)), row: F.monotonically_increasing_id()})
    return staged(made.select(*(f"`{c}`" for c in cols), digest, row), "digests")


def _groups(rows: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """(digest, size, keep_id, keep_row) for each digest of ``rows`` (doc_id, digest, row); keep_row is null where an earlier batch has it.

    New digests are what a sort-merge anti-join with the index leaves; they are added to it.
    """
    who = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id"), F.col("row"))
    groups = staged(rows.groupBy("digest").agg(F.min(who).alias("best"), F.count(F.lit(1)).alias("size")), "digest-groups")
    known = index.known(batch)
    new = groups.hint("merge").join(known, "digest", "left_anti").select("digest", "size", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"))
    old = groups.hint("merge").join(known, "digest").select("digest", "size", "keep_id", F.lit(None).cast("bigint").alias("keep_row"))
    found = staged(new.unionByName(old), "digest-found")
    index.append(found.filter("keep_row IS NOT NULL"), batch)
    return found


def dedupe_texts(docs: DataFrame, index: DigestIndex, batch: str, out: str = "dedup", keep: list[str] | None = None) -> DataFrame:
    """Adds the struct ``out`` (keep_id, group_size, kept, digest) to each row and the new texts to the index.

    Texts are equal when their SHA-256 agrees after every run of blanks has become one space; a null text is an empty
    one. The first row of each text stays: where an earlier batch has the text, none of this batch (keep_id is that
    batch's); else the one with the smallest doc_id, one of them if ids repeat, one without an id only if none has one
    (keep_id is null then). group_size counts the rows of this batch. An empty table gives an empty table and an empty
    batch.

    Rows are counted by digest with partial aggregation; only digests meet the index. Digests that one in HEAVY rows or
    more share are joined back by broadcast, which has at most HEAVY rows; no other holds more than that share of a join.
    Adding the same batch again, after a lost job or on purpose, gives the same result.

    ``keep`` names the columns to carry on (all by default, which writes the texts once); one named ``out`` is replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != out.lower()]
    digest, row = fresh(docs, "digest"), fresh(docs, "row")
    rows = _numbered(docs, list(dict.fromkeys([*keep, "doc_id"])), digest, row)
    found = _groups(rows.select("doc_id", F.col(digest).alias("digest"), F.col(row).alias("row")), index, batch)
    of = fresh(docs, "of_digest")
    names = {c: fresh(docs, f"found_{c}") for c in ("size", "keep_id", "keep_row")}
    found = found.select(F.col("digest").alias(of), *(F.col(c).alias(n) for c, n in names.items()))
    least = (rows.count() + HEAVY - 1) // HEAVY
    heavy, light = (found.filter(F.col(names["size"]) >= least), found.filter(F.col(names["size"]) < least))
    same = F.col(digest) == F.col(of)
    joined = (rows.join(F.broadcast(heavy), same)
              .unionByName(rows.join(F.broadcast(heavy.select(of)), same, "left_anti").join(light, same)))
    made = F.struct(F.col(names["keep_id"]).alias("keep_id"), F.col(names["size"]).alias("group_size"),
                    F.coalesce(F.col(row) == F.col(names["keep_row"]), F.lit(False)).alias("kept"), F.col(digest).alias("digest"))
    return joined.select(*(f"`{c}`" for c in keep), made.alias(out))


def new_documents(docs: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """The first row of each text that the index did not hold, with the columns of ``docs``. The texts join the index."""
    digest, row = fresh(docs, "digest"), fresh(docs, "row")
    rows = _numbered(docs, docs.columns, digest, row)
    found = _groups(rows.select("doc_id", F.col(digest).alias("digest"), F.col(row).alias("row")), index, batch)
    firsts = found.filter("keep_row IS NOT NULL").select(F.col("keep_row").alias(row))
    return rows.join(firsts, row, "left_semi").select(*(f"`{c}`" for c in docs.columns))
