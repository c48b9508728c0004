"""Contiguous shards of nearly equal byte size from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logwarden.llm.common import staged

#: Bytes that a row takes beside its text.
ROW_BYTES = 8


def shard_rows(docs: DataFrame, shards: int = 24, blocks: int | None = None) -> DataFrame:
    """Deals documents in the order of ``doc_id`` to ``shards`` shards whose bytes are nearly equal.

    Rows are range-partitioned into blocks by id (``blocks``, else the session's shuffle partitions). A block's total
    is one row; the running sum of those totals is where each block starts, and a running sum inside the block gives
    each row its place in the whole. A row goes to the shard in whose equal slice of all bytes its middle lies, so a
    shard misses its target by less than the largest row.

    Only ids, sizes and checksums are shuffled, never texts. Ids that many rows share are split by the row's place in
    the scan. The blocks are written once, because a second range partitioning could cut elsewhere.

    Null texts have no bytes and the checksum of the empty text; null ids come first; rows with one id follow each
    other in scan order; an empty table gives no rows; other columns are ignored.

    Returns doc_id, size, text_crc32, shard, slot (the place within the shard), start (bytes before the row).
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"), F.monotonically_increasing_id().alias("seen"))
    blocks = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = staged(rows.repartitionByRange(blocks, "doc_id", "seen").withColumn("block", F.spark_partition_id()),
                    "shard-blocks")

    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (ranged.groupBy("block").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
              .select("block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("block_start"),
                      F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("block_row"),
                      F.sum("bytes").over(Window.partitionBy()).alias("total")))  # a row for each block at most

    inside = Window.partitionBy("block").orderBy("doc_id", "seen")
    placed = (ranged.withColumn("own", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("nth", F.row_number().over(inside))
              .join(F.broadcast(starts), "block")
              .withColumn("start", F.col("block_start") + F.col("own") - F.col("size"))
              .withColumn("row", F.col("block_row") + F.col("nth") - 1)
              .withColumn("shard", F.expr(f"int(((2 * start + size) * {int(shards)}) div (2 * total))")))
    # Shards are contiguous, so their sizes in rows say where each starts.
    firsts = (placed.groupBy("shard").agg(F.min("row").alias("first")))
    return (placed.join(F.broadcast(firsts), "shard")
            .select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot"), "start"))
