"""Removal of lines that many documents share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.llm.common import BLANKS, ascii_lower, fresh, same, staged


def line_key(line: Column) -> Column:
    """What two lines must share to be the same: stripped of blanks, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def dedupe_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, out: str = "deduped") -> DataFrame:
    """Drops lines whose key is in at least ``min_docs`` documents, except in the document with the largest id.

    Lines are exploded to (document, position, 128-bit hash of the key); keys under ``min_chars`` code points are left
    out. Documents per hash are counted in two steps, by (hash, document) and then by hash, so a line that a third of
    all documents hold is spread over those documents. The few hashes over the threshold are joined back to the
    positions (a skewed join, which adaptive execution splits), and the texts, shuffled once, are put together again
    from the positions that stay. One row's work is linear in its lines.

    Adds the struct ``out`` (text, n_lines, n_dropped) to all columns of ``docs``; an input column of that name is
    replaced. A null or empty text is one empty line. Documents are told apart by id: rows that repeat an id count
    once, and all of them are treated alike; rows without an id count as one document below every other. A line
    that repeats within a document stays or goes with all its copies. If every line goes, the text is empty. An empty
    table gives an empty table.
    """
    mark, drop, doc, drop_mark = (fresh(docs, x) for x in ("text_hash", "dropped", "drop_id", "drop_hash"))
    marked = docs.withColumn(mark, F.xxhash64("text"))  # tells rows of one id apart
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)

    keys = (marked.select(F.col("doc_id").alias("doc"), F.col(mark).alias("mark"), F.posexplode(lines).alias("pos", "line"))
            .select("doc", "mark", "pos", line_key(F.col("line")).alias("key"))
            .filter(F.length("key") >= min_chars)
            .select("doc", "mark", "pos", F.unhex(F.md5("key")).alias("hash")))
    keys = staged(keys, "line-keys")
    frequent = (keys.groupBy("hash", "doc").agg(F.lit(1).alias("one"))
                .groupBy("hash").agg(F.count(F.lit(1)).alias("docs"), F.max("doc").alias("keeper"))
                .filter(F.col("docs") >= min_docs).select("hash", "keeper"))
    # A written side is a plain exchange or, where its files are small, a broadcast; an aggregate there would keep adaptive
    # execution from splitting the partition of a line that very many documents hold.
    frequent = staged(frequent, "frequent-lines")
    drops = (keys.join(frequent, "hash").filter(~same(F.col("doc"), F.col("keeper")))
             .groupBy(F.col("doc").alias(doc), F.col("mark").alias(drop_mark))
             .agg(F.collect_set("pos").alias(drop)))  # rows that repeat an id and text have the same places

    joined = marked.join(drops, same(F.col("doc_id"), F.col(doc)) & same(F.col(mark), F.col(drop_mark)), "left")
    kept = [c for c in docs.columns if c.lower() != out.lower()]
    whole, split = fresh(docs, "whole"), fresh(docs, "lines")
    # A one-element inline: the lines are made once, and not again for each line that is looked up.
    apart = joined.select(*(f"`{c}`" for c in kept), drop, F.inline(F.array(F.struct(
        F.coalesce("text", F.lit("")).alias(whole), lines.alias(split)))))
    of, n = F.col(split), F.size(split)
    stay = F.array_except(F.sequence(F.lit(0), n - 1), F.col(drop))
    made = (F.when(F.col(drop).isNull(), F.struct(F.col(whole).alias("text"), n.cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped")))
            .otherwise(F.struct(F.array_join(F.transform(stay, lambda i: F.get(of, i)), "\n").alias("text"), n.cast("long").alias("n_lines"),
                                F.size(drop).cast("long").alias("n_dropped"))))
    return apart.select(*(f"`{c}`" for c in kept), made.alias(out))
