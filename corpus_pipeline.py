"""From raw documents to tokens: each stage applies one training-data operator to what the stage before has kept."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from logwarden.llm import bpe  # noqa: E402
from logwarden.llm.common import fresh, staged, table  # noqa: E402
from logwarden.llm.decontaminate import decontaminate  # noqa: E402
from logwarden.llm.line_dedup import dedupe_lines  # noqa: E402
from logwarden.llm.quality_rules import good_documents  # noqa: E402
from logwarden.llm.queries import byte_bpe  # noqa: E402
from logwarden.llm.simhash import first_of_each  # noqa: E402


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return good_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that others share; ``n_chars``, where there is one, is that of the new text."""
    out = fresh(docs, "deduped")
    rows = dedupe_lines(docs, out=out)
    new = {"text": F.col(out)["text"]}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(F.col(out)["text"]).cast(docs.schema["n_chars"].dataType)
    return rows.withColumns(new).select(*(f"`{c}`" for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return first_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), out=fresh(docs, "found"))


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's tokens, and whether decoding them gives back its text."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.sha2(text, 256).alias("digest"))
    decoded = bpe.decode(bpe.encode(rows, byte_bpe(), keep=["doc_id", "digest"]), byte_bpe())
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                          (F.sha2("decoded", 256) == F.col("digest")).alias("round_trip"))


#: In order. Each is (spark, docs, sf_dir) -> DataFrame; all but the last return the columns of docs. Null and empty texts
#: fail the quality rules; an empty table passes through every stage.
STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("benchmark_decontamination", benchmark_decontamination), ("byte_level_bpe", byte_level_bpe)]

#: SQL expresses neither robust estimates nor fingerprints nor tokens; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``, each result but the last written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
