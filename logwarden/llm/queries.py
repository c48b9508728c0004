"""The operators over the given tables, with production parameters, and their DuckDB equivalents."""

from __future__ import annotations

from functools import lru_cache

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.llm import bpe
from logwarden.llm.collocations import collocations
from logwarden.llm.common import staged, table, unique_folder
from logwarden.llm.decontaminate import find_benchmark
from logwarden.llm.exact_dedup import DigestIndex, dedupe_texts
from logwarden.llm.fill_middle import fill_in_middle, restored
from logwarden.llm.learning import remainder
from logwarden.llm.licenses import scan_licences
from logwarden.llm.line_dedup import dedupe_lines
from logwarden.llm.pii import scan_personal
from logwarden.llm.quality_model import pool_documents, score_quality, train_quality, word_vectors
from logwarden.llm.quality_rules import judge
from logwarden.llm.sharding import shard_rows
from logwarden.llm.simhash import near_duplicates
from logwarden.llm.toxicity import score_toxicity, train_toxicity


@lru_cache(maxsize=4)
def byte_bpe(path: str | None = None) -> str:
    """The tokenizer of a rank file (50k byte-level BPE by default)."""
    return bpe.tokenizer_from_ranks(bpe.read_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    hits = F.aggregate("found.ranges", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["first"])
    return found.select(
        "doc_id", "found.n_words", hits.alias("n_hit"), F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"), (hits > 0).alias("contaminated"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(table(spark, sf_dir, "documents"), byte_bpe(), keep=["doc_id"])
    return bpe.decode(encoded, byte_bpe()).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "deduped.n_lines", "deduped.n_dropped", F.sha2("deduped.text", 256).alias("kept_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), keep=["doc_id"]).select(
        "doc_id", F.lower(F.lpad(F.hex("group.fingerprint"), 16, "0")).alias("fingerprint"), "group.component_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model, keep=["doc_id"]).select(
        "doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"), 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_personal(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pooled = staged(pool_documents(docs, word_vectors(docs), keep=["doc_id"]), "pooled")
    model = train_quality(pooled, table(spark, sf_dir, "labels"))
    return score_quality(pooled, model, keep=["doc_id"]).select(
        "doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.select("doc_id", *(f"quality.counts.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
                         "quality.base_failed", "quality.kept")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return made.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", F.sha2("fim.output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("fim.output"), F.col("fim.form")), 256).alias("restored_sha256"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = DigestIndex(spark, unique_folder(spark, "digest-index"))
    return dedupe_texts(table(spark, sf_dir, "documents"), index, "documents", keep=["doc_id"]).select(
        "doc_id", "dedup.keep_id", "dedup.group_size", "dedup.kept", F.lower(F.hex("dedup.digest")).alias("text_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_decontamination, op2_byte_bpe, op3_line_dedup, op4_simhash, op5_toxicity, op6_sharding, op7_licenses, op8_personal_data, op9_quality_classifier,
    op10_quality_rules, op11_fill_in_middle, op12_exact_dedup, op13_collocations)}

ORACLE = {
    "op1_decontamination": r"""
        WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                     'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words
              FROM benchmark),
        win AS (SELECT DISTINCT item, least(10, len(words)) AS n, array_to_string(words[i:i + 9], ' ') AS win
                FROM (SELECT *, unnest(generate_series(1, greatest(1, len(words) - 9))) AS i FROM b WHERE len(words) > 0)),
        lens AS (SELECT DISTINCT n FROM win),
        dw AS (SELECT doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') AS win
               FROM (SELECT doc_id, words, n, unnest(generate_series(1, len(words) - n + 1)) AS i FROM w, lens WHERE len(words) >= n)),
        hit AS (SELECT doc_id, item, dw.n, i FROM dw JOIN win USING (n, win)),
        pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit
                FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM hit)) GROUP BY doc_id),
        who AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM w LEFT JOIN pos USING (doc_id) LEFT JOIN who USING (doc_id)""",
    "op3_line_dedup": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                     generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
        k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        d AS (SELECT k.*, f.key IS NOT NULL AND doc_id <> keeper AS dropped FROM k LEFT JOIN f USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
        FROM d GROUP BY doc_id""",
    "op11_fill_in_middle": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        k AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS tok, CAST('0x' || h[1:8] AS BIGINT) AS h1,
                CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
        c AS (SELECT *, len(tok) AS n, least(h1 % (len(tok) + 1), h2 % (len(tok) + 1)) AS lo, greatest(h1 % (len(tok) + 1), h2 % (len(tok) + 1)) AS hi,
                CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                     WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
        p AS (SELECT *, array_to_string(tok[1:lo], '') AS pre, array_to_string(tok[lo + 1:hi], '') AS mid, array_to_string(tok[hi + 1:n], '') AS suf FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                      ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
               sha256(CASE form WHEN 'plain' THEN text ELSE pre || mid || suf END) AS restored_sha256
        FROM p""",
    "op12_exact_dedup": r"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)""",
    "op13_collocations": r"""
        WITH s AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                     'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM s),
        one AS (SELECT lang, x, count(*) AS f FROM (SELECT lang, unnest(words) AS x FROM w) GROUP BY ALL),
        two AS (SELECT lang, x, y, count(*) AS f FROM (SELECT lang, words[i] AS x, words[i + 1] AS y
                FROM (SELECT lang, words, unnest(generate_series(1, len(words) - 1)) AS i FROM w)) GROUP BY ALL HAVING count(*) >= 10),
        three AS (SELECT lang, x, y, z, count(*) AS f FROM (SELECT lang, words[i] AS x, words[i + 1] AS y, words[i + 2] AS z
                FROM (SELECT lang, words, unnest(generate_series(1, len(words) - 2)) AS i FROM w)) GROUP BY ALL HAVING count(*) >= 10),
        inner_ AS (SELECT lang, x, y, max(f) AS around FROM (SELECT lang, x, y, f FROM three UNION ALL SELECT lang, y, z, f FROM three) GROUP BY ALL),
        cuts AS (
          SELECT two.lang, two.x || ' ' || two.y AS phrase, two.f AS a, p.f AS l, q.f AS r, 1 AS k
          FROM two JOIN one p ON p.lang = two.lang AND p.x = two.x JOIN one q ON q.lang = two.lang AND q.x = two.y
          LEFT JOIN inner_ i ON i.lang = two.lang AND i.x = two.x AND i.y = two.y
          WHERE i.around IS NULL OR 100 * i.around < 50 * two.f
          UNION ALL
          SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.f, p.f, q.f, 1
          FROM three t JOIN one p ON p.lang = t.lang AND p.x = t.x JOIN two q ON q.lang = t.lang AND q.x = t.y AND q.y = t.z
          UNION ALL
          SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.f, p.f, q.f, 2
          FROM three t JOIN two p ON p.lang = t.lang AND p.x = t.x AND p.y = t.y JOIN one q ON q.lang = t.lang AND q.x = t.z),
        scored AS (SELECT *, CAST(1000000::HUGEINT * a * a // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts),
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM one GROUP BY lang)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM best JOIN total USING (lang)
        QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000""",
}
