"""Personal data, and the terms around it that give it away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.llm.common import fresh, same, staged
from logwarden.llm.places import hits, placed

# The kinds of personal data in their order, with what every match holds, and patterns.
# The quantifiers are possessive where giving back could not help, and a match starts where its run of characters does
# or where the last match ended, so that long runs take linear time.
KINDS = (
    ("email", "[@]", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", "[0-9]", r"[0-9](?:[ -]?+[0-9])++"),
    ("phone", "[+][0-9]", r"\+[0-9][ ().0-9-]+[0-9]"),
)
ORDER = [k for k, _, _ in KINDS] + ["hidden", "hint"]
#: Code points on either side of personal data; the plain version of the tests plants its terms within them. Terms are
#: looked for in whole texts.
REACH = 100
#: A term: a word of three letters or more that is no part of an address or number.
BEFORE, AFTER = r"(?<![\p{L}\p{N}@._%+-])", r"(?![\p{L}\p{N}@_%+-]|\.[A-Za-z0-9])"
TERM = BEFORE + r"\p{L}{3,}+" + AFTER
#: Of the information in an entity, the share that a term may reveal: above the first it is generalised, above the
#: second removed.
GENERALISE, REMOVE = 0.85, 0.95


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def valid(kind: Column, match: Column) -> Column:
    """Whether a match is personal data: parts of an address at most 255, lengths, and the check digit of a card."""
    small = F.forall(F.split(match, r"\."), lambda p: F.regexp_like(p, F.lit("^0*([0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$")))
    number = digits(match)
    return (F.when(kind == "email", True).when(kind == "ip", small)
            .when(kind == "card", F.length(number).between(13, 19) & F.call_function("luhn_check", number))
            .otherwise(F.length(number).between(9, 15)))


def entity(kind: Column, match: Column) -> Column:
    """What makes two matches the same entity: letters in lower case, the digits of numbers."""
    return F.concat_ws(":", kind, F.when(kind.isin("email", "ip"), F.lower(match)).otherwise(digits(match)))


def personal_data(docs: DataFrame) -> DataFrame:
    """A row for each match that is personal data: doc_id, mark (hash of the text), kind, start, end, match.

    Offsets are code points. Only matches are shuffled. Repeated rows of an id and text give one set of rows; a null text
    has none.
    """
    text = F.col("text")
    each = F.array(*(F.struct(F.lit(kind).alias("kind"), F.when(F.regexp_like(text, F.lit(sign)), hits(text, F.lit(pattern), F.length, match=lambda b, m, a: m)).alias("hits"))
                     for kind, sign, pattern in KINDS))
    rows = (docs.select("doc_id", F.xxhash64("text").alias("mark"), F.explode(F.filter(each, lambda e: e["hits"].isNotNull())).alias("e"))
            .select("doc_id", "mark", "e.kind", "e.hits"))
    return placed(rows, ["doc_id", "mark", "kind"]).filter(valid(F.col("kind"), F.col("match")))


def of_document(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Joins by doc_id and mark, of which the left ones stay."""
    renamed = right.withColumnsRenamed({"doc_id": "of_id", "mark": "of_mark"})
    return left.join(renamed, same(left["doc_id"], renamed["of_id"]) & same(left["mark"], renamed["of_mark"]), how).drop("of_id", "of_mark")


def forms(rows: DataFrame) -> DataFrame:
    """The different words of each whole text that are terms, in their spelling (``form``); the term is it in lower case."""
    found = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)))).alias("form")
    return rows.select(*(c for c in rows.columns if c != "text"), found).withColumn("term", F.lower("form"))


def in_classes(rows: DataFrame, key: str, out: str) -> DataFrame:
    """Distinct (doc_id, mark, ``key``, ...) rows with the class ``out`` of the key. Keys that stand in exactly the same
    documents share a class (by two 64-bit sums of document hashes, and their number), so what is counted for a class
    holds for each of its keys, and many keys that copies of a text share are one."""
    digest = lambda salt: F.bit_xor(F.xxhash64("doc_id", "mark", F.lit(salt)))
    classes = rows.groupBy(F.col(key).alias("of_key")).agg(F.xxhash64(digest(1), digest(2), F.count(F.lit(1))).alias(out))
    return rows.join(classes, rows[key] == classes["of_key"]).drop("of_key")


def term_counts(docs: DataFrame) -> DataFrame:
    """(of_term, with_term): the documents that hold a term, over all documents and whole texts, for terms of two or more.

    A row that repeats an id and text counts for its part of the document. Counts are combined before the shuffle.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    repeats = staged(rows.groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("times")).filter("times > 1"), "repeats")
    # Two spellings in one text are one term.
    once = of_document(rows, repeats, "left").select(
        "times", F.explode(F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all("text", F.lit(TERM), F.lit(0))), F.lower))).alias("term"))
    return (once.groupBy(F.xxhash64("term").alias("of_term")).agg(F.round(F.sum(1 / F.coalesce("times", F.lit(1)))).cast("long").alias("with_term"))
            .filter("with_term > 1"))


def disclosure(docs: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Which terms disclose which entities: (who, what, share) of GENERALISE or more, (doc_id, mark, who) and (term, what).

    ``who`` and ``what`` are classes of entities and terms that stand in the same documents. With documents as events,
    the share of an entity's information that a term reveals is the pointwise mutual information of both over the
    information of the entity: 1 if the term is found with the entity only, near 0 if it is found anywhere. Both are
    counted over whole documents. A pair must be seen in two documents, since in a single one every word peculiar to it
    would have share 1; so an entity that stands in one document has no disclosing terms.

    No pair is counted that cannot reach GENERALISE: a term and an entity are together in no more documents than either
    stands in, which bounds the share from both counts. So frequent words go before they are paired with entities.
    """
    total = F.lit(docs.select("doc_id", F.xxhash64("text")).distinct().count()).cast("double")
    held = found.select("doc_id", "mark", entity(F.col("kind"), F.col("match")).alias("entity")).distinct()
    often = held.groupBy(F.col("entity").alias("of_entity")).agg(F.count(F.lit(1)).alias("with_entity")).filter("with_entity > 1")
    held = held.join(often, F.col("entity") == F.col("of_entity")).drop("of_entity")
    held = staged(in_classes(held, "entity", "who").select("doc_id", "mark", "who", "with_entity").distinct(), "entities")
    information = F.log2(total / F.col("with_entity"))
    within = F.log2(total / F.greatest("with_term", "with_entity")) >= GENERALISE * information - 1e-9

    holders = held.groupBy("doc_id", "mark").agg(F.max("with_entity").alias("with_entity"))  # the bound grows with it
    texts = of_document(docs.select("doc_id", F.xxhash64("text").alias("mark"), "text"), holders)
    words = forms(texts).select("doc_id", "mark", "with_entity", "term").distinct().withColumn("hash", F.xxhash64("term"))
    rare = (words.join(term_counts(docs), F.col("hash") == F.col("of_term")).filter(within)
            .select("doc_id", "mark", "term", "with_term"))
    rare = staged(in_classes(staged(rare, "terms"), "term", "what").withColumn("what", F.xxhash64("what", "with_term")), "terms")

    once = rare.select("doc_id", "mark", "what", "with_term").distinct()
    pairs = (of_document(once, held).filter(within).groupBy("who", "what")
             .agg(F.count(F.lit(1)).alias("both"), F.first("with_term").alias("with_term"), F.first("with_entity").alias("with_entity"))
             .filter("both >= 2"))
    mutual = F.log2(F.col("both") * total / (F.col("with_term") * F.col("with_entity")))
    shares = pairs.select("who", "what", F.when(information > 0, mutual / information).otherwise(F.lit(0.0)).alias("share"))
    return staged(shares.filter(F.col("share") >= GENERALISE), "shares"), held.select("doc_id", "mark", "who"), rare.select("term", "what").distinct()


def disclosing_spans(docs: DataFrame, found: DataFrame, everywhere: bool) -> DataFrame:
    """All places of disclosing terms: doc_id, mark, kind, start, end."""
    shares, held, terms = disclosure(docs, found)
    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    kind = F.when(F.col("share") >= REMOVE, "hidden").otherwise("hint").alias("kind")
    if everywhere:
        strongest = shares.groupBy("what").agg(F.max("share").alias("share"))
        wanted = staged(terms.join(strongest, "what").select(F.col("term").alias("of_term"), kind), "disclosing")
        spelt = forms(rows)
        spelt = spelt.join(wanted, F.col("term") == F.col("of_term"))
    else:
        strongest = held.join(shares, "who").groupBy("doc_id", "mark", "what").agg(F.max("share").alias("share"))
        wanted = staged(strongest.join(terms, "what").select("doc_id", "mark", F.col("term").alias("of_term"), kind), "disclosing")
        spelt = forms(of_document(rows, wanted.select("doc_id", "mark").distinct()))
        spelt = of_document(spelt, wanted).filter(F.col("term") == F.col("of_term"))
    # Forms are letters only, so they are patterns of themselves.
    listed = (spelt.groupBy("doc_id", "mark", "kind").agg(F.collect_set("form").alias("forms"))
              .select("doc_id", "mark", "kind", F.concat(F.lit(BEFORE + "(?:"), F.array_join("forms", "|"), F.lit(")" + AFTER)).alias("pattern")))
    spots = of_document(rows, staged(listed, "listed")).select("doc_id", "mark", "kind", hits(F.col("text"), F.col("pattern"), F.length).alias("hits"))
    return placed(spots, ["doc_id", "mark", "kind"]).select("doc_id", "mark", "kind", "start", "end")


def personal_spans(docs: DataFrame, everywhere: bool = False) -> DataFrame:
    """A row for each span to protect: doc_id, mark, kind, start, end.

    Besides personal data (KINDS) these are terms that disclose it: ``hidden`` ones reveal REMOVE of its information or
    more and are to be removed, ``hint`` ones GENERALISE or more and are to be generalised. Every place of such a term in
    a document that holds the entity is a span, however far from the entity; with ``everywhere`` also its places in
    documents that do not. A term that discloses several entities takes the strongest.
    """
    found = staged(personal_data(docs), "personal")
    return found.select("doc_id", "mark", "kind", "start", "end").unionByName(disclosing_spans(docs, found, everywhere))


def scan_personal(docs: DataFrame) -> DataFrame:
    """A row for each document: counts by kind, and its spans as ``kind:start:end`` in the order of kinds, then start.

    Returns doc_id, n_email, n_ip, n_card, n_phone, base_spans, spans. Rows that repeat an id and text are all there;
    null texts have no spans; other columns are ignored; an empty table gives no rows. Disclosing terms are listed in
    all documents, also in those without the entity.
    """
    rank = F.array_position(F.array(*map(F.lit, ORDER)), F.col("kind"))
    spans = staged(personal_spans(docs, everywhere=True), "spans")
    listed = (spans.groupBy(F.col("doc_id").alias("of_id"), F.col("mark").alias("of_mark"))
              .agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "start", "end", "kind"))).alias("all")))
    text = lambda some: F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("all", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"))
    joined = (rows.join(listed, same(F.col("doc_id"), F.col("of_id")) & same(F.col("mark"), F.col("of_mark")), "left")
              .withColumn("all", F.coalesce("all", F.array().cast("array<struct<rank:bigint,start:bigint,end:bigint,kind:string>>"))))
    base = F.filter("all", lambda s: s["rank"] <= len(KINDS))
    return joined.select("doc_id", *(count(k) for k, _, _ in KINDS), text(base).alias("base_spans"), text(F.col("all")).alias("spans"))


def sanitise(docs: DataFrame, out: str = "sanitised") -> DataFrame:
    """Adds ``out``: the text with personal data and, in all documents, disclosing terms replaced.

    Personal data becomes its kind in brackets, a ``hint`` its initial and an ellipsis, a ``hidden`` term an empty pair of
    brackets. Where spans overlap, the first one and, at one start, the longest is replaced, and those that begin
    inside it go with it. Only documents with spans are joined by their text; an input column named ``out`` is replaced.
    """
    mark, of_id, of_mark, of_spans = (fresh(docs, x) for x in ("mark", "of_id", "of_mark", "of_spans"))
    rank = F.array_position(F.array(*map(F.lit, ORDER)), F.col("kind"))
    spans = (personal_spans(docs, everywhere=True).groupBy(F.col("doc_id").alias(of_id), F.col("mark").alias(of_mark))
             .agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("last"), rank.alias("rank"), "kind"))).alias(of_spans)))
    text = F.col("text")
    none = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))

    def replaced(so_far: Column, s: Column) -> Column:
        end = -s["last"]
        shown = (F.when(s["kind"] == "hidden", F.lit("[]"))
                 .when(s["kind"] == "hint", F.concat(F.substring(text, s["start"].cast("int") + 1, F.lit(1)), F.lit("...")))
                 .otherwise(F.concat(F.lit("["), s["kind"], F.lit("]"))))
        kept = F.substring(text, so_far["at"].cast("int") + 1, (s["start"] - so_far["at"]).cast("int"))
        return (F.when(s["start"] < so_far["at"], F.struct(so_far["done"].alias("done"), F.greatest(so_far["at"], end).alias("at")))
                .otherwise(F.struct(F.concat(so_far["done"], kept, shown).alias("done"), end.alias("at"))))

    made = F.aggregate(of_spans, none, replaced, lambda r: F.concat(r["done"], F.substring(text, r["at"].cast("int") + 1, F.length(text))))
    joined = docs.withColumn(mark, F.xxhash64("text")).join(spans, same(F.col("doc_id"), F.col(of_id)) & same(F.col(mark), F.col(of_mark)), "left")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != out.lower()]
    return joined.select(*kept, F.when(F.col(of_spans).isNull(), text).otherwise(made).alias(out))
