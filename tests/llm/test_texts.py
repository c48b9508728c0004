"""Fill-in-middle, exact dedup and collocations against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from logwarden.llm import collocations as C
from logwarden.llm import fill_middle as M
from logwarden.llm.exact_dedup import DigestIndex, dedupe_texts, new_documents
from logwarden.llm.queries import op11_fill_in_middle, op12_exact_dedup, op13_collocations
from pyspark.sql import functions as F

TOKEN = re.compile("[A-Za-z]+|[^A-Za-z]")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# fill in middle

def plain_middle(doc_id, text):
    text = text or ""
    h = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    t = TOKEN.findall(text)
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    p, m, s = "".join(t[:a]), "".join(t[a:b]), "".join(t[b:])
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return doc_id, len(t), "plain", None, None, sha(text), sha(text)
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc_id, len(t), form, len(p), len(m), sha(out), sha(text)


def odd_texts():
    rnd = random.Random(5)
    parts = ["a", "Bc", "é", " ", "x" * 40, "漢字", "\n", "\r\n", "𝒳", "<", "P>", "<S", ">", "0", "\x00", " "]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 80)))) for i in range(300)]
    shared = "".join(rnd.choice(parts) for _ in range(4000))
    rows += [(1000 + i, f"{'z' * i} {shared[i * 7:]}") for i in range(12)]
    rows += [(2000, None), (2001, ""), (2002, "a<M>b"), (2003, "word" * 6000), (2003, "word" * 6000), (None, "no id at all"),
             (2004, "漢" * 30000), (2005, "a1" * 300_000), (2006, "b" * 1_000_000 + " " + "b" * 9000)]
    return rows


def test_fill_in_middle_equals_plain_version(spark, documents, write_tables):
    docs = odd_texts()
    got = op11_fill_in_middle(spark, write_tables(documents=documents(docs)))
    want = [plain_middle(*d) for d in docs]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert op11_fill_in_middle(spark, write_tables(documents=documents([]))).count() == 0


def test_fill_in_middle_keeps_other_columns(documents):
    docs = documents([(1, "some words to cut"), (None, None)]).withColumn("fim", F.lit(3)).withColumn("Doc_id_text", F.lit("x"))
    made = M.fill_in_middle(docs)
    assert sorted(made.columns) == sorted(docs.columns) and made.schema["fim"].dataType == M.MADE
    assert M.fill_in_middle(docs, out="other").select("fim").first()[0] == 3
    every = {r.other.form for r in M.fill_in_middle(docs, plain=100, out="other").collect()}
    assert every == {"plain"}


@pytest.mark.parametrize("bits, longest", [(1, 4), (3, 20), (5, 64)])
def test_cuts_do_not_depend_on_chunks(monkeypatch, bits, longest):
    monkeypatch.setattr(M, "CUT_BITS", bits)
    monkeypatch.setattr(M, "LONGEST", longest)
    memory = {}
    for _, text in odd_texts()[:310]:
        tokens = TOKEN.findall(text)
        cut = M.Chunked(text.encode(), memory)
        assert (cut.n, cut.n_chars) == (len(tokens), len(text)) and (cut.ends or [0])[-1] == len(text.encode())
        for units in range(0, len(tokens) + 1, 1 + len(tokens) // 50):
            head = "".join(tokens[:units])
            assert cut.after(units) == (len(head.encode()), len(head))


def test_shared_passages_are_counted_once():
    passage = " ".join(f"word{i * i % 977}" for i in range(4000)).encode()
    memory, first = {}, M.Chunked(passage, {})
    M.Chunked(b"short opening " + passage, memory)
    before = len(memory)
    M.Chunked(b"a rather different and longer opening: " + passage, memory)
    assert before > 10 and len(memory) - before <= 3 and first.n > 0


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(M, "REMEMBERED", 2000)
    monkeypatch.setattr(M, "GROUP", 3000)
    docs = [(str(i), " ".join(f"t{i}x{j}" for j in range(200))) for i in range(40)]
    batch = pa.record_batch({"doc_id": [d for d, _ in docs], "text": [t for _, t in docs]})
    out = list(M.transform_batches(iter([batch]), "doc_id", ["doc_id"], "fim", "1", 10, 20))
    assert len(out) > 5
    got = [(r["doc_id"], r["fim"]["n"], r["fim"]["form"], sha(r["fim"]["output"])) for b in out for r in b.to_pylist()]
    assert got == [(w[0], w[1], w[2], w[5]) for w in (plain_middle(*d) for d in docs)]


# exact dedup

def plain_dedup(docs):
    key = lambda t: re.sub("[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for doc, text in docs:
        groups[key(text)].append(doc)
    low = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return [(doc, low[key(text)], len(groups[key(text)]), doc == low[key(text)], sha(key(text))) for doc, text in docs]


def copies():
    rnd = random.Random(9)
    docs = [(i, rnd.choice(["a  b", "a b", "a\tb", "a b ", "A b", "é", "", None, " ", "a b", f"own {i}"])) for i in range(400)]
    return docs + [(1000 + i, "hot text") for i in range(900)] + [(5000, "x y " * 100_000), (5001, "x\n\ny " * 100_000), (5002, "x y " * 100_000)]


def test_exact_dedup_equals_plain_version(spark, documents, write_tables):
    docs = copies()
    got = op12_exact_dedup(spark, write_tables(documents=documents(docs).repartition(5)))
    assert sorted(map(tuple, got.collect())) == sorted(plain_dedup(docs))
    assert op12_exact_dedup(spark, write_tables(documents=documents([]))).count() == 0


def test_repeated_and_missing_ids_keep_one_row(spark, documents, tmp_path):
    docs = documents([(7, "same"), (7, "same"), (None, "same"), (None, "lone"), (None, "lone"), (9, None), (8, "")])
    docs = docs.withColumn("dedup", F.lit("mine")).withColumn("Digest", F.lit(1)).withColumn("row", F.lit(2))
    got = dedupe_texts(docs, DigestIndex(spark, f"{tmp_path}/a"), "one", out="found").collect()
    assert all(r.dedup == "mine" and r.Digest == 1 and r.row == 2 for r in got)
    assert Counter((r.text, r.found.keep_id) for r in got if r.found.kept) == {("same", 7): 1, ("lone", None): 1, ("", 8): 1}
    firsts = new_documents(docs, DigestIndex(spark, f"{tmp_path}/b"), "one")
    assert firsts.columns == docs.columns and sorted((r.text or "") for r in firsts.collect()) == ["", "lone", "same"]


def test_index_lasts_and_batches_repeat(spark, documents, tmp_path):
    path = f"{tmp_path}/index"
    run = lambda name, rows: {r.doc_id: (r.dedup.keep_id, r.dedup.kept) for r in dedupe_texts(
        documents(rows), DigestIndex(spark, path, buckets=3), name).collect()}
    first, second = [(5, "a b"), (6, "c")], [(1, "a  b"), (2, "d"), (3, "d")]
    assert run("first", first) == {5: (5, True), 6: (6, True)}
    assert run("second's", second) == {1: (5, False), 2: (2, True), 3: (2, False)}
    assert run("first", first) == {5: (5, True), 6: (6, True)}, "a batch that comes again is not its own duplicate"
    assert run("second's", second) == {1: (5, False), 2: (2, True), 3: (2, False)}
    index = DigestIndex(spark, path, buckets=50)
    assert index.buckets == 3 and spark.table(index.table).count() == 3
    assert [r.text for r in new_documents(documents([(0, "c"), (1, "e")]), index, "third").collect()] == ["e"]


def test_index_is_not_shuffled(spark, documents, tmp_path):
    index = DigestIndex(spark, f"{tmp_path}/index")
    dedupe_texts(documents(copies()[:50]), index, "one").count()
    new = documents([(1, "q")]).select(F.unhex(F.sha2("text", 256)).alias("digest")).distinct()
    plan = new.hint("merge").join(index.known("two"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    below = plan.split("SortMergeJoin")[1].split("FileScan parquet spark_catalog")[0]
    assert "Exchange" not in below.split("Sort [digest")[-1] and "Bucketed: true" in plan


# collocations

def plain_collocations(docs, longest=3, least=10, percent=50, limit=2000):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        held = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in held.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i:i + k]] = max(inside[p[i:i + k]], a)
        rows = []
        for p, a in held.items():
            if 100 * inside[p] >= percent * a:
                continue
            score, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:limit], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def talk():
    rnd = random.Random(11)
    words = [f"w{min(int(rnd.paretovariate(0.7)), 300)}" for _ in range(6000)]
    docs = [(i, "".join(rnd.choice([" ", " ", " ", "\t", ". ", "\n"]) + w.upper() * (rnd.random() < 0.1) + w for w in words[i * 20:i * 20 + 20]),
             rnd.choice(["en", "de", None, "und"]), "s") for i in range(300)]
    docs += [(i, "New  York City, new york\tstate; é à ô é à ô! \x1c odd\x1cword " * 3, "fr", "s") for i in range(12)]
    return docs + [(1, "ha " * 500, "de", "s"), (1, None, "en", "s"), (2, "", None, "s"), (3, " ,.", "it", "s"), (4, "x" * 3_000_000 + " new york", "fr", "s")]


def test_collocations_equal_plain_version(spark, documents, write_tables):
    docs = talk()
    want = plain_collocations(docs)
    got = op13_collocations(spark, write_tables(documents=documents(docs).repartition(3)))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 60
    assert op13_collocations(spark, write_tables(documents=documents([]))).count() == 0


@pytest.mark.parametrize("longest, least, percent, limit", [(2, 5, 50, 7), (4, 6, 80, 2000), (5, 12, 100, 3)])
def test_collocations_of_other_lengths(documents, longest, least, percent, limit):
    docs = talk()[:320]
    got = C.collocations(documents(docs).withColumn("w1", F.lit(1)).withColumn("f", F.lit(2)), longest, least, percent, limit)
    assert sorted(map(tuple, got.collect())) == plain_collocations(docs, longest, least, percent, limit)


def test_scores_are_exact_past_64_bits(spark):
    a, left, right = 9_876_543_210_123, 9_999_999_999_999, 9_876_543_210_125
    row = spark.createDataFrame([(a, [left, a], [right, a])], "f long, heads array<long>, tails array<long>")
    assert row.select(C.best_cut(2).alias("b")).first().b.score == 1_000_000 * a * a // (left * right)


def test_addresses_that_meet_are_salted(spark, monkeypatch):
    monkeypatch.setattr(C, "ADDRESS", 1 << 10)
    words = spark.createDataFrame([("en", f"w{i}", 20) for i in range(24)] + [("en", "rare", 1)], "lang string, word string, f long")
    salt = C.clear_salt(words, 10)
    at = [r[0] for r in words.select(C.address(F.col("word"), salt)).collect()]
    assert len(set(at)) == len(at)


@pytest.mark.parametrize("head, side, dense, held", [(16, 4, 2, 50), (64, 8, 8, 1000), (16, 16, 1, 10)])
def test_tiles_and_coordinates_count_alike(monkeypatch, head, side, dense, held):
    for name, value in {"HEAD": head, "SIDE": side, "DENSE": dense, "HELD": held, "CHUNK": 97}.items():
        monkeypatch.setattr(C, name, value)
    docs = [(t or "", lang) for _, t, lang, *_ in talk()[:312] if lang]
    words = Counter((lang, w) for t, lang in docs for at, own in C.word_chunks(t.encode()) for w in map(own.__getitem__, at) if w != C.EDGE)
    by_lang = defaultdict(list)
    for (lang, w), f in words.items():
        by_lang[lang].append((-f, w))
    ranks = {lang: {w: r for r, (_, w) in enumerate(sorted(own)[:head])} for lang, own in by_lang.items()}
    everything = np.full(C.BITS // 8, 255, np.uint8).tobytes()
    batch = pa.record_batch({"lang": [x for _, x in docs], "text": [t for t, _ in docs]})
    names = {lang: C.Numbers(ranks[lang], b"", everything, [10_000]) for lang in ranks}
    word_of = {(lang, names[lang][w]): w for lang, w in words}
    pairs = sorted({(lang, i, j) for lang in ranks for i in range(3) for j in range(5)})
    heads = {}
    for lang in ranks:
        own = np.array([p[1:] for p in pairs if p[0] == lang], np.int64)
        code = own[:, 0] * head + own[:, 1]
        heads[lang] = (np.sort(code), np.argsort(code), own)
    for length, levels in ((2, []), (3, [(heads, everything)])):
        got, want = Counter(), Counter()
        for out in C.count_phrase_batches(iter([batch, batch]), SimpleNamespace(value=(b"", ranks, everything, levels)), length):
            for r in out.to_pylist():
                got[(r["lang"], *(word_of[r["lang"], r[f"w{i + 1}"]] for i in range(length)))] += r["f"]
        for t, lang in docs:
            for piece in re.split(rb"[.,;:!?\x0a-\x0d]", t.encode().translate(C.PIECE_BYTES)):
                ws = piece.split()
                want.update((lang, *ws[i:i + length]) for i in range(len(ws) - length + 1))
        assert got == Counter({k: 2 * v for k, v in want.items()})
