"""Quality rules, the two trained operators and the pipeline."""

import random
import zlib

import numpy as np
import pytest
from logwarden.llm import quality_rules as Q
from logwarden.llm.learning import best_cut, fit_logistic, sigmoid
from logwarden.llm.queries import op5_toxicity, op9_quality_classifier, op10_quality_rules
from logwarden.llm.text_stats import COUNTS, text_counts
from logwarden.llm.toxicity import fit, score_toxicity
from pyspark.sql import functions as F

SYLLABLES = ("the", "ing", "er", "on", "an", "re", "ha", "ed", "st", "nd")


def prose(rnd, n):
    made = ["".join(rnd.choice(SYLLABLES) for _ in range(rnd.randrange(1, 5))) + rnd.choice(["", "", "", ",", "."]) for _ in range(n)]
    return "\n".join(" ".join(made[i:i + 15]).capitalize() for i in range(0, n, 15))


def junk(rnd, n):
    return " ".join(w + rnd.choice(["###", "$$$", "|"]) for w in prose(rnd, n).split())


def corpus(seed=0, n=260):
    rnd = random.Random(seed)
    return [(i, junk(rnd, 60) if i % 9 == 0 else prose(rnd, rnd.randrange(25, 200)), "en" if i % 3 else "de", f"s{i % 2}") for i in range(n)]


def plain_counts(text):
    text, blanks, n_repeat = text or "", " \t\n\x0b\f\r", 0
    words, word = [], ""
    for c in text + " ":
        if c in blanks:
            words += [word] if word else []
            word = ""
        else:
            word += c
    runs = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    hit = {j for i, r in enumerate(runs) if runs.count(r) > 1 for j in range(i, i + 8)}
    n_repeat = len(hit)
    lines = [x for x in text.split("\n") if x.strip(blanks)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), n_repeat


TEXTS = [None, "", " \n\t", "a", "a b c d e f g h " * 3, "x y z w x y z w x y z w x", "#*$ |<> &%", "l1 a\nl1 a\n\nl2\n l1 a\nl1 a", "é\xa0è  ñ", "one two " * 500,
         " ".join(map(str, range(300))), " ".join(map(str, [*range(20), *range(20)]))]


def test_counts_equal_plain_version():
    rnd = random.Random(1)
    for text in [*TEXTS, *(" ".join(rnd.choice("abc") for _ in range(60)) for _ in range(30)), *(prose(rnd, 90) for _ in range(10))]:
        got = dict(zip(COUNTS, text_counts(text or "")))
        assert (got["n_words"], got["word_chars"], got["n_symbols"], got["n_dup_lines"], got["n_repeat_words"]) == plain_counts(text)


def robust(x, share=0.55, steps=5):
    """The same estimate for one group, in numpy."""
    def bins(v, width):
        return np.floor(v / width)

    def at(v, q):
        b = np.sort(bins(v, Q.WIDTH))
        return (b[int(np.ceil(q * len(b))) - 1 if q * len(b) > 0 else 0] + 0.5) * Q.WIDTH
    centre = np.array([at(c, 0.5) for c in x.T])
    spread = np.array([at(c, 0.75) - at(c, 0.25) for c in x.T])
    precision = np.diag(1 / ((spread / 1.349) ** 2 + Q.FLOORS ** 2))
    for step in range(steps + 1):
        d = np.einsum("ij,jk,ik->i", x - centre, precision, x - centre)
        b = np.floor(np.log(d + 1e-9) * Q.LOG_BINS)
        if step == steps:
            middle = np.exp((np.sort(b)[int(np.ceil(0.5 * len(b))) - 1] + 0.5) / Q.LOG_BINS)
            return centre, precision, max(1.0, middle / Q.chi_square_quantile(0.5, Q.P))
        order = np.sort(b)
        near = x[b <= order[min(len(b), int(np.ceil(share * len(b)))) - 1]]
        centre, precision = near.mean(axis=0), np.linalg.inv(np.cov(near.T, bias=True) + np.diag(Q.FLOORS ** 2))


def test_estimates_equal_numpy(spark):
    rnd = np.random.default_rng(3)
    data = {g: rnd.normal(size=(n, Q.P)) * (1 + np.arange(Q.P)) + (0 if g[0] else 5) for g, n in (((None, "a"), 400), (("en", "b"), 151), (("de", None), 1))}
    data[None, "a"][:150] += 40
    rows = [(*g, *map(float, x)) for g, xs in data.items() for x in xs]
    points = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"{v} double" for v in Q.VALUES))
    got = {(r.lang, r.source): r for r in Q.robust_estimates(points).collect()}
    assert set(got) == set(data)
    for g, x in data.items():
        centre, precision, scale = robust(x) if len(x) > 1 else (x[0], np.diag(1 / Q.FLOORS ** 2), 1.0)
        assert np.allclose(got[g].center, centre, atol=1e-6) and np.allclose(np.array(got[g].precision).reshape(Q.P, Q.P), precision, rtol=1e-6)
        assert got[g].scale == pytest.approx(scale)
    assert np.abs(got[None, "a"].center).max() < 10  # three eighths of far points have no pull


def test_rules_reject_junk_and_keep_prose(spark, documents, write_tables):
    docs = corpus() + [(1000 + i, t, None, None) for i, t in enumerate(TEXTS)] + [(None, "no id " * 30, "en", "s0"), (5, "twice", "en", "s0")]
    got = op10_quality_rules(spark, write_tables(documents=documents(docs))).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id != 5}
    for doc, text, *_ in docs:
        if doc in by:
            r, want = by[doc], plain_counts(text)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
            assert not (r.base_failed and r.kept)
    assert all(by[i].kept == (i % 9 != 0) for i in range(260) if i != 5)


def test_rules_extremes(spark, documents):
    df = documents(corpus(n=30)).withColumns({c: F.lit(1) for c in ("counts", "x0", "quality", "of_lang", "of_group", "judged", "center")})
    kept = Q.good_documents(df)
    assert kept.columns == df.columns and 0 < kept.count() < 30
    assert Q.good_documents(documents([])).count() == 0


def test_repeated_lines_alone_reject_in_a_large_clean_group(spark, documents):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(3, 9)))
    docs = [(i, "\n".join(" ".join(word() for _ in range(3)) for _ in range(40)), "en", "s0") for i in range(600)]
    for i in range(600, 604):  # each line twice, in another order, so that no run of eight words repeats
        lines = [" ".join(word() for _ in range(3)) for _ in range(20)]
        docs.append((i, "\n".join(lines + rnd.sample(lines, 20)), "en", "s0"))
    one = docs[0][1].split("\n")
    docs.append((700, "\n".join([*one, one[0]]), "en", "s0"))  # a single repeat is no fault
    got = {r.doc_id: r.quality for r in Q.judge(documents(docs)).collect()}
    assert not any(got[i].base_failed or got[i].kept for i in range(600, 604))
    assert all(got[i].kept for i in [*range(600), 700])


# trained operators

def test_logistic_fit_and_cut():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(4000, 2))
    y = (rnd.random(4000) < sigmoid(x @ [2.0, -1.0] + 0.5)).astype(float)
    w = fit_logistic(x, y, np.ones(4000), 1e-3)
    assert np.allclose(w, [2, -1, 0.5], atol=0.2)
    assert best_cut(np.array([0.9, 0.8, 0.7, 0.1]), np.array([1, 1, 0, 0.0]), np.ones(4)) == 0.8


def toxic_corpus(n=900):
    rnd = random.Random(11)
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = prose(rnd, rnd.randrange(30, 120)).split(" ")
        for _ in range(len(words) // 12 * toxic):
            words.insert(rnd.randrange(len(words)), rnd.choice(["wickedly", "rotten", "blockhead", "vermin"]))
        docs.append((i, " ".join(words)))
        labels.append((i, None, int(toxic)))
    return docs, labels


def held(doc, parts, left):
    return zlib.crc32(str(doc).encode()) % parts == left


def test_toxicity_on_held_out_rows(spark, documents, write_tables):
    docs, labels = toxic_corpus()
    extra = [(5000, None), (5001, ""), (5002, "123 !!"), (0, docs[0][1]), (None, "no id")]
    path = write_tables(documents=documents(docs + extra), labels=spark.createDataFrame([(d, q, 1 - t if held(d, 3, 1) else t) for d, q, t in labels], "doc_id long, quality int, toxic int"))
    got = op5_toxicity(spark, path).collect()  # held-out labels are turned round, so learning from them would show
    assert len(got) == len(docs + extra) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    out = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 5000]
    assert len(out) > 200 and np.mean([r.predicted == (r.doc_id % 4 == 0) for r in out]) > 0.95
    assert all(r.held_out == held(r.doc_id, 3, 1) for r in got if r.doc_id is not None)
    assert {r.predicted for r in got if r.doc_id is None or r.doc_id >= 5000} == {0}


def test_toxicity_without_labels(spark, documents, write_tables):
    path = write_tables(documents=documents([(1, "a"), (2, None)]), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert [(r.score, r.predicted) for r in op5_toxicity(spark, path).collect()] == [(0.0, 0)] * 2
    assert fit([b"a"], np.array([1.0]), np.ones(1)) is None
    assert score_toxicity(documents([]), None).count() == 0


def test_toxicity_model_scores_long_text_and_ignores_clashing_columns(spark, documents):
    docs, labels = toxic_corpus(300)
    model = fit([t.encode() for _, t in docs], np.array([float(t) for _, _, t in labels]), np.ones(len(docs)))
    rnd = random.Random(5)
    far = prose(rnd, 20_000) + " rotten vermin blockhead" * 800
    df = documents([(1, far)]).withColumn("score", F.lit("mine"))
    assert score_toxicity(df, model).select("doc_id", "predicted").first() == (1, 1)


def test_quality_on_held_out_rows(spark, documents, write_tables):
    docs = [(d, t) for d, t, *_ in corpus(7, 900)]
    good = {d: int(d % 9 != 0) for d, _ in docs}
    extra = [(5000, None), (5001, ""), (0, docs[0][1]), (None, prose(random.Random(3), 60))]
    labels = spark.createDataFrame([(d, 1 - g if held(d, 5, 0) else g, None) for d, g in good.items()], "doc_id long, quality int, toxic int")
    got = op9_quality_classifier(spark, write_tables(documents=documents(docs + extra), labels=labels)).collect()
    assert len(got) == len(docs + extra) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    out = [r for r in got if r.held_out and r.doc_id in good]
    assert len(out) > 120 and np.mean([r.predicted == good[r.doc_id] for r in out]) > 0.97
    assert all(r.held_out == held(r.doc_id, 5, 0) for r in got if r.doc_id is not None)


def test_quality_without_labels_or_rows(spark, documents, write_tables):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.predicted for r in op9_quality_classifier(spark, write_tables(documents=documents([(1, "a")]), labels=labels)).collect()] == [1]
    assert op9_quality_classifier(spark, write_tables(documents=documents([]), labels=labels)).count() == 0


# pipeline

def test_pipeline_stages(spark, documents, write_tables, tiktoken_50k):
    import corpus_pipeline as P

    rnd = random.Random(21)
    passage = prose(rnd, 40).replace("\n", " ")
    shared = "a line that very many of the documents carry"
    rows = [(d, t, la, s, len(t)) for d, t, la, s in corpus(5, 120)]
    add = lambda doc, text: rows.append((doc, text, "en", "s0", len(text or "")))
    for i in range(5):
        add(500 + i, f"{prose(rnd, 50)}\n{shared}")
    for i in range(4):
        add(600 + i, prose(random.Random(77), 80))  # copies
    add(700, f"{prose(rnd, 40)} {passage} {prose(rnd, 40)}")
    for doc, text in ((800, None), (801, ""), (None, prose(rnd, 60))):
        add(doc, text)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    path = write_tables(documents=df, benchmark=spark.createDataFrame([(1, passage)], "item_id long, text string"))
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in P.STAGES[:-1]:
        after = stage(spark, docs, path)
        assert after.columns == docs.columns, name
        seen[name] = {r.doc_id: r.text for r in after.collect()}
        docs = after
    assert set(seen["quality_rules"]) == {r[0] for r in rows if r[1] and not (r[0] is not None and r[0] < 120 and r[0] % 9 == 0)}
    assert seen["line_dedup"].keys() == seen["quality_rules"].keys()
    assert [d for d, t in seen["line_dedup"].items() if shared in t] == [504]
    assert set(seen["line_dedup"]) - set(seen["near_dedup"]) == {601, 602}  # of the copies 603 kept the lines, the rest are alike
    assert set(seen["near_dedup"]) - set(seen["benchmark_decontamination"]) == {700}
    last = {r.doc_id: r for r in P.run(spark, path).collect()}
    assert last.keys() == seen["benchmark_decontamination"].keys()
    for doc, text in seen["benchmark_decontamination"].items():
        assert last[doc].ids == tiktoken_50k.encode_ordinary(text) and last[doc].round_trip and last[doc].n_tokens == len(last[doc].ids)


def test_pipeline_of_an_empty_table(spark, documents, write_tables):
    import corpus_pipeline as P

    path = write_tables(documents=documents([]), benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert P.run(spark, path).count() == 0


def plain_contexts(texts):
    """Context sums by slot, pair by pair."""
    from logwarden.llm import quality_model as Q
    places, signs = Q.index_vectors()
    total = np.zeros((Q.SLOTS, Q.DIMENSIONS))
    for text in texts:
        slots = Q.slots_of((text or "").encode())
        for far in range(1, Q.REACH + 1):
            for a, b in ((slots[:-far], slots[far:]), (slots[far:], slots[:-far])):
                for k in range(Q.NONZERO):
                    np.add.at(total, (a, places[b, k]), signs[b, k])
    return total


def test_contexts_cross_the_edges_of_chunks(monkeypatch):
    """A text of 300,000 words and many short ones, in chunks of several sizes, against the plain sum."""
    import pyarrow as pa
    from logwarden.llm import quality_model as Q
    rnd = np.random.default_rng(5)
    long = " ".join(f"w{i}" for i in rnd.integers(0, 5000, 300_000))
    texts = ["one", None, "", "a b", long, "été x y z z z", " ".join(["same"] * 40), *(f"t{i} u{i} v" for i in range(300))]
    want = plain_contexts(texts)
    for chunk in (Q.CHUNK, 1 << 12, 1001):
        monkeypatch.setattr(Q, "CHUNK", chunk)
        batches = [pa.RecordBatch.from_pydict({"text": pa.array(part, pa.string())}) for part in (texts[:3], texts[3:6], texts[6:])]
        got = np.zeros_like(want)
        for batch in Q.context_batches(iter(batches)):
            got[batch["slot"].to_numpy()] += np.column_stack([batch[f"d{i}"].to_numpy() for i in range(Q.DIMENSIONS)])
        assert np.array_equal(got, want), chunk


def test_pooled_vectors_of_long_texts(monkeypatch):
    """Mean, deviation and likeness of neighbours of a long text against plain numpy, whatever the chunk."""
    from logwarden.llm import quality_model as Q
    rnd = np.random.default_rng(6)
    vectors = rnd.normal(size=(Q.SLOTS, Q.DIMENSIONS)).astype(np.float32)
    slots = rnd.integers(0, 900, 300_000)
    rows = vectors[slots].astype(np.float64)
    want = np.concatenate([rows.mean(0), rows.std(0), [(rows[1:] * rows[:-1]).sum(1).mean(), (slots[1:] == slots[:-1]).mean()]])
    for chunk in (Q.CHUNK, 4096):
        monkeypatch.setattr(Q, "CHUNK", chunk)
        assert np.allclose(Q.pooled(slots, vectors), want, atol=2e-3)
    assert not Q.pooled(slots[:0], vectors).any() and Q.pooled(slots[:1], vectors).shape == (Q.POOLED,)


def test_quality_model_ignores_clashing_columns(spark):
    """Columns named like those that training and scoring make, null, empty and very long texts, repeated rows."""
    from logwarden.llm import quality_model as Q
    good, bad = "the river ran past old stone houses and people walked slowly home", "buy now !!! $$$ 777 click click ### win win"
    texts = [(i, (good if i % 2 else bad) + f" {i}") for i in range(80)] + [(900, None), (901, ""), (902, good * 20_000), (903, bad), (903, bad)]
    plain = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")
    clashing = plain.withColumns({c: F.lit("x") for c in ("y", "weight", "labelled", "score", "predicted", "pooled", "aside", "quality")})
    results = []
    for docs in (plain, clashing):
        rows = Q.pool_documents(docs, Q.word_vectors(docs), docs.columns)
        model = Q.train_quality(rows, labels)
        scored = Q.score_quality(rows, model, ["doc_id", *(c for c in docs.columns if c in ("y", "weight", "labelled", "score"))])
        assert scored.columns.count("score") == 1 and scored.schema["score"].dataType.typeName() == "double"
        results.append(sorted((r.doc_id, r.score, r.predicted) for r in scored.collect()))
    assert results[0] == results[1] and len(results[0]) == len(texts) and all(0 <= s <= 1 for _, s, _ in results[0])
