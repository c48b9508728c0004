"""Decontamination, line dedup, SimHash and sharding against plain versions."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import xxhash
from logwarden.llm.components import connected_components
from logwarden.llm.decontaminate import blocks_of, decontaminate, find_benchmark
from logwarden.llm.line_dedup import dedupe_lines
from logwarden.llm.queries import op1_decontamination, op3_line_dedup, op4_simhash, op6_sharding
from logwarden.llm.sharding import shard_rows
from logwarden.llm.simhash import first_of_each, near_duplicates, similar_pairs
from pyspark.sql import functions as F

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def prose(rnd, n, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


# decontamination

def leaks(docs, items, window=10):
    wins = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            wins[tuple(w[i:i + window])].add(str(item))
    out = []
    for doc, text in docs:
        w, hit, who = words(text), set(), set()
        for n in {len(k) for k in wins}:
            for i in range(len(w) - n + 1):
                if (found := wins.get(tuple(w[i:i + n]))):
                    hit |= set(range(i, i + n))
                    who |= found
        out.append((doc, len(w), len(hit), len(who), sha(",".join(sorted(who))), bool(hit)))
    return sorted(out, key=repr)


def leaky():
    rnd = random.Random(3)
    items = [(i, prose(rnd, 25)) for i in range(12)] + [(20, "Short One"), (21, ""), (22, None), (3, prose(rnd, 30)), (23, "été-ÉTÉ déjà")]
    docs = [(i, prose(rnd, 80)) for i in range(20)] + [(50, None), (51, ""), (52, "...")]
    for i, (item, text) in enumerate(items[:8]):
        part = (text or "").split()[3:3 + 9 + i % 3]
        docs.append((100 + i, f"É {prose(rnd, 5)}: {' , '.join(part).upper()}! {prose(rnd, 5)}"))
    docs += [(200, "a short-one b"), (200, "a short-one b"), (201, items[0][1] + " " + items[1][1]), (202, "xx ÉTÉ DÉJÀ")]
    return docs, items


def test_decontamination_equals_plain_version(spark, documents, write_tables):
    docs, items = leaky()
    bench = spark.createDataFrame(items, "item_id long, text string")
    path = write_tables(documents=documents(docs), benchmark=bench)
    got = [tuple(r) for r in op1_decontamination(spark, path).collect()]
    assert sorted(got, key=repr) == leaks(docs, items)


def test_blocks_of_the_benchmark_change_nothing(spark, documents):
    docs, items = leaky()
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = documents(docs)
    whole = {r.doc_id: r.found for r in find_benchmark(df, bench, keep=["doc_id"]).collect()}
    parts = find_benchmark(df, bench, block_words=40, keep=["doc_id"])
    assert {r.doc_id: r.found for r in parts.collect()} == whole
    cut = list(blocks_of(bench, 10, 15))
    assert len(cut) > 5 and all(sum(len(w) for _, w in b) <= 15 + 10 for b in cut)


def test_spans_are_offsets_of_the_original(spark, documents):
    docs, items = leaky()
    found = find_benchmark(documents(docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    seen = 0
    for r in found:
        w = words(r.text)
        for span, run in zip(r.found.spans, r.found.ranges):
            assert words(r.text[span.start:span.end]) == w[run.first:run.end]
            seen += 1
    assert seen >= 6


def test_decontamination_extremes(spark, documents):
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    df = documents([(1, "one two three"), (2, "two one"), (None, None)]).withColumn("found", F.lit("mine"))
    kept = decontaminate(df, bench, out="found_")
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2]
    assert find_benchmark(df, bench.limit(0)).filter(F.size("found.items") > 0).count() == 0
    assert find_benchmark(documents([]), bench).count() == 0


# line dedup

def kept_lines(docs, min_chars=20, min_docs=3):
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(LOWER)
    holders = defaultdict(set)
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(doc)
    low = lambda d: (d is not None, d or 0)
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(holders.get(key(x), ())) < min_docs or max(holders[key(x)], key=low) == doc]
        out.append((doc, len(lines), len(lines) - len(stay), sha("\n".join(stay))))
    return sorted(out, key=repr)


def shared_lines():
    rnd = random.Random(9)
    pool = [f"{prose(rnd, 6)} LINE {i}" for i in range(12)] + ["é" * 20, "x" * 19, "ÀÀÀÀÀÀÀÀÀÀÀÀÀÀÀÀÀÀÀÀ", "short"]
    docs = [(i, "\n".join(rnd.choice(["", " ", "\t", "\xa0"]) + rnd.choice([str.lower, str.upper, str])(rnd.choice(pool)) + rnd.choice(["", "\r", "  "])
                          for _ in range(rnd.randrange(1, 9)))) for i in range(40)]
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, pool[0]), (103, pool[0]), (103, pool[1]), (None, pool[2] + "\n" + pool[3]), (None, pool[2])]
    return docs + [(200 + i, "everyone has this one line\nown " + prose(rnd, 7)) for i in range(60)]


def test_line_dedup_equals_plain_version(spark, documents, write_tables):
    docs = shared_lines()
    got = [tuple(r) for r in op3_line_dedup(spark, write_tables(documents=documents(docs))).collect()]
    assert sorted(got, key=repr) == kept_lines(docs)


def test_line_dedup_is_linear_in_the_lines_of_a_document(documents):
    """One dropped line makes a document be put together anew; 16 times the lines may take about 16 times as long, not 256."""
    import time
    shared = "a line that three documents hold"
    took = []
    for n in (6_250, 100_000):
        df = documents([(1, "\n".join([shared, *(f"own line number {i} of a long document" for i in range(n))])), (2, shared), (3, shared)])
        start = time.perf_counter()
        rows = {r.doc_id: (r.deduped.n_lines, r.deduped.n_dropped, len(r.deduped.text)) for r in dedupe_lines(df).select("doc_id", "deduped").collect()}
        took.append(time.perf_counter() - start)
        assert rows[1][:2] == (n + 1, 1) and rows[1][2] == sum(len(f"own line number {i} of a long document") + 1 for i in range(n)) - 1
        assert rows[2] == (1, 1, 0) and rows[3] == (1, 0, len(shared))
    assert took[1] < 60 and took[1] < 20 * took[0] + 10



def test_line_dedup_keeps_columns_and_counts_ids_once(spark, documents):
    line = "this line has twenty letters or more"
    df = documents([(1, line), (1, line), (1, line), (2, line)]).withColumn("hash", F.lit(1)).withColumn("deduped", F.lit(2))
    out = dedupe_lines(df)
    assert {r.deduped.n_dropped for r in out.collect()} == {0}  # two documents only
    assert out.columns == ["doc_id", "text", "lang", "source", "hash", "deduped"]
    assert dedupe_lines(documents([])).count() == 0


# SimHash

def print_of(text, n=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i:i + n]), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def joined(prints, radius=2):
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    listed = sorted(parent)
    for i, a in enumerate(listed):
        for b in listed[i + 1:]:
            if (a ^ b).bit_count() <= radius:
                parent[find(b)] = find(a)
    return {p: find(p) for p in listed}


def similar_docs():
    rnd = random.Random(4)
    docs = [(i, prose(rnd, rnd.randrange(1, 60))) for i in range(60)]
    docs += [(100 + i, docs[i][1]) for i in range(10)]
    long = [prose(rnd, 400) for _ in range(6)]
    docs += [(200 + 10 * k + i, text.replace(f"w{rnd.randrange(400)}", "other", 1) if i else text.upper()) for k, text in enumerate(long) for i in range(6)]
    return docs + [(300, None), (301, ""), (302, " \n"), (303, "One"), (304, "one\ttwo"), (304, "one\ttwo"), (None, docs[3][1]), (None, "only me here")]


def test_simhash_equals_plain_version(spark, documents, write_tables):
    docs = similar_docs()
    prints = {t: print_of(t) for _, t in docs}
    root = joined(set(prints.values()))
    smallest = {}
    for doc, text in docs:
        r = root[prints[text]]
        smallest[r] = min((d for d in (doc, smallest.get(r)) if d is not None), default=None)
    want = sorted(((d, f"{prints[t]:016x}", smallest[root[prints[t]]]) for d, t in docs), key=repr)
    got = [tuple(r) for r in op4_simhash(spark, write_tables(documents=documents(docs))).collect()]
    assert sorted(got, key=repr) == want
    assert len(set(root.values())) < len(root)  # some near copies that are not exact


def test_one_document_of_each_group_stays(spark, documents):
    docs = similar_docs()
    df = documents(docs).withColumns({c: F.lit("mine") for c in ("fp", "row", "best", "of_fp", "found", "group_fp")})
    kept = first_of_each(df).collect()
    groups = near_duplicates(df).filter("group.first").count()
    root = joined({print_of(t) for _, t in docs})
    assert len(kept) == groups == len(set(root.values()))
    assert first_of_each(df).columns == df.columns and first_of_each(documents([])).count() == 0


def test_large_buckets_are_compared_in_tiles(spark):
    rnd = random.Random(8)
    centre, prints = rnd.getrandbits(64), set()
    for _ in range(300):
        p = centre
        for _ in range(rnd.randrange(0, 9)):
            p ^= 1 << rnd.randrange(16)  # three blocks stay equal, so all of these share buckets
        prints.add(p)
    prints |= {rnd.getrandbits(64) for _ in range(50)}
    signed = np.array(sorted(prints), np.uint64).view(np.int64).tolist()
    edges = similar_pairs(spark.createDataFrame([(x,) for x in signed], "fp long"), 2, tile=8).collect()
    parent = {x: x for x in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        assert ((a ^ b) & (2 ** 64 - 1)) and a in parent and b in parent
        parent[find(a)] = find(b)
    want = joined(prints)
    groups = defaultdict(set)
    for u, s in zip(sorted(prints), signed):
        groups[want[u]].add(find(s))
    assert all(len(g) == 1 for g in groups.values()) and len({g for s in groups.values() for g in s}) == len(groups)


def test_components_of_paths_stars_and_loops(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(1000, 1000 + i) for i in range(1, 60)]
    edges = spark.createDataFrame(path + star + [(2000, 2001), (2001, 2000), (5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{1000 + i: 1000 for i in range(1, 60)}, 2001: 2000}
    assert connected_components(edges.limit(0)).count() == 0


# sharding

def test_shards_equal_plain_version(spark, documents, write_tables):
    rnd = random.Random(1)
    docs = [(rnd.randrange(10_000), "é" * rnd.randrange(60)) for _ in range(700)] + [(5, None), (None, "no id"), (6, "")]
    got = sorted((tuple(r) for r in op6_sharding(spark, write_tables(documents=documents(docs))).collect()), key=lambda r: (r[4], r[5]))
    low = lambda d: (d is not None, d or 0)
    assert [r[0] for r in got] == sorted((d for d, _ in docs), key=low)
    assert sorted((r[0], r[1], r[2]) for r in got if r[0] is not None) == sorted((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in docs if d is not None)
    total, before, slots = sum(r[1] for r in got), 0, defaultdict(int)
    for _, size, _, law, shard, slot, grown in got:
        assert shard == (2 * before + size) * 24 // (2 * total) and law == "bytes" and grown is None
        assert slot == slots[shard]
        slots[shard] += 1
        before += size
    assert len(slots) == 24


def test_sharding_extremes(spark, documents):
    same = documents([(7, "same text")] * 100).withColumn("size", F.lit("mine"))
    got = shard_rows(same, 4, blocks=3).groupBy("shard").count().collect()
    assert sorted(tuple(r) for r in got) == [(i, 25) for i in range(4)]
    assert shard_rows(documents([]), 4).count() == 0
    assert [r.shard for r in shard_rows(documents([(1, None)]), 4).collect()] == [2]
