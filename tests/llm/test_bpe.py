import hashlib
import random

import numpy as np
from logwarden.llm import bpe
from logwarden.llm.queries import byte_bpe, op2_byte_bpe
from pyspark.sql import functions as F

AWKWARD = [None, "", " ", "\n", "a  b", "  lead", "trail  ", "a \n b", "x  y  z", "don't we'LL I'm", "\x1c \x1d a\x85 b",
           "12345 6 ٣٤ ½ Ⅷ", "日本語 テスト", "👩‍👩‍👧 family", "é é", "<|endoftext|>", "tab\tand  two\r\n\r\nlines", "!!! ??? ...a",
           "a" * 5000, "ab" * 3000, "​ zero   sep", "ÀÉ ñandú straße", "� \U0010ffff"]


def noise(seed, n):
    rnd = random.Random(seed)
    pool = "aab  eo\n\t'sdmlt.,!0129éñß日  \U0001f600"
    return "".join(rnd.choice(pool) for _ in range(n))


def test_same_ids_as_the_rank_library(spark, documents, tiktoken_50k):
    texts = AWKWARD + [noise(i, 400) for i in range(60)]
    rows = bpe.encode(documents(list(enumerate(texts))), byte_bpe(), keep=["doc_id"]).collect()
    assert {r.doc_id: list(r.ids) for r in rows} == {i: tiktoken_50k.encode_ordinary(t or "") for i, t in enumerate(texts)}


def test_every_character_class_splits_alike(tiktoken_50k):
    encoder = bpe.Encoder(byte_bpe())
    points = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b {c} 1{c}2  {c}\n{c}!" for c in points]
    for at in range(0, len(texts), 8192):
        part = texts[at:at + 8192]
        got = encoder.encode(part)
        wrong = [hex(ord(points[at + i])) for i, t in enumerate(part) if got[i].tolist() != tiktoken_50k.encode_ordinary(t)]
        assert not wrong, wrong[:20]


def test_long_pieces_are_cut_at_marks_alike(tiktoken_50k):
    rnd = random.Random(4)
    pool = ["漢字かな", "カタ", "한글", "word", "42", "²", "ñ", "_", "'", "’", "。", "、", "，", ".", ":", "!?", "…", "：", "’s", "'ll", "\u0301", "\u200b", "\U0001f600"]
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randrange(60, 400))) for _ in range(400)]
    texts += [f"{'漢' * 90}{c}{'字' * 90}。{'a' * 90}{c}." for c in map(chr, range(0x20, 0x3100))]
    encoder = bpe.Encoder(byte_bpe())
    got = encoder.encode(texts)
    assert [g.tolist() for g in got] == [tiktoken_50k.encode_ordinary(t) for t in texts]
    assert any(len(bpe.pieces(t)) > 3 for t in texts) and max(map(len, encoder.known)) <= bpe.SHORT


def test_memory_of_pieces_is_bounded():
    encoder = bpe.Encoder(byte_bpe())
    for i in range(30):
        encoder.encode([f"{chr(0x4e00 + i * 40 + j) * 3000}" for j in range(40)])
    assert len(encoder.known) == 0
    for i in range(3):
        encoder.encode([" ".join(f"x{i}y{j}" for j in range(60_000))])
        assert len(encoder.known) <= bpe.REMEMBERED


def test_round_trip_and_digests(spark, documents, write_tables, tiktoken_50k):
    texts = AWKWARD + [noise(i, 300) for i in range(20)]
    path = write_tables(documents=documents([*enumerate(texts), (0, "again"), (None, "no id")]))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op2_byte_bpe(spark, path).collect())
    want = []
    for i, t in [*enumerate(texts), (0, "again"), (-1, "no id")]:
        ids = tiktoken_50k.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)


def test_offsets_cover_split_characters(spark, documents):
    rows = bpe.encode(documents(list(enumerate(AWKWARD))), byte_bpe(), offsets=True).collect()
    table = bpe.token_bytes(byte_bpe())
    for r in rows:
        text, at = r.text or "", 0
        begins = np.cumsum([0] + [len(c.encode()) for c in text])
        for i, a, b in zip(r.ids, r.starts, r.ends):
            assert begins[a] <= at and at + len(table[i]) <= begins[b]  # the token's bytes lie in its characters
            assert begins[a + 1] > at and begins[b - 1] < at + len(table[i])  # and each of them holds some
            at += len(table[i])
        assert at == len(text.encode())


def test_decoding_halves_of_a_character(spark, documents):
    ids = bpe.Encoder(byte_bpe()).encode(["👩"])[0].tolist()
    assert len(ids) > 1
    df = spark.createDataFrame([(1, ids), (2, ids[:1]), (3, []), (4, None)], "doc_id int, ids array<int>")
    as_bytes = {r.doc_id: r.decoded for r in bpe.decode(df, byte_bpe()).collect()}
    as_text = {r.doc_id: r.decoded for r in bpe.decode(df, byte_bpe(), as_text=True).collect()}
    assert as_bytes[1] == "👩".encode() and "👩".encode().startswith(bytes(as_bytes[2])) and as_bytes[3] == b"" and as_bytes[4] is None
    assert as_text[1] == "👩" and set(as_text[2]) == {"�"} and as_text[3] == "" and as_text[4] is None


def test_clashing_names_and_empty_table(spark, documents):
    df = documents([(1, "one two")]).withColumn("ids", F.lit("mine")).withColumn("decoded", F.lit(1))
    row = bpe.decode(bpe.encode(df, byte_bpe()), byte_bpe(), as_text=True).first()
    assert row.decoded == "one two" and row.lang == "en"
    assert bpe.decode(bpe.encode(documents([]), byte_bpe()), byte_bpe()).count() == 0
