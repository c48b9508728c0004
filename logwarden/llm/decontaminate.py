"""Benchmark passages in documents, found by one Aho-Corasick automaton over words."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logwarden.llm.common import WORD_BYTES, built, staged, tidied

FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("ranges", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
])
RANGES = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def blocks_of(benchmark: DataFrame, window: int, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Pieces (item, words) of the items, in blocks of at most ``block_words`` words.

    Items stream through the driver; a block is all it holds. An item longer than a block is cut into pieces that
    overlap by ``window - 1`` words, so no window is lost.
    """
    block, room = [], block_words
    for row in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        words = (row[1] or "").encode().translate(WORD_BYTES).split()
        at = 0
        while words and (at == 0 or at + window - 1 < len(words)):
            if room < window and block:
                yield block
                block, room = [], block_words
            piece = words[at:at + max(room, window)]
            block.append((row[0] or "", piece))
            room -= len(piece)
            at += max(1, len(piece) - window + 1)
    if block:
        yield block


def automaton(pieces: list[tuple[str, list[bytes]]], window: int) -> tuple[dict[bytes, int], ahocorasick.Automaton]:
    """Word numbers (0 is no word of the block) and the automaton over windows, whose value is (length, items)."""
    numbers: dict[bytes, int] = {}
    items: dict[tuple[int, ...], set[str]] = {}
    for item, words in pieces:
        ids = [numbers.setdefault(w, len(numbers) + 1) for w in words]
        for i in range(max(1, len(ids) - window + 1)):
            items.setdefault(tuple(ids[i:i + window]), set()).add(item)
    made = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for key, who in (items or {(1,): set()}).items():  # without items, a word that no text has
        made.add_word(key, (len(key), frozenset(who)))
    made.make_automaton()
    return numbers, made


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Half-open ranges with overlapping and touching ones joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def spans_of(text: bytes, normal: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as code point offsets of the original text, which ``normal`` covers byte for byte."""
    inside = np.frombuffer(normal, np.uint8) != 32
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [(int(points[starts[a]]), int(points[ends[b - 1]])) for a, b in ranges]


def scan_batches(batches: Iterator[pa.RecordBatch], block: Broadcast, key: str, window: int, out: str,
                 keep: list[str]) -> Iterator[pa.RecordBatch]:
    numbers, windows = built(key, "automaton", lambda: automaton(block.value, window))
    number = numbers.get
    for batch in batches:
        before = batch.column(out) if out in batch.schema.names else None
        n_words, ranges, spans, items = [], [], [], []
        for i, text in enumerate(batch.column("text").cast(pa.binary())):
            text = text.as_py() or b""
            normal = text.translate(WORD_BYTES)
            words = normal.split()
            own, who = [], set()
            if words:
                for end, (length, found) in windows.iter(tuple(map(number, words, repeat(0)))):
                    own.append((end + 1 - length, end + 1))
                    who |= found
            if before is not None and (old := before[i].as_py())["items"]:
                own += [(r["first"], r["end"]) for r in old["ranges"]]
                who |= set(old["items"])
            own = merged(own)
            n_words.append(len(words))
            ranges.append([{"first": a, "end": b} for a, b in own])
            spans.append([{"start": a, "end": b} for a, b in spans_of(text, normal, own)] if own else [])
            items.append(sorted(who))
        found = pa.StructArray.from_arrays(
            [pa.array(n_words, pa.int64()), pa.array(ranges, RANGES), pa.array(spans, SPANS), pa.array(items, pa.list_(pa.string()))],
            ["n_words", "ranges", "spans", "items"])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), found], [*keep, out])


def scanner(block: Broadcast, window: int, out: str, keep: list[str]):
    key = uuid.uuid4().hex
    return lambda batches: tidied(scan_batches(batches, block, key, window, out, keep), keeps=True)


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = 100_000,
                   out: str = "found", keep: list[str] | None = None) -> DataFrame:
    """Adds the struct ``out`` to each document: where windows of benchmark items occur in it.

    Words are runs of ASCII letters, digits and longer characters, A-Z in lower case. An item gives every run of
    ``window`` consecutive words, or itself if it is shorter. The automaton works on word numbers, so a match is a
    whole-word match and its end a word position; each text is scanned once. ``ranges`` are merged word ranges, ``spans``
    the same as code point offsets of the original text, ``items`` the sorted ids of items with an occurring window.

    The benchmark is a stated query set. It is taken in blocks of ``block_words`` words (about 60 bytes of automaton
    for each of ten nodes a word), which bounds what is broadcast and held; a benchmark of several blocks is scanned
    block after block, with a written table between. There is no shuffle.

    ``keep`` names the columns to carry on (all by default); one named ``out`` is replaced. A null or empty text has no
    words, an item without words no window; repeated item ids count as one item, items without an id as one with an
    empty id. Without items nothing is found; an empty table stays empty.
    """
    spark = docs.sparkSession
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != out.lower()]
    docs = docs.select(*dict.fromkeys([*keep, "text"]))
    blocks = blocks_of(benchmark, window, block_words)
    block, following = next(blocks, []), next(blocks, None)
    while True:
        carry = keep if following is None else [c for c in docs.columns if c != out]
        schema = T.StructType([*(docs.schema[c] for c in carry), T.StructField(out, FOUND)])
        docs = docs.mapInArrow(scanner(spark.sparkContext.broadcast(block), window, out, carry), schema)
        if following is None:
            return docs
        docs = staged(docs, "benchmark-block")
        block, following = following, next(blocks, None)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, out: str = "found") -> DataFrame:
    """The documents without any benchmark window, with the columns of ``docs``."""
    found = find_benchmark(docs, benchmark, window, out=out)
    return found.filter(F.size(F.col(out)["items"]) == 0).select(*(f"`{c}`" for c in docs.columns))
