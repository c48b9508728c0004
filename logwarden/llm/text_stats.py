"""Counts of a text that quality rules judge."""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from logwarden.llm.common import BLANKS, sliced, tidied

SYMBOLS = "#*$%&|<>"
#: Words of the windows in which repeats are looked for.
REPEAT_WINDOW = 8
#: Bytes of text that go back from Python at once.
SLICE = 4_000_000
UPPER, MARKS = string.ascii_uppercase.encode(), string.punctuation.encode()
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks")


def repeated_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words inside any run of ``window`` words (a power of two) that the text holds twice or more.

    Runs are numbered by doubling: a run of 2k words is the pair of its halves' numbers. Nothing is hashed, so the
    count is exact; where all runs of one length differ, so do all longer ones.
    """
    if len(words) <= window:
        return 0
    seen: dict[bytes, int] = {}
    runs, kinds, length = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64), len(seen), 1
    while length < window:
        pairs = runs[:-length] * kinds + runs[length:]
        different, runs = np.unique(pairs, return_inverse=True)
        kinds, length = len(different), 2 * length
        if kinds == len(runs):
            return 0
    twice = np.flatnonzero(np.bincount(runs)[runs] > 1)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, twice, 1)
    np.add.at(edges, twice + window, -1)
    return int(np.count_nonzero(np.cumsum(edges)))


def text_counts(text: str) -> tuple[int, ...]:
    """The COUNTS of one text."""
    data = text.encode()
    words = data.split()
    lines = text.split("\n")
    worded = [x for x in lines if x.strip(BLANKS)]
    return (len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines),
            len(worded) - len(set(worded)), repeated_words(words), len(data) - len(data.translate(None, UPPER)),
            len(data) - len(data.translate(None, MARKS)))


def count_batches(batches: Iterator[pa.RecordBatch], keep: list[str], out: str) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in sliced(whole, pc.binary_length(whole.column("text")), SLICE)):
        made = [text_counts(t.as_py() or "") for t in batch.column("text")]
        counts = pa.StructArray.from_arrays([pa.array([m[i] for m in made], pa.int64()) for i in range(len(COUNTS))], COUNTS)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), counts], [*keep, out])


def count_texts(docs: DataFrame, out: str = "counts", keep: list[str] | None = None) -> DataFrame:
    """Adds the struct ``out`` of COUNTS to each document.

    Words are separated by blanks; ``word_chars`` are code points in words; ``n_dup_lines`` counts lines with a word
    that equal an earlier line; ``n_upper`` and ``n_marks`` count A-Z and ASCII punctuation. A null text is an empty one:
    no words, one line. ``keep`` names the columns to carry on (all by default); one named ``out`` is replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != out.lower()]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(out, T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))])
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(
        lambda batches: tidied(count_batches(batches, keep, out)), schema)
