"""Fill-in-middle: a document's middle is moved to its end, so that a model learns to fill gaps."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logwarden.llm.common import fresh, tidied

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MADE = T.StructType([T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
                     T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])

LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
#: Random numbers of the rolling hash, from a rule. A chunk ends where the highest CUT_BITS bits of the hash of the last
#: 32 bytes are zero (each 512 bytes on average), or after LONGEST bytes.
GEAR = np.array([int.from_bytes(hashlib.md5(bytes([b])).digest()[:4], "little") for b in range(256)], np.uint32)
CUT_BITS, LONGEST = 9, 8192
#: Bytes of chunks that one task remembers.
REMEMBERED = 16_000_000
#: Bytes of output gathered before they leave a task.
GROUP = 4_000_000


class Chunk(NamedTuple):
    """What documents that hold a chunk need to know of it."""
    tokens: int
    chars: int
    opens: bool  # begins with a letter
    closes: bool  # ends with one
    lead: int  # bytes of the letters it begins with


def token_starts(data: bytes) -> np.ndarray:
    """Where tokens ``[A-Za-z]+|[^A-Za-z]`` of UTF-8 text begin."""
    raw = np.frombuffer(data, np.uint8)
    letter = LETTER[raw]
    starts = ~letter & ((raw & 0xC0) != 0x80)
    starts |= letter & ~np.concatenate([[False], letter[:-1]])
    return np.flatnonzero(starts)


def summary(data: bytes) -> Chunk:
    starts, raw = token_starts(data), np.frombuffer(data, np.uint8)
    opens = bool(LETTER[raw[0]])
    lead = (int(starts[1]) if len(starts) > 1 else len(data)) if opens else 0
    return Chunk(len(starts), int(np.count_nonzero((raw & 0xC0) != 0x80)), opens, bool(LETTER[raw[-1]]), lead)


def chunk_ends(data: bytes) -> list[int]:
    """Where the chunks of a text end. What lies well inside a passage is cut alike wherever the passage stands."""
    raw = np.frombuffer(data, np.uint8)
    rolling, width = GEAR[raw], 1
    while width < 32:  # by doubling: the hash of 2w bytes from two of w
        rolling[width:] = rolling[width:] + (rolling[:-width] << np.uint32(width)) if width < len(raw) else rolling[width:]
        width *= 2
    whole = np.append((raw[1:] & 0xC0) != 0x80, True)  # never inside a character
    ends, at = [], 0
    for end in [*(np.flatnonzero((rolling >> np.uint32(32 - CUT_BITS) == 0) & whole) + 1).tolist(), len(data)]:
        while end - at > LONGEST:
            at += LONGEST
            while (data[at] & 0xC0) == 0x80:
                at -= 1
            ends.append(at)
        if end > at:
            ends.append(end)
            at = end
    return ends


class Chunked:
    """A text as chunks, whose summaries come from a memory shared by the texts of a task.

    The memory is keyed by the chunk's own bytes, so a summary is never taken from other content.
    """

    def __init__(self, data: bytes, memory: dict[bytes, Chunk]):
        self.data, self.ends, self.chunks = data, chunk_ends(data) if data else [], []
        self.before, self.chars, at, n, chars, closes = [], [], 0, 0, 0, False
        self.new = 0
        for end in self.ends:
            part = data[at:end]
            known = memory.get(part)
            if known is None:
                known = memory[part] = summary(part)
                self.new += len(part)
            self.before.append(n)
            self.chars.append(chars)
            self.chunks.append(known)
            n += known.tokens - (closes and known.opens)  # a token that goes on from the chunk before is one
            chars += known.chars
            at, closes = end, known.closes
        self.n, self.n_chars = n, chars

    def after(self, units: int) -> tuple[int, int]:
        """(bytes, code points) of the first ``units`` tokens."""
        if units == 0:
            return 0, 0
        if units == self.n:
            return len(self.data), self.n_chars
        j = int(np.searchsorted(self.before, units)) - 1  # the chunk in which the last of them begins
        first, end = self.ends[j - 1] if j else 0, self.ends[j]
        joined = j > 0 and self.chunks[j - 1].closes and self.chunks[j].opens
        starts, at = token_starts(self.data[first:end]), units - self.before[j] + joined
        if at < len(starts):
            stop = int(starts[at])
            return first + stop, self.chars[j] + len(self.data[first:first + stop].decode())
        bytes_, chars = end, self.chars[j] + self.chunks[j].chars
        while self.chunks[j].closes and j + 1 < len(self.chunks) and self.chunks[j + 1].opens:
            j += 1
            bytes_, chars = bytes_ + self.chunks[j].lead, chars + self.chunks[j].lead
            if self.chunks[j].lead < self.ends[j] - self.ends[j - 1]:
                break
        return bytes_, chars


def transform(data: bytes, doc_id: str, seed: str, plain: int, spm: int, memory: dict[bytes, Chunk]) -> tuple[tuple, int]:
    """The fields of MADE, the output as bytes, and the bytes newly remembered."""
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]
    text = Chunked(data, memory)
    if not data or any(m in data for m in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= 100 - plain:
        return (text.n, "plain", None, None, data), text.new
    low, high = sorted((h[0] % (text.n + 1), h[1] % (text.n + 1)))
    (a, a_chars), (b, b_chars) = text.after(low), text.after(high)
    if h[3] % 100 < spm:
        form, output = "spm", b"".join([SUFFIX, data[b:], PREFIX, data[:a], MIDDLE, data[a:b]])
    else:
        form, output = "psm", b"".join([PREFIX, data[:a], SUFFIX, data[b:], MIDDLE, data[a:b]])
    return (text.n, form, a_chars, b_chars - a_chars, output), text.new


def transform_batches(batches: Iterator[pa.RecordBatch], id_column: str, keep: list[str], out: str, seed: str, plain: int, spm: int) -> Iterator[pa.RecordBatch]:
    memory: dict[bytes, Chunk] = {}
    held = 0

    def result(batch: pa.RecordBatch, first: int, made: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
        fields = [pa.array([m[i] for m in made], kind) for i, kind in enumerate(kinds)]
        fields.append(pa.array([m[4] for m in made], pa.binary()).cast(pa.string()))
        part = batch.slice(first, len(made))
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.StructArray.from_arrays(fields, MADE.names)], [*keep, out])

    for batch in batches:
        texts, ids, first, made, size = batch.column("text").cast(pa.binary()), batch.column(id_column), 0, [], 0
        for i in range(batch.num_rows):
            row, new = transform(texts[i].as_py() or b"", ids[i].as_py(), seed, plain, spm, memory)
            made.append(row)
            held, size = held + new, size + len(row[4])
            if held > REMEMBERED:
                memory.clear()
                held = 0
            if size > GROUP:
                yield result(batch, first, made)
                first, made, size = i + 1, [], 0
        if made:
            yield result(batch, first, made)


def fill_in_middle(docs: DataFrame, seed: str = "1", plain: int = 10, spm: int = 20, out: str = "fim", keep: list[str] | None = None) -> DataFrame:
    """Adds the struct ``out`` (n, form, prefix_chars, middle_chars, output) to each document.

    A text is cut at two of its n tokens ``[A-Za-z]+|[^A-Za-z]``, which a hash of seed and doc_id draws; ``output`` is
    ``<P>``prefix``<S>``suffix``<M>``middle (psm), for ``spm`` percent ``<S>``suffix``<P>``prefix``<M>``middle, and for
    ``plain`` percent the text as it is, as for texts that are empty or hold a marker. ``restored`` undoes it.

    Texts are cut into chunks by a rolling hash, so passages that documents share give the same chunks. A task counts the
    tokens of each different chunk once, remembers up to 16 MB of chunks by their content, adds counts up along a document
    (a word that goes on across an edge is one token) and looks only into the chunk where a cut falls. Results don't depend
    on what is remembered. There is no shuffle; a long text costs time in proportion and a few times its size in memory.

    A null text is an empty one; a null id counts as an empty text; rows that repeat an id are cut alike. ``keep`` names
    the columns to carry on (all by default); one named ``out`` is replaced. An empty table stays empty.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != out.lower()]
    name = fresh(docs, "doc_id_text")
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(out, MADE)])
    rows = docs.select(*(f"`{c}`" for c in dict.fromkeys([*keep, "text"])), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(name))
    return rows.mapInArrow(lambda batches: tidied(transform_batches(batches, name, keep, out, seed, plain, spm)), schema)


def restored(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` made ``output`` of. No marker stands in a text that was cut, so the first of each is ours."""
    def parts(second: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(4))
        first = F.substring_index(body, second, 1)
        rest = F.substr(body, F.length(first) + 4)
        last = F.substring_index(rest, MIDDLE.decode(), 1)
        return first, last, F.substr(rest, F.length(last) + 4)

    prefix, suffix, middle = parts(SUFFIX.decode())
    suffix_, prefix_, middle_ = parts(PREFIX.decode())
    return (F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_, middle_, suffix_)).otherwise(output))
