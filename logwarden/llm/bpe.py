"""Byte-level BPE over Arrow batches: ids, offsets and decoding."""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

from logwarden.llm.common import built, sliced, tidied

#: A place before a single space between characters that are no white space is always an edge of a match of the
#: pattern: no match holds a space after another character, and what looks ahead is white space only.
CUT = re.compile(r"(?<=\S)(?= \S)")
#: White space beside a space, where cutting at every space would be wrong.
RUNS = re.compile(r"\s | \s|^ | $")

#: Places inside long pieces that are edges too: a match that holds a letter or digit of these ranges holds no mark after it.
MARKS = re.compile("(?<=[0-9A-Za-z\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3])(?=[.,;:!?\u2026\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])")

#: Bytes or ids handled at once. Pieces remembered by one task, and their characters at most: 8 million in all.
GROUP, REMEMBERED, SHORT = 1_000_000, 100_000, 80


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself where it prints, else one from 256 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def halves(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two tokens whose merge makes ``token``, from merging its bytes by lower ranks; None if they don't lead there."""
    parts = [token[i:i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, at = min((ranks.get(a + b, len(ranks)), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank >= ranks[token]:
            return None
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1])


def tokenizer_from_ranks(ranks: dict[bytes, int], pattern: str) -> str:
    """A tokenizers definition that encodes as the ranks do.

    Every token of two bytes or more comes from one merge in rank order; a match that is a token itself is taken
    whole. Tokens that merging can't reach have no merge.
    """
    shown = byte_characters()
    text = lambda token: "".join(shown[b] for b in token)
    merges = [(text(pair[0]), text(pair[1])) for token in sorted(ranks, key=ranks.get) if len(token) > 1 and (pair := halves(token, ranks))]
    made = Tokenizer(models.BPE(vocab={text(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    made.decoder = decoders.ByteLevel()
    return made.to_str()


def pieces(text: str) -> list[str]:
    """``text`` cut at places that every encoding by the pattern cuts at."""
    if not text:
        return []
    if RUNS.search(text):
        cut = CUT.split(text)
    else:
        first, *rest = text.split(" ")
        cut = [first, *[" " + x for x in rest]]
    if max(map(len, cut)) <= SHORT:
        return cut
    return [x for p in cut for x in (MARKS.split(p) if len(p) > SHORT else (p,))]


def encoder_of(definition: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
    made = Tokenizer.from_str(definition)
    made.encode_special_tokens = True
    return made


class Encoder:
    """Encodes each different short piece once, as long as it remembers it. Lives as long as a task."""

    def __init__(self, definition: str, tokenizer: Tokenizer | None = None):
        self.tokenizer = tokenizer or encoder_of(definition)
        self.known: dict[str, tuple[int, ...]] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [pieces(t) for t in texts]
        new, long, size = {p for ps in cut for p in ps if p not in self.known}, {}, 0
        batch: list[str] = []
        for p in new:
            batch.append(p)
            size += len(p)
            if size >= GROUP // 4:  # what the library makes of a piece is many times its size
                self.learn(batch, long)
                batch, size = [], 0
        self.learn(batch, long)
        known = self.known
        ids = [np.fromiter(chain.from_iterable(known[p] if p in known else long[p] for p in ps) if long else
                           chain.from_iterable(map(known.__getitem__, ps)), np.int32) for ps in cut]
        if len(known) > REMEMBERED:
            known.clear()
        return ids

    def learn(self, batch: list[str], long: dict[str, np.ndarray]) -> None:
        for p, e in zip(batch, self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)):
            if len(p) <= SHORT:
                self.known[p] = tuple(e.ids)
            else:
                long[p] = np.array(e.ids, np.int32)


def token_bytes(definition: str) -> dict[int, bytes]:
    """The bytes of each id, by the byte table reversed; added tokens stand for their text."""
    byte = {c: b for b, c in enumerate(byte_characters())}
    made = Tokenizer.from_str(definition)
    added = made.get_added_tokens_decoder()
    return {i: t.encode() if i in added else bytes(byte[c] for c in t) for t, i in made.get_vocab().items()}


def offsets_of(text: str, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code point offsets [start, end) of tokens of so many bytes. A token that begins or ends inside a character
    covers that character."""
    point = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)  # characters begun, by byte
    ends = np.cumsum(lengths)
    return point[ends - lengths] - 1, point[ends - 1]


def listed(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else [], kind))


def encode_batches(batches: Iterator[pa.RecordBatch], definition: Broadcast, digest: str, column: str, keep: list[str],
                   offsets: bool) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(definition.value, built(digest, "encoder", lambda: encoder_of(definition.value)))
    lengths = built(digest, "lengths", lambda: np.array([len(b) for _, b in sorted(token_bytes(definition.value).items())])) if offsets else None
    for batch in batches:
        for part in sliced(batch, pc.binary_length(batch.column(column)), GROUP):
            texts = [t or "" for t in part.column(column).to_pylist()]
            ids = encoder.encode(texts)
            made = [listed(ids, pa.int32())]
            if offsets:
                both = [offsets_of(t, lengths[x]) if len(x) else (x, x) for t, x in zip(texts, ids)]
                made += [listed([b[i] for b in both], pa.int32()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *made], [*keep, "ids", "starts", "ends"][:len(keep) + len(made)])


def encode(docs: DataFrame, definition: str, column: str = "text", offsets: bool = False,
           keep: list[str] | None = None) -> DataFrame:
    """Adds ``ids`` (array of int), and with ``offsets`` also ``starts`` and ``ends``, to each row.

    ``definition`` is the JSON of a byte-level tokenizer of the tokenizers library (see ``tokenizer_from_ranks``); it is
    broadcast, and its size is that of a vocabulary whatever the data. Whole texts are encoded, without special
    tokens: a worker cuts them at spaces that no match of the pattern crosses, and long pieces before marks too, and
    encodes each distinct piece once, remembering those of at most 80 characters, 100,000 at most, until its task
    ends. Texts are handled in slices of about a million bytes; a longer text, or one without any such place, is handled
    whole, in memory that grows with its length. Offsets are code points of the text; byte lengths of tokens are mapped to characters,
    and a token that begins or ends inside a character covers it.

    ``keep`` names the columns to carry on (all by default); columns named as the added ones are replaced. A null text
    is an empty one, which has no ids. An empty table stays empty. There is no shuffle.
    """
    added = ["ids", "starts", "ends"][:3 if offsets else 1]
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in added]
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in added)])
    shared, digest = docs.sparkSession.sparkContext.broadcast(definition), hashlib.md5(definition.encode()).hexdigest()
    return docs.select(*dict.fromkeys([*keep, column])).mapInArrow(
        lambda batches: tidied(encode_batches(batches, shared, digest, column, keep, offsets), keeps=True), schema)


def decode_batches(batches: Iterator[pa.RecordBatch], definition: Broadcast, digest: str, column: str, keep: list[str],
                   as_text: bool) -> Iterator[pa.RecordBatch]:
    table = built(digest, "bytes", lambda: token_bytes(definition.value))
    for batch in (part for whole in batches for part in sliced(whole, whole.column(column).value_lengths(), GROUP)):
        lists = batch.column(column)
        values, at, made = lists.flatten().to_numpy(zero_copy_only=False), 0, []
        for n in lists.value_lengths().to_pylist():
            if n is None:
                made.append(None)
                continue
            made.append(b"".join(map(table.__getitem__, values[at:at + n].tolist())))
            at += n
        out = pa.array([x if x is None else x.decode("utf-8", "replace") for x in made], pa.string()) if as_text else pa.array(made, pa.binary())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), out], [*keep, "decoded"])


def decode(rows: DataFrame, definition: str, column: str = "ids", as_text: bool = False,
           keep: list[str] | None = None) -> DataFrame:
    """Adds ``decoded``, the bytes that the ids of ``column`` stand for.

    With ``as_text`` they are read as UTF-8, where ids that hold only part of a character give U+FFFD. Bytes come from
    the reversed byte table, so joining the bytes of split characters restores them. Null ids give null, no ids nothing;
    an unknown id fails. ``keep`` is as in ``encode``; a column ``decoded`` is replaced. An empty table stays empty.
    """
    keep = [c for c in (rows.columns if keep is None else keep) if c.lower() != "decoded"]
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField("decoded", T.StringType() if as_text else T.BinaryType())])
    shared, digest = rows.sparkSession.sparkContext.broadcast(definition), hashlib.md5(definition.encode()).hexdigest()
    return rows.select(*dict.fromkeys([*keep, column])).mapInArrow(
        lambda batches: tidied(decode_batches(batches, shared, digest, column, keep, as_text), keeps=True), schema)
