"""Collocations: phrases whose words stand together more often than their parts alone would, counted in tiles of ranked ids."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwarden.llm.common import sliced, staged, tidied

BREAKS = ".,;:!?\n\x0b\x0c\r"
BREAK = re.compile(rb"[ \t.,;:!?\n\x0b\x0c\r]")
#: For bytes.translate: A-Z to lower case, an end of a piece to a new line, a tab to a space.
PIECE_BYTES = bytes(10 if chr(b) in BREAKS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Stands between pieces; lower-cased words never hold it.
EDGE = b"A"

#: Ranked words, and ranked phrases of one length, at most, over all languages: what tasks are sent.
HEAD = 1 << 16
#: A tile has SIDE x SIDE cells. A task holds at most DENSE tiles as arrays; one becomes such an array when a chunk has a
#: pair for every 64 of its cells.
SIDE, DENSE = 1 << 10, 4
#: Bits that tell tasks which words and phrases may reach the least count.
BITS = 1 << 26
#: Bytes of text cut into words and taken from a batch at once; entries that a task holds before it merges them, words it remembers, languages it has open.
CHUNK, SLICE, HELD, REMEMBERED, OPEN = 1_000_000, 4_000_000, 500_000, 60_000, 64
ADDRESS = 1 << 62
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


# -- texts to words to numbers --------------------------------------------------------------------------------

def word_chunks(text: bytes) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """The words of a text, an EDGE between pieces, from about CHUNK bytes at a time: as numbers into the list of different
    words. No word is cut."""
    at = 0
    while at < len(text):
        cut = BREAK.search(text, at + CHUNK)
        end = cut.start() if cut else len(text)
        part = text[at:end].translate(PIECE_BYTES).replace(b"\n", b" A ")
        words = pc.ascii_split_whitespace(pa.array([part], pa.large_binary()).cast(pa.large_string())).values.dictionary_encode()
        numbers, different = words.indices.to_numpy(), words.dictionary.cast(pa.large_binary()).to_pylist()
        if b"" in different:  # blanks at either end of the part
            numbers = numbers[numbers != different.index(b"")]
        yield numbers, different
        at = end


def by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """The texts of a batch, in slices; those of a slice and language as one with new lines between."""
    for part in sliced(batch, pc.binary_length(batch.column("text")), SLICE):
        texts = defaultdict(list)
        for lang, text in zip(part.column("lang").to_pylist(), part.column("text").cast(pa.binary())):
            texts[lang].append(text.as_py() or b"")
        while texts:
            lang, own = texts.popitem()
            yield lang, b"\n".join(own)


def count_word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, dict[bytes, int]] = defaultdict(lambda: defaultdict(int))

    def result() -> Iterator[pa.RecordBatch]:
        for lang, own in counts.items():
            for none in (EDGE, b""):
                own.pop(none, None)
            words = pa.array(list(own), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(own)), words, pa.array(list(own.values()), pa.int64())], ["lang", "word", "f"])

    for batch in batches:
        for lang, text in by_language(batch):
            for numbers, words in word_chunks(text):
                own = counts[lang]
                for word, n in zip(words, np.bincount(numbers, minlength=len(words)).tolist()):
                    own[word] += n
                if sum(map(len, counts.values())) > REMEMBERED:
                    yield from result()
                    counts.clear()
    yield from result()


class Numbers(dict):
    """Word to number in one language: the rank of a ranked word, the address of another that may reach the least count, else -1."""

    def __init__(self, ranks: dict[bytes, int], salt: bytes, bits: bytes, room: list[int]):
        super().__init__(ranks)
        self[EDGE] = -1
        self.salt, self.bits, self.room = salt, bits, room

    def __missing__(self, word: bytes) -> int:
        address = xxhash.xxh64_intdigest(self.salt + word, 42) % ADDRESS | ADDRESS
        bit = address % BITS
        number = address if self.bits[bit >> 3] >> (bit & 7) & 1 else -1
        if self.room[0] > 0 and len(word) <= 32:
            self.room[0] -= 1
            self[word] = number
        return number


def phrase_bits(columns: list[np.ndarray]) -> np.ndarray:
    """The bit, below BITS, of each phrase given as columns of numbers."""
    mixed = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        mixed = (mixed ^ c.astype(np.uint64)) * GOLDEN
        mixed ^= mixed >> np.uint64(29)
    return (mixed % np.uint64(BITS)).astype(np.int64)


# -- tiles ----------------------------------------------------------------------------------------------------

def merged(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted coordinates, each once, with the sum of their counts."""
    if len(counts) == 0:
        return columns, counts
    order = np.lexsort(columns[::-1]) if len(columns) > 1 else np.argsort(columns[0])
    columns = [c[order] for c in columns]
    new = np.zeros(len(order), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    return [c[first] for c in columns], np.add.reduceat(counts[order], first)


class Sorted:
    """Counts by sorted coordinates, for cells that are mostly empty."""

    def __init__(self, width: int):
        self.width, self.parts, self.size = width, [], 0

    def add(self, columns: list[np.ndarray]) -> None:
        if len(columns[0]):
            self.parts.append(merged(columns, np.ones(len(columns[0]), np.int64)))
            self.size += len(self.parts[-1][1])

    def take(self) -> tuple[list[np.ndarray], np.ndarray]:
        columns = [np.concatenate([p[0][i] for p in self.parts]) if self.parts else np.zeros(0, np.int64) for i in range(self.width)]
        counts = np.concatenate([p[1] for p in self.parts]) if self.parts else np.zeros(0, np.int64)
        self.parts, self.size = [], 0
        return merged(columns, counts)

    def merge(self) -> int:
        self.parts = [self.take()]
        self.size = len(self.parts[0][1])
        return self.size


class Tiles:
    """Counts of pairs (left rank, right rank): full tiles as arrays by direct address, the others as sorted coordinates."""

    def __init__(self, room: list[int]):
        self.room, self.dense, self.sparse = room, {}, Sorted(1)
        self.across = HEAD // SIDE
        self.is_dense = np.zeros(self.across ** 2, bool)

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        tile = left // SIDE * self.across + right // SIDE
        sizes = np.bincount(tile, minlength=len(self.is_dense))
        for t in np.flatnonzero((sizes >= SIDE * SIDE // 64) & ~self.is_dense).tolist():
            if self.room[0] > 0:
                self.room[0] -= 1
                self.dense[t], self.is_dense[t] = np.zeros(SIDE * SIDE, np.int64), True
        for t, cells in self.dense.items():
            if sizes[t]:
                own = tile == t
                cells += np.bincount(left[own] % SIDE * SIDE + right[own] % SIDE, minlength=SIDE * SIDE)
        rest = ~self.is_dense[tile]
        self.sparse.add([left[rest] * HEAD + right[rest]])

    def take(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(left, right, counts) of the sorted coordinates, which are held no more."""
        (code,), counts = self.sparse.take()
        yield code // HEAD, code % HEAD, counts

    def take_dense(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The same of the arrays: their cells that are not zero."""
        for t, cells in self.dense.items():
            at = np.flatnonzero(cells)
            yield t // self.across * SIDE + at // SIDE, t % self.across * SIDE + at % SIDE, cells[at]
        self.room[0] += len(self.dense)
        self.dense, self.is_dense = {}, np.zeros(self.across ** 2, bool)


# -- counting phrases of one length ---------------------------------------------------------------------------

def count_phrase_batches(batches: Iterator[pa.RecordBatch], shared: Broadcast, length: int) -> Iterator[pa.RecordBatch]:
    """(lang, w1 .. wk, f): partial counts of phrases of ``length`` words, all of whose parts may reach the least count.

    ``shared`` has the salt of addresses, the ranks and bits of words, and for each shorter length the ranked phrases
    (for each language the sorted codes, their ranks and, by rank, their words) and the bits.
    """
    salt, ranks, word_bits, levels = shared.value
    bits = [np.frombuffer(b, np.uint8) for _, b in levels]
    numbers: dict[str, Numbers] = {}
    tiles: dict[str, Tiles] = {}
    tails: dict[str, Sorted] = {}
    room, words_room = [DENSE], [REMEMBERED]
    names = ["lang", *(f"w{i + 1}" for i in range(length)), "f"]

    def rows(lang: str, columns: list[np.ndarray], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(counts), 100_000):
            part = [pa.array(c[at:at + 100_000], pa.int64()) for c in (*columns, counts)]
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(part[-1])), *part], names)

    def cells(lang: str, taken: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for left, right, counts in taken:
            words = levels[-1][0][lang][2][left] if levels and len(left) else left[:, None]
            yield from rows(lang, [*(words[:, i] for i in range(words.shape[1])), right], counts)

    def sparse() -> Iterator[pa.RecordBatch]:
        for lang in numbers:
            yield from cells(lang, tiles[lang].take())
            yield from rows(lang, *tails[lang].take())

    def result() -> Iterator[pa.RecordBatch]:
        yield from sparse()
        for lang in numbers:
            yield from cells(lang, tiles[lang].take_dense())

    def add(lang: str, arr: np.ndarray) -> None:
        ranked = np.where(arr < HEAD, arr, -1)
        ok, left = arr >= 0, ranked
        for m, (heads, _) in enumerate(levels, 2):
            ok, nxt = ok[:-1] & ok[1:], ranked[m - 1:]
            at = np.flatnonzero(ok)
            bit = phrase_bits([arr[at + j] for j in range(m)])
            ok[at] = bits[m - 2][bit >> 3] >> (bit & 7).astype(np.uint8) & 1 == 1
            found = np.full(len(ok), -1)
            if lang in heads:
                codes, order, _words = heads[lang]
                both = np.flatnonzero(ok & (left[:-1] >= 0) & (nxt >= 0))
                code = left[both] * HEAD + nxt[both]
                place = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                found[both] = np.where(codes[place] == code, order[place], -1)
            left = found
        ok = ok[:-1] & ok[1:]
        at = np.flatnonzero(ok)
        a, b = left[at], ranked[at + length - 1]
        both = (a >= 0) & (b >= 0)
        tiles[lang].add(a[both], b[both])
        rest = at[~both]
        tails[lang].add([arr[rest + j] for j in range(length)])

    for batch in batches:
        for lang, text in by_language(batch):
            if lang not in numbers:
                if len(numbers) >= OPEN:  # begin anew
                    yield from result()
                    numbers.clear(), tiles.clear(), tails.clear()
                    words_room[0] = REMEMBERED
                numbers[lang], tiles[lang], tails[lang] = Numbers(ranks.get(lang, {}), salt, word_bits, words_room), Tiles(room), Sorted(length)
            carry = np.zeros(0, np.int64)
            for places, words in word_chunks(text):
                known = np.fromiter(map(numbers[lang].__getitem__, words), np.int64, len(words))
                arr = np.concatenate([carry, known[places]])
                if len(arr) >= length:
                    add(lang, arr)
                carry = arr[-(length - 1):]
                held = [*(t.sparse for t in tiles.values()), *tails.values()]
                if sum(h.size for h in held) > HELD and sum(h.merge() for h in held) > HELD // 2:
                    yield from sparse()
    yield from result()


# -- tables ---------------------------------------------------------------------------------------------------

def address(word: Column, salt: str) -> Column:
    """As Numbers has it."""
    return F.xxhash64(F.concat(F.lit(salt), word)).bitwiseAND(F.lit(ADDRESS - 1)).bitwiseOR(F.lit(ADDRESS))


def clear_salt(words: DataFrame, least: int) -> str:
    """A salt under which no word of ``least`` occurrences or more shares its address with any other word of its language.

    So counting by address is counting by word.
    """
    for attempt in count():
        salt = str(attempt) if attempt else ""
        shared = words.groupBy("lang", address(F.col("word"), salt).alias("at")).agg(F.count(F.lit(1)).alias("n"), F.max("f").alias("most"))
        if shared.filter((F.col("n") > 1) & (F.col("most") >= least)).isEmpty():
            return salt


def most_frequent(rows: DataFrame, limit: int) -> DataFrame:
    """As many of the most frequent rows (column f) as ``limit`` has room for, by steps of a sixteenth of an octave."""
    step = F.floor(F.log2("f") * 16).cast("int")
    cut, room = None, limit
    for s, n in sorted(((r[0], r[1]) for r in rows.groupBy(step).count().collect()), reverse=True):
        if n > room:
            break
        cut, room = s, room - n
    return rows.filter(F.lit(False) if cut is None else step >= cut)


def bits_of(bit: DataFrame) -> bytes:
    """Numbers below BITS (column bit) as a bit array. What reaches the driver is BITS / 8 bytes at most."""
    parts = (bit.select((F.col("bit") + 1).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("part"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")))
    whole = bytearray(BITS // 8)
    for row in parts.toLocalIterator():
        at = (row["part"] - 1) * 4096
        whole[at:at + 4096] = row["bits"]
    return bytes(whole)


def phrase_bit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bit = phrase_bits([c.to_numpy() for c in batch.columns])
        yield pa.RecordBatch.from_arrays([pa.array(bit, pa.int64())], ["bit"])


def first_level(words: DataFrame, salt: str, least: int) -> tuple[DataFrame, dict[str, dict[bytes, int]], bytes]:
    """The words that reach ``least`` as phrases of length one; the ranks by language, the bits of the others."""
    vocabulary = words.filter(F.col("f") >= least)
    ranked = staged(most_frequent(vocabulary, HEAD).select("lang", "word", (F.row_number().over(
        Window.partitionBy("lang").orderBy(F.desc("f"), "word")) - 1).cast("bigint").alias("rank")), "ranked-words")  # HEAD rows at most
    coded = vocabulary.join(F.broadcast(ranked), ["lang", "word"], "left").withColumn("w1", F.coalesce("rank", address(F.col("word"), salt)))
    table = staged(coded.select("lang", "w1", "f", F.col("word").alias("phrase"), F.col("word").alias("last"),
                                F.array("f").alias("heads"), F.array("f").alias("tails")), "words")
    ranks: dict[str, dict[bytes, int]] = defaultdict(dict)
    for lang, word, rank in ranked.collect():
        ranks[lang][word.encode()] = rank
    tail = table.filter(F.col("w1") >= HEAD).select((F.col("w1") % BITS).alias("bit"))
    return table, dict(ranks), bits_of(tail)


def ranked_phrases(table: DataFrame, length: int, before: dict | None) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The most frequent phrases of ranked words, re-ranked: by language the sorted codes, their ranks, and words by rank."""
    cols = [f"w{i + 1}" for i in range(length)]
    head = most_frequent(table.filter(F.greatest("w1", *cols) < HEAD), HEAD)
    found = defaultdict(list)
    for row in head.select("lang", *cols, "f").collect():  # HEAD rows at most
        found[row[0]].append((-row[-1], *row[1:-1]))
    out = {}
    for lang, own in found.items():
        words = np.array([r[1:] for r in sorted(own)], np.int64)
        left = words[:, 0]
        if before is not None:
            codes, order, shorter = before.get(lang, (None, None, np.zeros((0, length - 1), np.int64)))
            place = {tuple(w): r for r, w in enumerate(shorter.tolist())}
            known = np.array([place.get(tuple(w[:-1]), -1) for w in words.tolist()], np.int64)
            words, left = words[known >= 0], known[known >= 0]
        code = left * HEAD + words[:, -1]
        order = np.argsort(code)
        if len(code):
            out[lang] = (code[order], order, words)
    return out


def next_level(counted: DataFrame, shorter: DataFrame, length: int) -> DataFrame:
    """Phrases of ``length`` words with their counts, text, and the counts of all that they begin and end with.

    Both halves of a frequent phrase are frequent, so the joins with the phrases that are a word shorter lose none.
    """
    cols, old = [f"w{i + 1}" for i in range(length)], [f"w{i + 1}" for i in range(length - 1)]
    begin = shorter.select("lang", *old, F.col("phrase").alias("begin"), F.col("heads").alias("begin_heads"))
    end = shorter.select("lang", *(F.col(c).alias(f"w{i + 2}") for i, c in enumerate(old)), F.col("last"), F.col("tails").alias("end_tails"))
    rows = counted.join(begin, ["lang", *old]).join(end, ["lang", *cols[1:]])
    return staged(rows.select("lang", *cols, "f", F.concat_ws(" ", "begin", "last").alias("phrase"), "last",
                              F.concat("begin_heads", F.array("f")).alias("heads"), F.concat("end_tails", F.array("f")).alias("tails")), "phrases")


def best_cut(length: int) -> Column:
    """(score, cut) of the cut with the lowest score, the first of equals. Exact up to 10^13 occurrences."""
    def big(c: Column) -> Column:
        return c.cast("decimal(13,0)")

    cuts = [F.struct(F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * big(F.col("f")) * big(F.col("f")),
                                     big(F.col("heads")[j - 1]) * big(F.col("tails")[length - j - 1])).alias("score"),
                     F.lit(j).alias("cut")) for j in range(1, length)]
    return F.array_min(F.array(*cuts))


def candidates(table: DataFrame, longer: DataFrame | None, length: int, percent: int) -> DataFrame:
    """Scored phrases of one length, without those inside a longer one that has ``percent`` of their occurrences."""
    cols = [f"w{i + 1}" for i in range(length)]
    rows = table.withColumn("best", best_cut(length))
    if longer is not None:
        up = [f"w{i + 1}" for i in range(length + 1)]
        around = (longer.select("lang", *cols, F.col("f").alias("around"))
                  .unionByName(longer.select("lang", *(F.col(c).alias(cols[i]) for i, c in enumerate(up[1:])), F.col("f").alias("around")))
                  .groupBy("lang", *cols).agg(F.max("around").alias("around")))
        rows = rows.join(staged(around, "around"), ["lang", *cols], "left").filter(F.col("around").isNull() | (100 * F.col("around") < percent * F.col("f")))
    cut = F.col("best.cut")
    return rows.select("lang", "phrase", F.col("f").alias("a"), F.element_at("heads", cut).alias("l"),
                       F.element_at("tails", F.lit(length) - cut).alias("r"), F.col("best.score").alias("score"))


def first_of_each(rows: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` rows of each language, ranked. Cut down in parts of a language, then in fewer, then whole, so
    that no task sorts more than a 1024th of a language or 32 times ``limit`` rows."""
    order = (F.desc("score"), F.desc("a"), F.col("phrase"))
    part = F.pmod(F.xxhash64("phrase"), F.lit(1024))
    for parts in (1024, 32, 1):
        within = Window.partitionBy("lang", F.pmod(part, F.lit(parts))).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(within).cast("bigint")).filter(F.col("rank") <= limit)
    return rows


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, percent: int = 50, limit: int | None = 2000) -> DataFrame:
    """The phrases of each language of 2 to ``longest`` words that tell most: (lang, rank, phrase, a, l, r, n, score).

    Texts, A-Z in lower case, fall at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those at spaces and tabs into words. A phrase
    is counted everywhere inside pieces; those with a >= ``least`` are candidates. The cut with the lowest
    floor(10^6 a^2 / (l r)), with l and r the counts of its two sides, gives the score. A candidate inside a longer one
    with ``percent`` percent of its occurrences goes. The first ``limit`` of a language, by score, a and phrase, are the
    result (None: all, without rank). n is the number of words of the language; lang null is ``und``.

    Words are counted first. The most frequent get ranks by frequency (2^16 in all, which tasks know); another word that
    reaches ``least`` has a 62-bit address, checked to be no other word's. Phrases of k words are then pairs of a phrase
    of k - 1 and a word. Where both have ranks, a task counts them in tiles of the plane of ranks: full tiles are arrays
    that bincount adds up by direct address, others sorted coordinates, as are phrases with an address. Partial counts are
    summed by Spark; those under ``least`` go, the most frequent phrases are ranked in turn, and the next length begins.
    A phrase is only counted where its parts may reach ``least`` (bits of a fixed size, which let some too many through,
    never too few). Texts are read once for each length; nothing but counts is shuffled.

    Null and empty texts have no words; repeated rows count as often as they are there; other columns are ignored; an
    empty table gives no rows.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    counted = texts.mapInArrow(lambda batches: tidied(count_word_batches(batches)), "lang string, word string, f bigint").groupBy("lang", "word").agg(F.sum("f").alias("f"))
    words = staged(counted, "word-counts")
    salt = clear_salt(words, least)
    table, ranks, word_bits = first_level(words, salt, least)
    tables, levels = [table], []
    for length in range(2, longest + 1):
        cols = [f"w{i + 1}" for i in range(length)]
        shared = docs.sparkSession.sparkContext.broadcast((salt.encode(), ranks, word_bits, list(levels)))
        schema = ", ".join(["lang string", *(f"{c} bigint" for c in cols), "f bigint"])
        partial = texts.mapInArrow(counter(shared, length), schema)
        whole = staged(partial.groupBy("lang", *cols).agg(F.sum("f").alias("f")).filter(F.col("f") >= least), "phrase-counts")
        tables.append(next_level(whole, tables[-1], length))
        if length < longest:
            bit = tables[-1].select(*cols).mapInArrow(phrase_bit_batches, "bit bigint")
            levels.append((ranked_phrases(tables[-1], length, levels[-1][0] if levels else None), bits_of(bit)))
    parts = [candidates(t, tables[k] if k < longest else None, k, percent) for k, t in enumerate(tables[1:], 2)]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    if limit is not None:
        found = first_of_each(found, limit)
    return found.join(totals, "lang").select("lang", *(["rank"] if limit is not None else []), "phrase", "a", "l", "r", "n", "score")


def counter(shared: Broadcast, length: int):
    return lambda batches: tidied(count_phrase_batches(batches, shared, length))
