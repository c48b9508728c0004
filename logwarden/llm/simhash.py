"""Near duplicates by SimHash fingerprints, compared exactly in tiles."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logwarden.llm.common import fresh, sliced, staged, tidied
from logwarden.llm.components import connected_components

BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
BYTE_PLACES = (np.arange(8) * 256).astype(np.int64)
#: Shingles counted, and bytes of text passed back, at once.
CHUNK, SLICE = 1 << 16, 4_000_000


def fingerprint(text: bytes, shingle: int) -> int:
    """The SimHash of word shingles: a bit is set where over half of the shingles' hashes have it."""
    words = text.lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    starts = np.cumsum([0, *(len(w) + 1 for w in words)])
    begin, end = starts[:n].tolist(), (starts[min(shingle, len(words)):] - 1).tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros((8, 8), np.int64)
    for at in range(0, n, CHUNK):
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(begin[at:at + CHUNK], end[at:at + CHUNK])], np.uint64)
        places = hashes.astype("<u8").view(np.uint8).reshape(-1, 8) + BYTE_PLACES
        counts += np.bincount(places.ravel(), minlength=2048).reshape(8, 256) @ BITS
    return int(np.packbits(2 * counts > n, axis=1, bitorder="little").ravel().view("<i8")[0])


def fingerprint_batches(batches: Iterator[pa.RecordBatch], shingle: int, keep: list[str], out: str) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in sliced(whole, pc.binary_length(whole.column("text")), SLICE)):
        prints = [fingerprint(t.as_py() or b"", shingle) for t in batch.column("text").cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(prints, pa.int64())], [*keep, out])


def fingerprints(docs: DataFrame, shingle: int = 3, out: str = "fingerprint", keep: list[str] | None = None) -> DataFrame:
    """Adds the fingerprint as a signed long: XXH64 with seed 42 of shingles of ``shingle`` words, A-Z in lower case.

    Words are separated by blanks; repeated shingles count as often as they occur; a text of fewer words is one
    shingle, one without words (null, empty or blank) has fingerprint zero. ``keep`` names the columns to carry on; one
    named ``out`` is replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != out.lower()]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(out, T.LongType())])
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(
        lambda batches: tidied(fingerprint_batches(batches, shingle, keep, out)), schema)


def linked(left: np.ndarray, right: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Edges that connect what pairs within ``radius`` connect: of one tile, or between two.

    At most one edge for each fingerprint, however many pairs there are.
    """
    every = left if right is None else np.concatenate([left, right])
    label = np.arange(len(every))
    for i, x in enumerate(left):
        at = i + 1 if right is None else len(left)
        near = np.flatnonzero(np.bitwise_count(every[at:] ^ x) <= radius) + at
        if len(near):
            joined = np.unique(np.append(label[near], label[i]))
            if len(joined) > 1:
                label[np.isin(label, joined)] = joined[0]
    return [(int(every[j]), int(every[i])) for i, j in enumerate(label.tolist()) if i != j]


def link_batches(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        edges = []
        for left, right in zip(batch.column("left"), batch.column("right")):
            right = right.values.to_numpy() if right.is_valid else None
            edges += linked(left.values.to_numpy(), right, radius)
        yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], ["a", "b"])


def block_keys(bits: Column, radius: int) -> Column:
    """Keys of which two fingerprints within ``radius`` share one at least.

    The 64 bits fall into ``radius + 2`` blocks; so many differing bits leave two blocks equal. A key is a pair of
    blocks: its number and the bits of both.
    """
    n = radius + 2
    edges = [64 * i // n for i in range(n + 1)]
    block = [F.shiftrightunsigned(bits, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:])]
    return F.array(*(F.struct(F.lit(k).alias("pair"), (F.shiftleft(block[j], edges[i + 1] - edges[i]).bitwiseOR(block[i])).alias("bits"))
                     for k, (i, j) in enumerate(combinations(range(n), 2))))


def similar_pairs(prints: DataFrame, radius: int = 2, tile: int = 4096) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints (column fp) within ``radius`` differing bits, exactly.

    Fingerprints that share the bits of two blocks are compared; with 16-bit blocks that is one in 2^32 by chance, so
    work grows with the near copies and not with the square of the table. A bucket of up to ``tile`` is one tile. A
    larger one is split by population count and then by hash into tiles, and every pair of its tiles whose population
    counts differ by ``radius`` at most is a row of its own, so no task holds a whole bucket. Each comparison gives at
    most one edge for each fingerprint, never all pairs.
    """
    banded = prints.select("fp", F.explode(block_keys(F.col("fp"), radius)).alias("key"))
    sizes = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    split = F.greatest(F.lit(1), F.ceil(F.col("n") / (4 * tile))).cast("int")
    members = (banded.join(sizes, "key")
               .withColumn("splits", F.when(F.col("n") <= tile, 0).otherwise(split))
               .withColumn("ones", F.when(F.col("splits") == 0, 0).otherwise(F.bit_count("fp")))
               .withColumn("part", F.when(F.col("splits") == 0, 0).otherwise(F.pmod(F.xxhash64("fp"), F.greatest("splits", F.lit(1))).cast("int"))))
    tiles = members.groupBy("key", "splits", "ones", "part").agg(F.collect_list("fp").alias("fps"))
    tiles = staged(tiles, "tiles")
    none = F.lit(None).cast("array<bigint>")
    own = tiles.filter(F.size("fps") > 1).select(F.col("fps").alias("left"), none.alias("right"))

    me = F.struct("ones", "part")
    others = F.flatten(F.transform(F.sequence(F.col("ones") - radius, F.col("ones") + radius), lambda o: F.transform(
        F.sequence(F.lit(0), F.col("splits") - 1), lambda p: F.struct(o.alias("ones"), p.alias("part")))))
    pair = (tiles.filter("splits > 0").select("key", me.alias("me"), "fps", F.explode(others).alias("other"))
            .filter(F.col("me") != F.col("other"))
            .groupBy("key", F.least("me", "other").alias("low"), F.greatest("me", "other").alias("high"))
            .agg(F.min_by("fps", "me").alias("left"), F.max_by("fps", "me").alias("right"), F.count(F.lit(1)).alias("n"))
            .filter("n = 2").select("left", "right"))
    return own.unionByName(pair).mapInArrow(lambda batches: tidied(link_batches(batches, radius)), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, out: str = "group",
                    keep: list[str] | None = None) -> DataFrame:
    """Adds the struct ``out`` (fingerprint, component_id, first) to each document.

    Documents whose fingerprints differ in ``radius`` bits or fewer are linked, and links are followed:
    ``component_id`` is the smallest doc_id that can be reached, ``first`` marks one row of each component, with that
    id. Fingerprints are written once with the kept columns; equal ones become one row before anything is compared,
    so exact copies, however many, cost one fingerprint.

    Texts without words have fingerprint zero and are linked like any other. Rows that repeat an id share a component
    if their texts do, and one of them is the first. Rows without an id take part but name a component only if it has
    no id at all (null). An empty table stays empty. ``keep`` is as in ``fingerprints``; a column named ``out`` is
    replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != out.lower()]
    fp, row, of_fp, best = (fresh(docs, x) for x in ("fp", "row", "of_fp", "best"))
    cols = list(dict.fromkeys([*keep, "doc_id"]))
    rows = staged(fingerprints(docs, shingle, fp, cols).withColumn(row, F.monotonically_increasing_id()), "fingerprints")
    groups = components_of(rows.select("doc_id", F.col(fp).alias("fp"), F.col(row).alias("row")), radius)
    found = groups.select(F.col("fp").alias(of_fp), F.col("best").alias(best))
    fields = F.struct(F.col(fp).alias("fingerprint"), F.col(best)["doc_id"].alias("component_id"), (F.col(row) == F.col(best)["row"]).alias("first"))
    return rows.join(found, F.col(fp) == F.col(of_fp)).select(*(f"`{c}`" for c in keep), fields.alias(out))


def components_of(rows: DataFrame, radius: int) -> DataFrame:
    """(fp, best) for each distinct fingerprint of rows (doc_id, fp, row): best is the smallest (doc_id, row) of its component."""
    who = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id"), F.col("row"))
    prints = staged(rows.groupBy("fp").agg(F.min(who).alias("best")), "prints")
    roots = connected_components(similar_pairs(prints, radius))
    members = roots.select(F.col("node").alias("fp"), "root").unionByName(roots.select(F.col("root").alias("fp"), "root").distinct())
    best = members.join(prints, "fp").groupBy("root").agg(F.min("best").alias("joint"))
    joint = members.join(best, "root").select("fp", "joint")
    # Written, so that the join back to the documents splits the partition of a fingerprint that very many have.
    return staged(prints.join(joint, "fp", "left").select("fp", F.coalesce("joint", "best").alias("best")), "groups")


def first_of_each(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """One document of each component, that with the smallest id, with the columns of ``docs``."""
    fp, row = fresh(docs, "fp"), fresh(docs, "row")
    rows = staged(fingerprints(docs, shingle, fp).withColumn(row, F.monotonically_increasing_id()), "fingerprints")
    groups = components_of(rows.select("doc_id", F.col(fp).alias("fp"), F.col(row).alias("row")), radius)
    firsts = groups.select(F.col("best.row").alias(row)).distinct()  # as many as components
    return rows.join(firsts, row, "left_semi").select(*(f"`{c}`" for c in docs.columns))
