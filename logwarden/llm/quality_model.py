"""Text quality from random-indexing word vectors and a small numpy network."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logwarden.llm.learning import labelled_sample, remainder, sigmoid

#: Words in the sense of the vectors: runs of letters, of digits, and of anything else between blanks.
TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\sA-Za-z0-9\x80-\xff]+")
#: Words fall into so many slots by their hash; a slot has one vector of so many dimensions.
SLOTS, DIMENSIONS = 1 << 14, 32
#: Neighbours on either side, and dimensions in which a word's index vector is not zero.
REACH, NONZERO = 2, 2
#: Tokens handled at once.
CHUNK = 1 << 18
#: Scores from which a document is called good.
CUT = 0.3
HIDDEN = 24
#: Length of a pooled vector.
POOLED = 2 * DIMENSIONS + 2


def slots_of(text: bytes) -> np.ndarray:
    return np.fromiter(map(crc32, TOKEN.findall(text)), np.int64) & (SLOTS - 1)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the index vector of each slot, from a fixed seed."""
    rnd = np.random.default_rng(20)
    places = rnd.permuted(np.tile(np.arange(DIMENSIONS), (SLOTS, 1)), axis=1)[:, :NONZERO]
    return places, rnd.choice(np.array([-1.0, 1.0]), (SLOTS, NONZERO))


def add_contexts(total: np.ndarray, slots: np.ndarray, ends: np.ndarray, places: np.ndarray, signs: np.ndarray) -> None:
    """Adds to each word's row the index vectors of its neighbours in the same text. ``ends`` numbers the text of a word.

    Texts may be of any length: CHUNK bounds only what is added at once.
    """
    for at in range(0, len(slots), CHUNK):  # each pair belongs to the chunk of its first word
        for far in range(1, REACH + 1):
            b = slots[at + far:at + far + CHUNK]
            near = ends[at:at + len(b)] == ends[at + far:at + far + CHUNK]
            a, b = slots[at:at + len(b)][near], b[near]
            for word, other in ((a, b), (b, a)):
                for k in range(NONZERO):
                    total += np.bincount(word * DIMENSIONS + places[other, k], weights=signs[other, k], minlength=SLOTS * DIMENSIONS)


def context_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partition's context sums: a row for each slot that it has met."""
    places, signs = index_vectors()
    total, waiting, size = np.zeros(SLOTS * DIMENSIONS), [], 0

    def flush() -> None:
        add_contexts(total, np.concatenate(waiting), np.repeat(np.arange(len(waiting)), list(map(len, waiting))), places, signs)

    for batch in batches:
        for text in batch.column("text").cast(pa.binary()):
            waiting.append(slots_of(text.as_py() or b""))
            size += len(waiting[-1])
            if size >= CHUNK:
                flush()
                waiting, size = [], 0
    if waiting:
        flush()
    sums = total.reshape(SLOTS, DIMENSIONS).astype(np.int64)
    met = np.flatnonzero(sums.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(met), *(pa.array(sums[met, i]) for i in range(DIMENSIONS))], ["slot", *(f"d{i}" for i in range(DIMENSIONS))])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit context vectors of all slots, from every text of ``docs``.

    Each partition sums its contexts into one table of fixed size; tables are added by slot as whole numbers, so the
    result does not depend on the order. The sum has SLOTS rows and comes to the driver (4 MB).
    """
    names = [f"d{i}" for i in range(DIMENSIONS)]
    parts = docs.select("text").mapInArrow(context_batches, "slot bigint, " + ", ".join(f"{n} bigint" for n in names))
    rows = parts.groupBy("slot").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
    vectors = np.zeros((SLOTS, DIMENSIONS))
    if rows.num_rows:
        vectors[rows["slot"].to_numpy()] = np.column_stack([rows[n].to_numpy() for n in names])
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(slots: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """A text's mean word vector, the deviation around it by dimension, and how alike neighbouring words are: the mean
    of their products, and the share that are the same."""
    if not len(slots):
        return np.zeros(POOLED, np.float32)
    alike, same = 0.0, 0
    for at in range(0, len(slots) - 1, CHUNK):
        a, b = slots[at:at + CHUNK], slots[at + 1:at + CHUNK + 1]
        a = a[:len(b)]
        alike += float(np.einsum("ij,ij->", vectors[a], vectors[b]))
        same += int(np.count_nonzero(a == b))
    pairs = max(1, len(slots) - 1)
    kinds, n = np.unique(slots, return_counts=True)
    rows, share = vectors[kinds], (n / len(slots))[:, None]
    mean = (rows * share).sum(axis=0)
    spread = np.sqrt(np.maximum((rows * rows * share).sum(axis=0) - mean * mean, 0))
    return np.concatenate([mean, spread, [alike / pairs, same / pairs]]).astype(np.float32)


def pool_batches(batches: Iterator[pa.RecordBatch], shared: Broadcast, keep: list[str], out: str) -> Iterator[pa.RecordBatch]:
    vectors = shared.value
    for batch in batches:
        made = [pooled(slots_of(t.as_py() or b""), vectors) for t in batch.column("text").cast(pa.binary())]
        flat = pa.array(np.concatenate(made) if made else [], pa.float32())
        ends = pa.array(np.arange(len(made) + 1, dtype=np.int32) * POOLED)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.ListArray.from_arrays(ends, flat)], [*keep, out])


def pool_documents(docs: DataFrame, vectors: np.ndarray, keep: list[str], out: str = "pooled") -> DataFrame:
    """Adds the pooled vector of each whole text; that of a text without words is zero."""
    keep = [c for c in keep if c.lower() != out.lower()]
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(out, T.ArrayType(T.FloatType()))])
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(lambda batches: pool_batches(batches, shared, keep, out), schema)


@dataclass(frozen=True)
class Network:
    """Two layers: tanh units, then one logit, divided by the temperature."""
    mean: np.ndarray
    deviation: np.ndarray
    first: np.ndarray
    second: np.ndarray
    temperature: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logit(x) / self.temperature)

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.deviation
        return np.tanh(z @ self.first[:-1] + self.first[-1]) @ self.second[:-1] + self.second[-1]


def train_network(x: np.ndarray, y: np.ndarray, weight: np.ndarray, aside: np.ndarray, steps: int = 1500, decay: float = 1e-3) -> Network:
    """Trains by Adam on the rows that are not set ``aside``, then finds the temperature on those that are."""
    rnd = np.random.default_rng(5)
    mean, deviation = x.mean(axis=0), x.std(axis=0) + 1e-6
    z, t = (x[~aside] - mean) / deviation, y[~aside]
    z1 = np.column_stack([z, np.ones(len(z))])
    chance = weight[~aside] / weight[~aside].sum()
    weights = [rnd.normal(0, 1 / np.sqrt(z1.shape[1]), (z1.shape[1], HIDDEN)), rnd.normal(0, 0.1, HIDDEN + 1)]
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in weights]
    for step in range(1, steps + 1):
        rows = rnd.choice(len(z1), 512, p=chance)
        xs, ts = z1[rows], t[rows]
        h = np.tanh(xs @ weights[0])
        h1 = np.column_stack([h, np.ones(len(h))])
        error = (sigmoid(h1 @ weights[1]) - ts) / len(ts)
        back = np.outer(error, weights[1][:-1]) * (1 - h * h)
        rate = 0.01 * (1 - step / (steps + 1))
        for w, m, g in zip(weights, moments, (xs.T @ back, h1.T @ error)):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.999 * m[1] + 0.001 * g * g
            w -= rate * (m[0] / (1 - 0.9 ** step) / (np.sqrt(m[1] / (1 - 0.999 ** step)) + 1e-8) + decay * w)
    plain = Network(mean, deviation, weights[0], weights[1], 1.0)
    logit, truth, share = plain.logit(x[aside]), y[aside], weight[aside]
    if not len(truth):
        return plain
    loss = lambda t: float(share @ (np.logaddexp(0, logit / t) - truth * logit / t))
    temperature = min(np.exp(np.linspace(np.log(0.25), np.log(8), 141)), key=loss)
    return Network(mean, deviation, weights[0], weights[1], float(temperature))


def train_quality(pooled_rows: DataFrame, labels: DataFrame, per_class: int = 10_000) -> Network | None:
    """Trains on a bounded sample of pooled vectors, ``per_class`` labels of each value at most; None without both values.

    Learns only from ids whose remainder modulo 5 is not 0, and sets those with remainder 1 aside for the temperature.
    Of ``pooled_rows`` only doc_id and pooled are read, so no other column's name can clash.
    """
    learn = remainder(F.col("doc_id"), 5)
    rows = labelled_sample(pooled_rows.select("doc_id", "pooled"), labels, "quality", learn != 0, per_class).withColumn("aside", learn == 1)
    rows = rows.dropDuplicates(["doc_id"]).orderBy("doc_id").toArrow()
    y = rows["y"].to_numpy().astype(float)
    if len(set(y.tolist())) < 2:
        return None
    x = rows["pooled"].combine_chunks().flatten().to_numpy().reshape(len(y), -1).astype(float)
    aside = rows["aside"].to_numpy(zero_copy_only=False).astype(bool)
    weight = rows["weight"].to_numpy()
    return train_network(x, y, weight, aside if (~aside).sum() and len(set(y[~aside].tolist())) == 2 else np.zeros(len(y), bool))


def network_batches(batches: Iterator[pa.RecordBatch], model: Network, keep: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = batch.column("pooled").flatten().to_numpy().reshape(batch.num_rows, -1).astype(float)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(model.probability(x) if len(x) else [], pa.float64())], [*keep, "score"])


def score_quality(pooled_rows: DataFrame, model: Network | None, keep: list[str]) -> DataFrame:
    """Adds ``score`` (probability of label 1) and ``predicted`` (1 from 0.3 on) to pooled documents.

    A text without words has the score of the zero vector. Without a model (no label of one value) every score is 1,
    so nothing is called bad. Columns named score or predicted are replaced; an empty table stays empty.
    """
    keep = [c for c in keep if c.lower() not in ("score", "predicted")]
    if model is None:
        scored = pooled_rows.select(*(f"`{c}`" for c in keep), F.lit(1.0).alias("score"))
    else:
        schema = T.StructType([*(pooled_rows.schema[c] for c in keep), T.StructField("score", T.DoubleType())])
        scored = pooled_rows.mapInArrow(lambda batches: network_batches(batches, model, keep), schema)
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
