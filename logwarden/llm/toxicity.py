"""Toxic text by compression distance between two zstandard dictionaries."""

from __future__ import annotations

import math
import string
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logwarden.llm.learning import best_cut, fit_logistic, labelled_sample, remainder, sigmoid

#: For bytes.translate: A-Z in lower case, every other ASCII byte but a-z a space.
LETTER_BYTES = bytes(b if b >= 128 or chr(b) in string.ascii_lowercase else b + 32 if chr(b) in string.ascii_uppercase else 32
                     for b in range(256))
#: A window, and how far the next reaches back so that a word at an edge is whole in one of them.
WINDOW, OVERLAP = 80, 12
#: Both dictionaries end with these bytes and every window starts with them, so each window has a match, and what a
#: further match saves is seen in full.
MARK = bytes(range(1, 17))
#: The score from which a document is called toxic; scores are calibrated to it.
CUT = 0.7
#: Byte gains counted as features.
GAINS = range(1, 8)


@dataclass(frozen=True)
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray


def normal(text: bytes) -> bytes:
    return b" " + b" ".join(text.translate(LETTER_BYTES).split()) + b" "


def windows(text: bytes) -> list[bytes]:
    """The whole normalised text in overlapping windows; at least one."""
    text = normal(text)
    return [text[i:i + WINDOW] for i in range(0, max(1, len(text) - OVERLAP), WINDOW - OVERLAP)]


def segments(word: bytes) -> Iterator[bytes]:
    """What a dictionary may hold of a word: the word, and its beginnings of four to nine bytes."""
    if len(word) >= 4:
        yield b" " + word + b" "
    for k in range(4, min(10, len(word))):
        yield b" " + word[:k]


def telling(ours: list[bytes], others: list[bytes], at_least: float, limit: int, ratio: float) -> list[bytes]:
    """Segments that set the texts ``ours`` apart from ``others``, the most telling last.

    A segment counts once for each different word before it, so copies of a text add nothing. It must be ``ratio``
    times as frequent as in the others, by a log-likelihood ratio of ``at_least``; of segments that begin each other
    the most telling one stays.
    """
    seen: Counter = Counter()
    for text in ours:
        seen.update({s for w in set(text.split()) for s in segments(w)})
    wanted = {s for s, n in seen.items() if n >= 3}
    del seen

    def contexts(texts: Iterable[bytes]) -> tuple[dict[bytes, int], int]:
        before, words = defaultdict(set), 0
        for text in texts:
            last = b""
            for w in text.split():
                for s in segments(w):
                    if s in wanted:
                        before[s].add(hash(last))
                last = w
                words += 1
        return {s: len(b) for s, b in before.items()}, max(1, words)

    (a, na), (b, nb) = contexts(ours), contexts(others)
    weight = {}
    for s, x in a.items():
        y = b.get(s, 0)
        if x >= 3 and x / na >= ratio * (y + 0.5) / nb:
            share = (x + y) / (na + nb)
            weight[s] = 2 * (x * math.log(x / (na * share)) + (y * math.log(y / (nb * share)) if y else 0))
    out: list[bytes] = []
    for s in sorted((s for s in weight if weight[s] >= at_least), key=lambda s: (-weight[s], -len(s), s)):
        if not any(s.startswith(o) or o.startswith(s) for o in out):
            out.append(s)
        if len(out) == limit:
            break
    return out[::-1]


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """Contents of the ordinary and the toxic dictionary, of equal length.

    Both hold the most frequent words of ordinary text, then what sets their own class apart, then the mark. With the
    same words at the same distance, prose compresses alike with both.
    """
    toxic, ordinary = [normal(t) for t in toxic], [normal(t) for t in ordinary]
    count = Counter(w for t in ordinary for w in set(t.split()))
    shared = b" ".join(sorted((w for w, _ in count.most_common(500)), key=lambda w: (count[w], w))) + b" "
    ours = b"".join(telling(toxic, ordinary, 16, 64, 4))
    theirs = b"".join(telling(ordinary, toxic, 5, 400, 2)) or b" "
    theirs = (theirs * (1 + len(ours) // len(theirs)))[:len(ours)]
    return shared + theirs + MARK, shared + ours + MARK


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    """Greedy matches of four bytes or more; sizes without frame extras."""
    how = zstandard.ZstdCompressionParameters(
        window_log=14, chain_log=14, hash_log=15, search_log=4, min_match=4, target_length=8, strategy=zstandard.STRATEGY_GREEDY,
        write_content_size=False, write_checksum=False, write_dict_id=False)
    made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    made.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(compression_params=how, dict_data=made)


class Gauge:
    """Features of a text: how many bytes the toxic dictionary saves in its windows against the ordinary one."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.plain, self.toxic = compressor(ordinary).compress, compressor(toxic).compress

    def features(self, text: bytes) -> list[float]:
        plain, toxic = self.plain, self.toxic
        saved = np.array([len(plain(MARK + w)) - len(toxic(MARK + w)) for w in windows(text)])
        n = len(saved)
        over = np.array([np.count_nonzero(saved >= g) for g in GAINS])
        top = np.sort(saved)[-3:]
        return [*(over / n), *np.log1p(over), float(top[-1]), float(top.mean()), float(saved.mean()), math.log(n)]


def fit(texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> ToxicityModel | None:
    """Dictionaries and a calibrated score from labelled texts; None if a class is missing.

    A logistic fit on the window features is shifted so that the best threshold on the training rows becomes CUT.
    """
    if len(set(y.tolist())) < 2:
        return None
    ordinary, toxic = dictionaries([t for t, v in zip(texts, y) if v], [t for t, v in zip(texts, y) if not v])
    gauge = Gauge(ordinary, toxic)
    x = np.array([gauge.features(t) for t in texts])
    mean, deviation = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = (x - mean) / deviation
    weights = fit_logistic(z, y, weight, ridge=1e-4 * weight.sum())
    cut = np.clip(best_cut(sigmoid(np.column_stack([z, np.ones(len(z))]) @ weights), y, weight), 0.05, 0.95)
    weights[-1] += math.log(CUT / (1 - CUT)) - math.log(cut / (1 - cut))
    return ToxicityModel(ordinary, toxic, mean, deviation, weights)


def score_batches(batches: Iterator[pa.RecordBatch], shared: Broadcast, keep: list[str]) -> Iterator[pa.RecordBatch]:
    model: ToxicityModel = shared.value
    gauge = Gauge(model.ordinary, model.toxic)
    for batch in batches:
        x = np.array([gauge.features(t.as_py() or b"") for t in batch.column("text").cast(pa.binary())]).reshape(batch.num_rows, len(model.mean))
        z = np.column_stack([(x - model.mean) / model.deviation, np.ones(batch.num_rows)])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sigmoid(z @ model.weights), pa.float64())], [*keep, "score"])


def train_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 2000, max_chars: int = 20_000) -> ToxicityModel | None:
    """Trains on a bounded sample: ``per_class`` labels of each value, without texts over ``max_chars`` code points.

    Learns only from ids whose remainder modulo 3 is not 1. The bound is that of a class's sample, whatever the data;
    the sample comes to the driver, which trains in seconds.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.length("text") <= max_chars)
    sample = labelled_sample(texts, labels, "toxic", remainder(F.col("doc_id"), 3) != 1, per_class)
    rows = sorted((r.doc_id, r.text, r.y, r.weight) for r in sample.dropDuplicates(["doc_id"]).collect())
    return fit([r[1].encode() for r in rows], np.array([r[2] for r in rows], float), np.array([r[3] for r in rows]))


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, keep: list[str] | None = None) -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 from 0.7 on) to each document, from its whole text.

    Each window of the lower-cased letters is compressed with either dictionary; how often and how far the toxic one
    saves bytes is the score's only input. The model is two dictionaries of a few kilobytes, broadcast. There is no
    shuffle. Null, empty and letterless texts are one empty window and have that window's score. Without a model (no
    label of one class) every score is 0. ``keep`` names the columns to carry on; columns named score or predicted are
    replaced; an empty table stays empty.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("score", "predicted")]
    if model is None:
        scored = docs.select(*(f"`{c}`" for c in keep), F.lit(0.0).alias("score"))
    else:
        schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("score", T.DoubleType())])
        shared = docs.sparkSession.sparkContext.broadcast(model)
        scored = docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(lambda batches: score_batches(batches, shared, keep), schema)
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
