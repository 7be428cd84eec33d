"""Quality classifier on supervised subword embeddings.

A text is the mean of learned vectors of its hashed words and byte n-grams; a softmax layer on
that mean gives the class.  Vectors and layer are learned together by stochastic gradient descent
in numpy, on a bounded sample of labelled rows.  The difference of the two logits is linear in the
mean, so for scoring every hashed feature is folded to one number, and a text costs one lookup
per feature.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .common import free_name, release, text_of

BUCKET_BITS = 17
GRAMS = (3, 4)  # byte n-grams, over word borders
SAMPLE = 6000  # labelled rows that training sees at most, smallest hashed ids first
DIMENSION = 16
EPOCHS = 6
RATE = 0.5
THRESHOLD = 0.7
HELD_OUT = (4, 2)  # rows whose crc32(id) mod 4 is 2 are never learned from
_SALT = np.uint64(0x9E3779B97F4A7C15)


PIECE = 1 << 19  # bytes of a text whose features are held at once


def pieces(raw: bytes) -> Iterator[tuple[bytes, int]]:
    """A text cut behind spaces, and how many grams of each length may begin in a piece.

    A piece carries the bytes that its last grams reach into.
    """
    low, reach = 0, max(GRAMS) - 1
    while len(raw) - low > PIECE:
        at = low + PIECE
        while at < len(raw) and not raw[at - 1 : at].isspace():
            at += 1
        if at + reach >= len(raw):
            break
        yield raw[low : at + reach], at - low
        low = at
    yield raw[low:], len(raw) - low


def features(texts: list[bytes], own: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of several texts, and the text of each.

    own: of each text, the leading bytes in which a feature may begin.
    """
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    length = size + 1
    joined = b"\n".join(texts) + b"\n"
    begin = np.cumsum(length) - length
    first, _, words = repeats.word_hashes(joined)
    if own is not None:
        good = first < (begin + np.array(own))[np.searchsorted(begin, first, side="right") - 1]
        first, words = first[good], words[good]
    shift = np.uint64(64 - BUCKET_BITS)
    buckets = [(words * _SALT) >> shift]
    owner = [np.searchsorted(begin, first, side="right") - 1]
    raw = np.frombuffer(joined + bytes(8), np.uint8)
    n = len(joined)
    for k in GRAMS:
        value = np.zeros(n, np.uint64)
        for i in range(k):
            value = (value << np.uint64(8)) | raw[i : i + n]
        count = np.maximum(size - k + 1, 0)
        if own is not None:
            count = np.minimum(count, own)
        at = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
        buckets.append(repeats.mixed(value[at] + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> shift)
        owner.append(np.repeat(np.arange(len(texts)), count))
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owner)


class Model(NamedTuple):
    folded: np.ndarray  # one number per bucket: its vector times the difference of the two output rows
    bias: float

    def score(self, texts: list[bytes]) -> np.ndarray:
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        if sum(map(len, texts)) <= 2 * PIECE:
            parts = [(slice(None), texts, None)]
        else:
            parts = ((slice(k, k + 1), [piece], [own]) for k, text in enumerate(texts) for piece, own in pieces(text))
        for place, some, own in parts:
            buckets, owner = features(some, own)
            total[place] += np.bincount(owner, weights=self.folded[buckets], minlength=len(some))
            count[place] += np.bincount(owner, minlength=len(some))
        count = np.maximum(count, 1)
        return 1 / (1 + np.exp(-np.clip(total / count + self.bias, -500, 500)))


def counted(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their counts; a long text is taken in pieces."""
    at, times = np.zeros(0, np.int32), np.zeros(0, np.int64)
    for piece, own in pieces(raw):
        buckets = features([piece], [own])[0]
        both, place = np.unique(np.concatenate([at, buckets.astype(np.int32)]), return_inverse=True)
        times = np.bincount(place[: len(at)], weights=times, minlength=len(both)).astype(np.int64) + np.bincount(place[len(at) :], minlength=len(both))
        at = both
    return at, times.astype(np.int32)


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 1, dimension: int = DIMENSION, epochs: int = EPOCHS, rate: float = RATE) -> Model:
    """rows: (label, distinct buckets, their counts)."""
    draws = np.random.default_rng(seed)
    vectors = draws.uniform(-1, 1, (1 << BUCKET_BITS, dimension)).astype(np.float32) / dimension
    output, bias = np.zeros((2, dimension), np.float32), np.zeros(2, np.float32)
    shares = [(y, at, (c / c.sum()).astype(np.float32)) for y, at, c in rows if len(at)]
    steps, done = max(1, epochs * len(shares)), 0
    for _ in range(epochs):
        for i in draws.permutation(len(shares)).tolist():
            label, at, share = shares[i]
            mean = share @ vectors[at]
            logits = output @ mean + bias
            p = np.exp(logits - logits.max())
            error = p / p.sum()
            error[label] -= 1
            step = rate * (1 - done / steps)
            back = error @ output
            output -= step * np.outer(error, mean)
            bias -= step * 0.1 * error
            # A feature's share of one text is tiny; scaling by the number of features keeps rare words learning.
            vectors[at] -= (step * np.sqrt(len(at)) * share)[:, None] * back[None, :]
            done += 1
    return Model((vectors @ (output[1] - output[0])).astype(np.float64), float(bias[1] - bias[0]))


def held_out(id_col: str):
    modulus, rest = HELD_OUT
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % modulus == rest, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> Model:
    """Train on `sample` labelled rows outside the held-out quarter.

    Labels of one id that differ count as the larger; rows with a null label or id are not used.
    """
    known = (
        labels.select(F.col(id_col).alias("_id"), F.col(label).alias("_label")).filter(F.col("_label").isNotNull() & F.col("_id").isNotNull() & ~held_out("_id"))
        .groupBy("_id").agg((F.max("_label") > 0).cast("int").alias("_label"))
        .withColumn("_order", F.xxhash64("_id"))
    )
    texts = docs.select(F.col(id_col).alias("_id"), text_of(text).alias("_text"))
    # Only rows with a text count towards the sample; its size bounds what is broadcast.
    found = known.join(texts.select("_id").distinct(), "_id", "left_semi").orderBy("_order", "_id").limit(sample)
    picked = texts.join(F.broadcast(found), "_id")

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = {}  # of rows that share an id the smallest text
        for batch in batches:
            for i, order, y, text in zip(batch["_id"].tolist(), batch["_order"].tolist(), batch["_label"].tolist(), batch["_text"].tolist()):
                raw = text.encode("utf-8", "surrogatepass")
                if (order, i) not in rows or raw < rows[order, i][1]:
                    rows[order, i] = (y, raw)
        sample = []
        for place in sorted(rows):
            y, raw = rows.pop(place)
            sample.append((y, *counted(raw)))
        model = train(sample)
        del sample
        release()
        yield pd.DataFrame({"folded": [model.folded.astype(np.float32).tobytes()], "bias": [model.bias]})

    # The sample's bound is this task's bound: it holds the texts once, and then their features.
    got = picked.select("_id", "_order", "_label", "_text").repartition(1).mapInPandas(learn, "folded binary, bias double").collect()
    return Model(np.frombuffer(got[0].folded, np.float32).astype(np.float64), got[0].bias) if got else Model(np.zeros(1 << BUCKET_BITS), 0.0)


def classify(docs: DataFrame, model: Model, text: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, and a struct column `quality` more: held_out, score, predicted.

    The score is the probability of label 1, from the whole text alone.  A text without features,
    null included, gets the score of the bias.  Rows stay rows; an empty table stays empty.
    """
    share = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        parts = [share.value.score(group) for _, group in repeats.chunks([0] * len(texts), texts.tolist())]
        release()
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    name, value = free_name(docs, "quality"), free_name(docs, "_score")
    scored = docs.withColumn(value, score(text_of(text)))
    return scored.withColumn(name, F.struct(held_out(id_col).alias("held_out"), F.col(value).alias("score"), (F.col(value) >= threshold).cast("int").alias("predicted"))).drop(value)
