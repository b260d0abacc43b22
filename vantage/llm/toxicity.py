"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, pairs of neighbours, and pairs that skip one or two words, each hashed to 2**BITS. FTRL
keeps a learning rate for each coordinate, and L1 leaves most weights at exactly zero, so the model is a short list of
(feature, weight) that every task holds.

The model is fitted in one task on at most `sample` labelled documents of `sample_chars` characters in all, those of least
hash of doc_id, never on a held-out one; the bounds make the fit's cost and the model's size independent of the corpus.
Every document is scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vantage.llm.arrays import U64, mix, slices, starts, texts
from vantage.llm.words import word_hashes
from vantage.runtime import unused

BITS = 20
SKIPS = 3  # pairs of words 1, 2 and 3 places apart


def features(counts: np.ndarray, words: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of the distinct features of each text, ordered; only those of the mask `keep`, if given."""
    row = np.repeat(np.arange(len(counts)), counts)
    shift = U64(64 - BITS)
    out = []
    for skip in range(SKIPS + 1):
        if skip and skip >= len(words):
            break
        if skip:
            same = row[skip:] == row[:-skip]
            hashed = mix(words[:-skip][same] * U64(2 * skip + 1) + mix(words[skip:][same]))
            at = row[:-skip][same]
        else:
            hashed, at = mix(words), row
        index = (hashed >> shift).astype(np.int64)
        if keep is not None:
            on = keep[index]
            index, at = index[on], at[on]
        out.append((at.astype(np.int64) << BITS) | index)
    pairs = np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


class Ftrl:
    """FTRL-proximal for logistic loss and binary features."""

    def __init__(self, alpha: float = 1.0, beta: float = 1.0, l1: float = 5.0, l2: float = 0.5):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1, np.float32), np.zeros((1 << BITS) + 1, np.float32)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        """One example; its features, the last of them the constant one."""
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        more = n + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(n)) / self.alpha * w
        self.n[at] = more


def fit(docs: DataFrame, labels: DataFrame, sample: int = 16_000, sample_chars: int = 100_000_000, epochs: int = 2) -> DataFrame:
    """(feature, weight) of the weights that aren't zero; feature -1 is the constant.

    A doc_id that repeats gives one example, its least text. A document that would carry the sample past sample_chars is
    no example.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    own = own.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    chosen = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(sample)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = text.join(F.broadcast(chosen), "doc_id").groupBy("h", "doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("h", "toxic", "text")

    def train(batches):
        x, y, order, held = [], [], [], 0
        for batch in slices(batches, "text", 2 << 20):
            size = pc.utf8_length(batch.column("text")).to_pylist()
            fits = []
            for n in size:
                fits.append(held + n <= sample_chars)
                held += n if fits[-1] else 0
            batch = batch.filter(pa.array(fits))
            counts, words = word_hashes(texts(batch))
            row, index = features(counts, words)
            for part in np.split(index, starts(np.bincount(row, minlength=len(counts)))[1:-1]):
                x.append(np.append(part, 1 << BITS).astype(np.int32))
            y += batch.column("toxic").to_pylist()
            order += batch.column("h").to_pylist()
        model = Ftrl()
        for epoch in range(epochs):
            turn = np.argsort(mix(np.array(order, np.int64).view(U64) + U64(epoch)), kind="stable")
            for k in turn.tolist():
                model.learn(x[k], y[k])
        w = model.weights(np.arange((1 << BITS) + 1))
        on = np.flatnonzero(w)
        yield pa.record_batch({"feature": pa.array(np.where(on == 1 << BITS, -1, on), pa.int32()), "weight": pa.array(w[on], pa.float64())})

    return rows.repartition(1).sortWithinPartitions("h", "text").mapInArrow(train, "feature int, weight double")


def score(docs: DataFrame, labels: DataFrame, sample: int = 16_000, cost: float = 5.0, into: str = "score") -> DataFrame:
    """docs with the column `into` added: how likely labels.toxic is 1. Other columns are kept.

    A missed toxic document counts as much as `cost` clean ones that are flagged, so log(cost) is added to the log odds,
    but at most half of what the constant takes off them: words, not the shift, carry a text to 0.5. The default was
    chosen by cross-validation in four folds over labelled rows that are not held out: see README.

    Cases: a null or empty text is scored by the constant alone; a text of any length is scored whole, in memory of its own
    length; equal texts score alike, repeated rows each; labels of absent documents,
    null labels and repeated ones (the larger counts) do no harm; without any weight (no labels, or very few) every score
    is 0; an empty table gives no rows. A column that has the name `into` already is an error.
    """
    if into.lower() in map(str.lower, docs.columns):
        raise ValueError(f"docs have a column {into}")
    rows = fit(docs, labels, sample).collect()  # at most 2**BITS weights, few after L1
    index = np.array([r.feature for r in rows], np.int64)
    given = docs.sparkSession.sparkContext.broadcast((index, np.array([r.weight for r in rows], np.float64)))
    names = docs.columns

    def run(batches):
        index, value = given.value
        weight, keep = np.zeros(1 << BITS), np.zeros(1 << BITS, bool)
        weight[index[index >= 0]] = value[index >= 0]
        keep[index[index >= 0]] = True
        constant = value[index < 0].sum()
        shifted = constant + min(np.log(cost), max(-constant / 2, 0)) if len(index) else -np.inf
        for batch in slices(batches, "text", 2 << 20):
            counts, words = word_hashes(texts(batch))
            row, at = features(counts, words, keep)
            total = shifted + np.bincount(row, weight[at], minlength=len(counts))
            p = np.where(np.isneginf(total), 0, 1 / (1 + np.exp(-np.clip(total, -35, 35))))
            yield pa.record_batch([*batch.columns, pa.array(p, pa.float64())], names=[*names, into])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())]))


def judge(docs: DataFrame, labels: DataFrame, sample: int = 16_000) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each document; the cases of score() hold. A null doc_id isn't held out."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return score(own, labels, sample).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = 16_000) -> DataFrame:
    """docs whose score is below threshold, with their own columns, whatever their names; the cases of score() hold."""
    name = unused(docs, "score")
    return score(docs, labels, sample, into=name).filter(F.col(name) < threshold).drop(name)
