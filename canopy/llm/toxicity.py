"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the distinct hashes of its words, word pairs and pairs with one
word between them, each present or not.  FTRL-proximal gives every weight its own learning
rate, and the L1 term keeps most of them at exactly zero, so the model is a short list of
(feature, weight) pairs that is bounded by ``2 ** bits`` and broadcast.

Training reads at most ``most_rows`` labelled rows, those with the smallest seeded hash of
their id (a bound on the sample of labelled rows only; every document is scored, whole).
Every fifth of them is kept from the weights and sets slope and offset of the scores, as an
L1 penalty leaves raw scores too low.

Cases: a null or empty text has no features and its score is the bias alone; rows with a
null id, text or label are not learned from; a document with several labels is learned from
once per label; training rows that are none, too few for any feature to get a weight or all of
one label are no evidence: every score is then under 0.5, so nothing is predicted toxic; repeated
rows are scored one by one; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    bits: int = 20
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 16.0
    l2: float = 1.0
    epochs: int = 8
    #: every how manieth row sets the scale of the scores instead of the weights
    calibrate: int = 5
    #: weight of all rows of label 0 against all of label 1 when it does
    caution: float = 3.0
    most_rows: int = 20_000
    #: highest bias of a model without any weight
    no_evidence: float = -1.0
    seed: int = 11


class _WordHashes(dict):
    """Word -> 64-bit hash of its lower-case letters and digits; emptied when it is full."""

    def __missing__(self, word: str) -> int:
        import xxhash
        if len(self) > 500_000:
            self.clear()
        h = xxhash.xxh64_intdigest(word.lower().strip(".,;:!?\"'()[]").encode("utf-8", "surrogatepass"))
        self[word] = h
        return h


def features(text: str | None, hashes: _WordHashes, bits: int) -> np.ndarray:
    """Hashed features of a text, with repeats."""
    words = text.split() if isinstance(text, str) else []
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    shift = np.uint64(64 - bits)
    with np.errstate(over="ignore"):
        pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
        skips = (h[:-2] * np.uint64(0x165667B19E3779F9) + h[2:]) * np.uint64(0x85EBCA77C2B2AE63)
    return np.concatenate([h >> shift, pairs >> shift, skips >> shift]).astype(np.int64)


def ftrl(rows: Iterator[tuple[np.ndarray, int]], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Accumulators z and n after one pass per epoch; the bias is the last coordinate."""
    rows = list(rows)
    z, n = np.zeros((1 << s.bits) + 1), np.zeros((1 << s.bits) + 1)
    for _ in range(s.epochs):
        for idx, y in rows:
            w = weights(z[idx], n[idx], s)
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - y
            step = (np.sqrt(n[idx] + g * g) - np.sqrt(n[idx])) / s.alpha
            z[idx] += g - step * w
            n[idx] += g * g
    return z, n


def weights(z: np.ndarray, n: np.ndarray, s: Settings) -> np.ndarray:
    w = (np.sign(z) * s.l1 - z) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2)
    return np.where(np.abs(z) <= s.l1, 0.0, w)


def scale(x: np.ndarray, y: np.ndarray, s: Settings) -> tuple[float, float]:
    """Slope and offset of a logistic curve through raw scores, both labels weighted as a whole."""
    a, b = 1.0, 0.0
    if len(set(y.tolist())) < 2:
        return a, b
    w = np.where(y == 1, 1 / (y == 1).sum(), s.caution / (y == 0).sum())
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -35, 35)))
        g, q = w * (p - y), w * p * (1 - p)
        curve = np.array([[(q * x * x).sum() + 1e-3, (q * x).sum()], [(q * x).sum(), q.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(curve, [(g * x).sum() + 1e-3 * (a - 1), g.sum()]), -2, 2)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


@dataclass
class Model:
    settings: Settings
    index: np.ndarray  # hashed features with a weight other than 0, ascending
    weight: np.ndarray
    bias: float


def fit(docs: DataFrame, labels: DataFrame, label_col: str, learn: Column, s: Settings = Settings()) -> Model:
    """Learn ``label_col`` (0 or 1) from the rows of ``docs`` that ``learn`` (on doc_id) holds for.

    The sample's features are made in parallel; the pass over them, in seeded order, is
    sequential and runs in one task of at most ``most_rows`` rows.
    """
    y = labels.filter(F.col(label_col).isin(0, 1)).select("doc_id", F.col(label_col).cast("int").alias("y"))
    text = docs.filter(learn & F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    place = F.xxhash64(F.lit(s.seed), "doc_id")
    ids = y.join(text.select("doc_id").distinct(), "doc_id").withColumn("place", place) \
        .orderBy("place", "doc_id", "y").limit(s.most_rows)
    rows = text.join(F.broadcast(ids), "doc_id")  # at most ``most_rows`` ids, so no text is shuffled that is not learned from

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _WordHashes()
        for batch in batches:
            got = [np.unique(features(t, hashes, s.bits)).astype(np.int32) for t in batch["text"]]
            yield pd.DataFrame({"place": batch["place"], "y": batch["y"], "f": got})

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [(np.append(f, 1 << s.bits).astype(np.int64), int(y))
                for b in batches for f, y in zip(b["f"], b["y"])]
        seen = [r for k, r in enumerate(held) if k % s.calibrate != s.calibrate - 1]
        z, n = ftrl(iter(seen), s)
        # rows of one label tell nothing apart, nor does a bias alone
        w = weights(z, n, s) if len({y for _, y in seen}) > 1 else np.zeros((1 << s.bits) + 1)
        aside = held[s.calibrate - 1::s.calibrate]
        slope, offset = scale(np.array([w[f].sum() for f, _ in aside]), np.array([y for _, y in aside]), s)
        w *= slope
        w[-1] += offset
        hit = np.flatnonzero(w)
        yield pd.DataFrame({"i": hit, "w": w[hit]})

    made = rows.mapInPandas(extract, "place long, y int, f array<int>")
    got = made.repartition(1).sortWithinPartitions("place", "y", "f").mapInPandas(train, "i int, w double") \
        .toPandas().sort_values("i")
    bias = got.loc[got["i"] == 1 << s.bits, "w"]
    body = got[got["i"] < 1 << s.bits]
    start = float(bias.sum())
    return Model(s, body["i"].to_numpy(np.int64), body["w"].to_numpy(float),
                 start if len(body) else min(start, s.no_evidence))


def scorer(spark: SparkSession, model: Model):
    """A column function from texts to the probability of label 1."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        dense = np.zeros(1 << m.settings.bits)
        dense[m.index] = m.weight
        hashes = _WordHashes()
        for texts in batches:
            sums = np.empty(len(texts))
            for k, text in enumerate(texts):
                f = features(text, hashes, m.settings.bits)
                sums[k] = m.bias + dense[np.unique(f[dense[f] != 0])].sum()
            yield pd.Series(1 / (1 + np.exp(-np.clip(sums, -35, 35))))

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score``: the probability of label 1 for every document."""
    run = scorer(docs.sparkSession, model)
    return docs.select("doc_id", run(F.col("text").cast("string")).alias("score"))


def toxic(score: Column) -> Column:
    """Whether a score predicts label 1."""
    return score >= 0.5


def remainder(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo ``m`` (null for a null id)."""
    return F.crc32(doc_id.cast("string")) % m
