"""Operator 3: toxicity by FTRL-proximal logistic regression on hashed n-grams.

Features are hashed words, word pairs and pairs that skip one word, each
counted once for a document. Training keeps per-coordinate rates and an L1
penalty, so all but a few weights are exactly zero; the others form a small
sorted table that goes to every task. Words are runs of letters and digits
with A-Z lower-cased, so trailing marks do not hide a word.

The model is fitted on at most ``most_rows`` labelled rows (a documented bound,
by seeded hash), none of them from the held-out third; labels, language, source
and id are never inputs of a score. A null or empty text gets the score of the
bias alone. Very long texts are read whole. Null ids pass through (their fold
is that of an empty id), repeated rows give one result each, and equal texts
equal scores. Rows of one id with several texts are all learnt under its label,
1 where labels of an id differ. Without labels of both kinds every score is the
share of toxic labels, or 0; so it is with empty tables. Other columns, of any
name, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WordHashes, in_arrow, mix64, utf8

BITS = 30
MOST_ROWS = 10_000
LEAST_ROWS = 3
_PAIR, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Bytes that separate words become blanks, A-Z lower case.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_hashes = WordHashes(seed=11)


def features(text: bytes) -> np.ndarray:
    """Hashed features of a text, in order, with repeats."""
    h = _hashes(text.translate(_PLAIN).split())
    parts = [h, mix64(h[:-1] * _PAIR + h[1:]), mix64(h[:-2] * _SKIP + h[2:])] if len(h) > 2 else [h, mix64(h[:-1] * _PAIR + h[1:])]
    return (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.uint32)


class Weights:
    """The non-zero weights, sorted by feature, behind a bit table of their low bits."""

    LOW = 18

    def __init__(self, index: np.ndarray, weight: np.ndarray, bias: float) -> None:
        order = np.argsort(index)
        self.index, self.weight, self.bias = index[order].astype(np.uint32), weight[order], bias

    def prepared(self) -> Weights:
        self.table = np.zeros(1 << self.LOW, bool)
        self.table[self.index & np.uint32((1 << self.LOW) - 1)] = True
        return self

    def score(self, text: bytes) -> float:
        total = self.bias
        if len(self.index):
            f = features(text)
            f = np.unique(f[self.table[f & np.uint32((1 << self.LOW) - 1)]])
            if len(f):
                at = np.minimum(np.searchsorted(self.index, f), len(self.index) - 1)
                total += float(self.weight[at[self.index[at] == f]].sum())
        return float(1 / (1 + np.exp(-np.clip(total, -500, 500))))


def ftrl(rows: list[np.ndarray], y: np.ndarray, epochs: int = 8, alpha: float = 2.0, beta: float = 1.0, l1: float = 15.0, l2: float = 0.1, seed: int = 5) -> Weights:
    """FTRL-proximal over sets of features; those in fewer than ``LEAST_ROWS`` rows are left out."""
    ranked = np.sort(np.concatenate(rows))
    index = np.unique(ranked[LEAST_ROWS - 1 :][ranked[LEAST_ROWS - 1 :] == ranked[: len(ranked) - LEAST_ROWS + 1]])
    del ranked
    at = []
    for r in rows:
        k = np.minimum(np.searchsorted(index, r), max(len(index) - 1, 0))
        at.append(k[index[k] == r].astype(np.int32) if len(index) else np.zeros(0, np.int32))
    z, n = np.zeros(len(index)), np.zeros(len(index))
    zb = nb = 0.0

    def weights(k: np.ndarray | slice) -> np.ndarray:
        zk = z[k]
        return np.where(np.abs(zk) <= l1, 0.0, -(zk - np.sign(zk) * l1) / ((beta + np.sqrt(n[k])) / alpha + l2))

    share = float(y.mean())
    pull = np.where(y > 0, min(6.0, (1 - share) / share), 1.0)  # toxic rows are few
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            k, b = at[i], -zb / ((beta + nb**0.5) / alpha)
            w = weights(k)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -500, 500))) - y[i]
            g *= pull[i]
            z[k] += g - (np.sqrt(n[k] + g * g) - np.sqrt(n[k])) / alpha * w
            n[k] += g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / alpha * b
            nb += g * g
    w = weights(slice(None))
    return Weights(index[w != 0], w[w != 0], -zb / ((beta + nb**0.5) / alpha))


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Weights:
    """Weights from a bounded sample of labelled rows, learnt in one task that sends back the non-zero ones."""
    from tessera.llm.quality import labelled_sample

    chosen = F.broadcast(labelled_sample(labels, "toxic", most_rows))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id")

    def collected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in enumerate(utf8(b.column(1))):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([np.unique(features(text)).astype("<u4").tobytes()], pa.binary()), b.column(2).slice(i, 1)], ["doc_id", "f", "label"])

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [(np.frombuffer(f, "<u4"), y) for d in frames for f, y in zip(d.f, d.label, strict=True)]
        y = np.array([t for _, t in got], float)
        if len(y) and y.min() < y.max():
            m = ftrl([f for f, _ in got], y)
            yield pd.DataFrame({"feature": np.append(m.index.astype(np.int64), -1), "weight": np.append(m.weight, m.bias)})
        elif len(y):
            share = float(np.clip(y.mean(), 1e-9, 1 - 1e-9))
            yield pd.DataFrame({"feature": [-1], "weight": [np.log(share / (1 - share))]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    sample = rows.select("doc_id", "text", "label").transform(in_arrow, collected, f"doc_id {kind}, f binary, label int")
    found = sample.repartition(1).sortWithinPartitions("doc_id", "f").mapInPandas(learn, "feature long, weight double").collect()
    bias = next((r.weight for r in found if r.feature < 0), -500.0)
    kept = [r for r in found if r.feature >= 0]
    return Weights(np.array([r.feature for r in kept], np.uint32), np.array([r.weight for r in kept], float), bias)


def score_texts(docs: DataFrame, model: Weights, threshold: float = 0.7) -> DataFrame:
    """One row per document: fold, score from 0 to 1 and the decision. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.prepared()
        for b in batches:
            scores = [m.score(t) for at in range(0, b.num_rows, 512) for t in utf8(b.column(1).slice(at, 512))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1
    out = docs.select("doc_id", "text").transform(in_arrow, run, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
