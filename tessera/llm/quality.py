"""Operator 6: quality rules by gradient-boosted trees over document statistics.

Two fixed rules come first (too few words; too many words inside repeated
five-word windows). Documents that pass get the verdict of boosted trees over
the statistics of :data:`FEATURES`. Trees are grown here, on a bounded sample
of labelled rows (``most_rows``), with monotone constraints: more duplicate
lines, repeated words or symbols never raise the probability of a good
document. The model is flattened into arrays of nodes, so a batch is scored by
a few gathers for each level.

Nulls and empty texts have no words and fail the first rule. Very long texts are
read whole. Null ids pass through, repeated rows give one result each, equal
texts equal verdicts; a probability of exactly the threshold keeps. Without
labels of both kinds, and with empty tables, every document that passes the
rules is kept. Columns besides id and text, of any name, are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WordHashes, in_arrow, utf8

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
#: Name and monotone sign: -1 where more never speaks for a document, 0 where it is free.
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1, "digit_share": 0,
    "bang_share": -1, "stop_share": 0, "comma_share": 0, "distinct_share": 0, "longest_word": 0, "words_per_line": 0, "beyond_ascii": 0, "braces_share": 0,
}
MOST_ROWS = 6000

_hashes = WordHashes()


def repeat_words(words: list[bytes], hashes: np.ndarray) -> int:
    """Words inside five-word windows that occur twice or more, the first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    key = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        key = key * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
    ranked = np.sort(key)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(key, twice))
    seen = Counter(tuple(words[i : i + WINDOW]) for i in at)  # equal hashes are held against the words
    covered = np.zeros(len(words) + 1, np.int32)
    for i in at:
        if seen[tuple(words[i : i + WINDOW])] > 1:
            covered[i] += 1
            covered[i + WINDOW] -= 1
    return int((np.cumsum(covered) > 0).sum())


def statistics(text: bytes) -> tuple[int, int, int, int, int, list[float]]:
    """Words, their code points, symbols, duplicate lines, repeated words, and the features."""
    words = text.split()
    n = len(words)
    by = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    space = int(by[9:14].sum() + by[32])
    points = int(by.sum() - by[128:192].sum())
    chars = points - space
    symbols = int(by[list(SYMBOLS)].sum())
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    dup = len(lines) - len(set(lines))
    repeated = repeat_words(words, _hashes(words)) if n > WINDOW else 0
    w, c = max(n, 1), max(chars, 1)
    return n, chars, symbols, dup, repeated, [
        float(np.log1p(n)), chars / w, symbols / w, dup / max(len(lines), 1), repeated / w, by[65:91].sum() / c, by[48:58].sum() / c,
        by[33] / w, by[46] / w, by[44] / w, len(set(words)) / w, float(max(map(len, words), default=0)), n / max(len(lines), 1), by[192:].sum() / c, (by[123] + by[125] + by[60] + by[62]) / w,
    ]


@dataclass
class Trees:
    """Boosted trees as arrays: a node is a leaf where ``feature`` is -1."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[node]
                go_left = x[rows, np.maximum(f, 0)] <= self.cut[node]
                node = np.where(f < 0, node, np.where(go_left, self.left[node], self.right[node]))
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, signs: list[int], rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, least: float = 8.0, l2: float = 2.0) -> Trees:
    """Second-order boosting of the logistic loss on binned features.

    A split that breaks a feature's sign is passed over, and both children
    inherit the midpoint of their values as a bound, which keeps the whole
    function monotone.
    """
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins)[1:-1])) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(x.shape[1])], 1)
    prior = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
    base = float(np.log(prior / (1 - prior)))
    f_, c_, l_, r_, v_, roots = [], [], [], [], [], []
    score = np.full(len(y), base)

    def leaf(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + l2), low, high))

    def node(at: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        k = len(f_)
        for a, v in ((f_, -1), (c_, 0.0), (l_, k), (r_, k), (v_, rate * leaf(g[at].sum(), h[at].sum(), low, high))):
            a.append(v)
        if level == depth:
            return k
        best, gs, hs = (1e-6, None), g[at].sum(), h[at].sum()
        for f, sign in enumerate(signs):
            if not len(cuts[f]):
                continue
            gl = np.cumsum(np.bincount(codes[at, f], g[at], len(cuts[f]) + 1))[:-1]
            hl = np.cumsum(np.bincount(codes[at, f], h[at], len(cuts[f]) + 1))[:-1]
            gr, hr = gs - gl, hs - hl
            gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - gs**2 / (hs + l2)
            gain[(hl < least / 4) | (hr < least / 4)] = -1
            if sign:
                a, b = np.clip(-gl / (hl + l2), low, high), np.clip(-gr / (hr + l2), low, high)
                gain[(b - a) * sign < 0] = -1
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (gain[i], (f, i, leaf(gl[i], hl[i], low, high), leaf(gr[i], hr[i], low, high)))
        if best[1] is None:
            return k
        f, i, a, b = best[1]
        mid = (a + b) / 2
        bounds = {0: ((low, high), (low, high)), -1: ((max(low, mid), high), (low, min(high, mid))), 1: ((low, min(high, mid)), (max(low, mid), high))}[signs[f]]
        under = codes[at, f] <= i
        f_[k], c_[k] = f, float(cuts[f][i])
        l_[k] = node(at[under], g, h, level + 1, *bounds[0])
        r_[k] = node(at[~under], g, h, level + 1, *bounds[1])
        return k

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        first = len(f_)
        roots.append(node(np.arange(len(y)), p - y, np.maximum(p * (1 - p), 1e-9), 0, -8.0, 8.0))
        tree = Trees(0.0, np.array([first]), *(np.array(a) for a in (f_, c_, l_, r_, v_)), depth)
        p = tree.probability(x)
        score += np.log(p / (1 - p))
    return Trees(base, np.array(roots), np.array(f_), np.array(c_), np.array(l_), np.array(r_), np.array(v_), depth)


def _with_statistics(rows: DataFrame, model: Trees | None, features: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                found = [statistics(t) for t in utf8(part.column(1))]
                arrays = [part.column(0), *(pa.array([f[k] for f in found], pa.int64()) for k in range(5))]
                x = np.array([f[5] for f in found]).reshape(len(found), len(FEATURES))
                arrays.append(pa.array(model.probability(x) if model else np.ones(len(found)), pa.float64()))
                names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "p_good"]
                if features:
                    arrays.append(pa.array(list(x), pa.list_(pa.float64())))
                    names.append("features")
                yield pa.RecordBatch.from_arrays(arrays, names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.transform(in_arrow, run, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, p_good double" + ", features array<double>" * features)


def labelled_sample(labels: DataFrame, label: str, most_rows: int) -> DataFrame:
    """At most ``most_rows`` labelled ids outside the held-out third, by seeded hash; a bounded table."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    return known.orderBy(F.xxhash64("doc_id"), "doc_id", F.desc("label")).limit(most_rows).groupBy("doc_id").agg(F.max("label").alias("label"))


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Trees | None:
    """Trees from a bounded sample of labelled rows; None where one kind of label is missing."""
    chosen = labelled_sample(labels, "quality", most_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    known = {r.doc_id: r.label for r in chosen.collect()}
    got = sorted(((r.doc_id, r.features) for r in _with_statistics(rows, None, True).select("doc_id", "features").collect()), key=lambda r: (r[0], r[1]))
    if not got:
        return None
    y = np.array([known[k] for k, _ in got], float)
    if y.min() == y.max():
        return None
    return grow(np.array([f for _, f in got]), y, list(FEATURES.values()))


def assess(docs: DataFrame, model: Trees | None, least_words: int = 10, most_repeat_percent: int = 20, threshold: float = 0.5) -> DataFrame:
    """One row per document: base statistics, ``base_failed``, the model's ``p_good`` and ``kept``. No shuffle."""
    found = _with_statistics(docs.select("doc_id", "text"), model, False)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat_percent * F.col("n_words"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def keep_good(docs: DataFrame, model: Trees | None, **options: float) -> DataFrame:
    """The documents that :func:`assess` keeps, with all their columns, in one pass over the texts."""
    least, most, threshold = options.get("least_words", 10), options.get("most_repeat_percent", 20), options.get("threshold", 0.5)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [statistics(t) for t in utf8(b.column(at))]
            x = np.array([f[5] for f in found]).reshape(len(found), len(FEATURES))
            p = model.probability(x) if model else np.ones(len(found))
            keep = [f[0] >= least and 100 * f[4] <= most * f[0] and q >= threshold for f, q in zip(found, p, strict=True)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.transform(in_arrow, run, docs.schema)
