import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tessera.llm.toxicity import Weights, fit, score_texts

BAD = ["vilewort", "scumwort", "trashwort"]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghiklmnoprst") for _ in range(5)) for _ in range(300)]
    rows = []
    for i in range(900):
        text = [rng.choice(words) for _ in range(rng.randint(8, 120))]
        toxic = i % 6 == 0
        for _ in range(2 if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(BAD) + rng.choice(["", "!!", ","]))
        rows.append((i, " ".join(text), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    got = score_texts(docs, fit(docs, labels)).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    caught = sum(r.predicted for r in held if truth[r.doc_id])
    assert caught >= 0.95 * sum(truth[r.doc_id] for r in held) and not any(r.predicted for r in held if not truth[r.doc_id])


def test_labels_of_the_held_out_third_are_never_read(labelled):
    docs, labels = labelled
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    a, b = fit(docs, labels), fit(docs, flipped)
    assert a.index.tolist() == b.index.tolist() and a.weight.tolist() == b.weight.tolist() and a.bias == b.bias


def test_odd_rows(labelled, odd_docs, no_docs):
    model = fit(*labelled)
    rows = score_texts(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (2, 3, 4)}) == 1
    assert score_texts(no_docs, model).count() == 0


def test_without_labels_of_both_kinds(labelled):
    docs, labels = labelled
    assert fit(docs, labels.where("toxic = 0")).score(b"any") < 1e-6
    assert fit(docs, labels.limit(0)).score(b"any") < 1e-6
    assert isinstance(fit(docs.limit(0), labels), Weights)


def mixed(x):
    for k in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = ((x ^ x >> 33) * k) % 2**64
    return x ^ x >> 33


def brute_features(text):
    words = re.findall(rb"[a-z0-9\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), text.encode()))
    h = [xxhash.xxh64_intdigest(w, 11) for w in words]
    pairs = [mixed((a * 0x9E3779B97F4A7C15 + b) % 2**64) for a, b in zip(h, h[1:], strict=False)]
    skips = [mixed((a * 0xD6E8FEB86659FD93 + c) % 2**64) for a, c in zip(h, h[2:], strict=False)]
    return {x >> 34 for x in h + pairs + skips}


def brute_ftrl(rows, y, epochs=8, alpha=2.0, beta=1.0, l1=15.0, l2=0.1):
    """One coordinate at a time, in dictionaries."""
    often = Counter(f for r in rows for f in r)
    z, n, share = defaultdict(float), defaultdict(float), sum(y) / len(y)
    weight = lambda f: 0.0 if f is not None and abs(z[f]) <= l1 else -(z[f] - (math.copysign(l1, z[f]) if f is not None else 0)) / ((beta + math.sqrt(n[f])) / alpha + (l2 if f is not None else 0))
    rng = np.random.default_rng(5)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)).tolist():
            known = [f for f in sorted(rows[i]) if often[f] >= 3]
            w = {f: weight(f) for f in [*known, None]}
            g = (1 / (1 + math.exp(-sum(w.values()))) - y[i]) * (min(6.0, (1 - share) / share) if y[i] else 1.0)
            for f in w:
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / alpha * w[f]
                n[f] += g * g
    return {f: weight(f) for f in z}


def test_weights_and_scores_are_those_of_plain_ftrl(spark, labelled):
    docs, labels = labelled
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(d for d in texts if zlib.crc32(str(d).encode()) % 3 != 1)
    want = brute_ftrl([brute_features(texts[d]) for d in ids], [truth[d] for d in ids])
    model = fit(docs, labels)
    mine = dict(zip(model.index.tolist(), model.weight.tolist(), strict=True))
    assert set(mine) == {f for f, w in want.items() if f is not None and w} and mine
    assert all(abs(mine[f] - want[f]) < 1e-9 for f in mine) and abs(model.bias - want[None]) < 1e-9
    for r in score_texts(docs, model).collect():
        total = want[None] + sum(want.get(f, 0.0) for f in brute_features(texts[r.doc_id]))
        assert abs(r.score - 1 / (1 + math.exp(-total))) < 1e-9 and r.predicted == (r.score >= 0.7)
