import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import quality

PARTS = ["a", "b c", "\n", "  ", "a b c d e", "#", "x|y", "\u00a0", "\x1c", "é", "\r\n", "<>"]


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=40).map("".join))
def test_base_statistics(text):
    assert quality.statistics(text.encode())[:5] == brute(text)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghiklmnoprst") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    rows = []
    for i in range(600):
        good = i % 4 > 0
        text = " ".join(rng.choice(words) + ("" if good else rng.choice(["###", "$$$", "!!"])) for _ in range(rng.randint(20, 90)))
        rows.append((i, text, int(good)))
    return spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")


def test_held_out_accuracy_and_stage(labelled):
    docs, labels = labelled
    model = quality.fit(docs, labels)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in quality.assess(docs, model).collect()]
    assert np.mean([r.kept == bool(truth[r.doc_id]) for r in held]) > 0.98
    kept = quality.keep_good(docs, model)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in held if r.kept} and kept.columns == docs.columns


def test_monotone_constraints_hold(labelled):
    model = quality.fit(*labelled)
    rng = np.random.default_rng(1)
    x = rng.random((200, len(quality.FEATURES))) * 5
    for f, sign in enumerate(quality.FEATURES.values()):
        if sign:
            more = x.copy()
            more[:, f] += rng.random(200) * 5
            assert ((model.probability(more) - model.probability(x)) * sign >= -1e-12).all()


def test_odd_rows(labelled, odd_docs, no_docs):
    for model in (None, quality.fit(*labelled)):
        rows = quality.assess(odd_docs, model).collect()
        assert len(rows) == odd_docs.count() and all(r.base_failed and not r.kept for r in rows if r.doc_id in (2, 3, 4, 6, 8))
        assert quality.keep_good(odd_docs, model).columns == odd_docs.columns
        assert quality.assess(no_docs, model).count() == 0 == quality.keep_good(no_docs, model).count()


def test_without_labels_of_both_kinds(labelled):
    docs, labels = labelled
    assert quality.fit(docs, labels.where("quality = 1")) is None and quality.fit(docs, labels.limit(0)) is None


def plain_features(text):
    """The features of the trees, one by one."""
    n, chars, symbols, dup, repeated = brute(text)
    words, lines = re.findall(r"[^\x20\x09-\x0D]+", text), [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    w, c, data = max(n, 1), max(chars, 1), text.encode()
    some = lambda pattern: len(re.findall(pattern, text))
    return [
        math.log1p(n), chars / w, symbols / w, dup / max(len(lines), 1), repeated / w, some("[A-Z]") / c, some("[0-9]") / c, some("!") / w, some("[.]") / w, some(",") / w, len(set(words)) / w,
        max((len(x.encode()) for x in words), default=0), n / max(len(lines), 1), sum(b >= 192 for b in data) / c, some("[{}<>]") / w,
    ]


def walked(model, x):
    """The probability by walking each tree from its root."""
    total = model.base
    for k in model.roots.tolist():
        while model.feature[k] >= 0:
            k = int(model.left[k] if x[model.feature[k]] <= model.cut[k] else model.right[k])
        total += model.value[k]
    return 1 / (1 + math.exp(-total))


def test_verdicts_are_those_of_walked_trees(labelled, corpus, odd_docs):
    model = quality.fit(*labelled)
    assert (model.feature >= 0).any()
    for docs in (labelled[0], corpus, odd_docs.where("length(text) < 9000 OR text IS NULL")):
        texts = {}
        for r in docs.collect():
            texts.setdefault(str(r.doc_id), set()).add(r.text or "")
        for r in quality.assess(docs, model).collect():
            if len(texts[str(r.doc_id)]) > 1:
                continue
            text = next(iter(texts[str(r.doc_id)]))
            n, _, _, _, repeated = brute(text)
            p = walked(model, plain_features(text))
            assert abs(p - r.p_good) < 1e-9 and r.base_failed == (n < 10 or 100 * repeated > 20 * n) and r.kept == (not r.base_failed and p >= 0.5)
