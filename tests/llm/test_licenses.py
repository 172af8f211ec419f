import random
import re

import pytest

from tessera.llm import licence_texts as known
from tessera.llm.licenses import LONG, PAIR, PHRASES, RUN, scan, templates

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    places = [(i, v) for p, v in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({v for _, v in places}))


@pytest.fixture(scope="module")
def texts(spark):
    rows = [
        (1, "Cc by cc BY cc by. MITK license, mit LICENSE"), (2, "x gnu general public license apache license"), (2, "x gnu general public license apache license"),
        (3, "Licensed under the new Apache License, Version 2.0"), (4, "Apache\nLicense"), (5, "gnu general license public"), (6, "mit"), (7, "cc by " * 3000), (8, "é mit-license Émit license"),
        (9, "Permission is hereby granted, free of charge, to any other person obtaining a copy of this software"), (10, "permission is granted to copy of this software"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_base(texts, odd_docs):
    for docs in (texts, odd_docs.select("doc_id", "text")):
        want = sorted(str((r.doc_id, *brute(r.text))) for r in docs.collect())
        assert sorted(str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in scan(docs).collect()) == want


def test_added_labels_keep_base_and_bridge_an_inserted_word(texts):
    got = {r.doc_id: r for r in scan(texts).collect()}
    assert got[3].labels == "apache,apache-2.0" and got[9].labels == "mit" and got[9].n_base == 0 and got[9].score >= 0.8
    assert got[10].labels == "" and got[10].score < 0.8
    assert all({*r.base_labels.split(",")} <= {"", *r.labels.split(",")} for r in got.values())


def whole(text, slack=2, share=0.8):
    """Labels and score by trying every diagonal of every template."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    labels, score = set(), 0.0
    for template, label, base in templates():
        n = PAIR if len(template) < LONG else RUN
        runs = {}
        for t in range(len(template) - n + 1):
            for p in range(len(words) - n + 1):
                if words[p : p + n] == template[t : t + n]:
                    runs.setdefault(p - t, set()).add(t)
        spans, last = [], None
        for d in sorted(runs):
            if base or last is None or d - last > slack:
                spans.append(set())
            spans[-1] |= runs[d]
            last = d
        for ts in spans:
            part = len({t + k for t in ts for k in range(n)}) / len(template)
            if base and len(ts) == len(template) - 1:
                labels.add(label)
                score = 1.0
            elif not base:
                score = max(score, part)
                if part >= share:
                    labels.add(label)
    return ",".join(sorted(labels)), round(score, 9)


def test_whole_licences_against_every_diagonal(spark, corpus, odd_docs):
    rng = random.Random(6)
    lines = [t for _, t in known.TEXTS]
    texts = []
    for t in lines * 2:
        words = t.split()
        for _ in range(rng.randint(0, 12)):
            k = rng.randrange(len(words))
            words[k : k + rng.randint(0, 2)] = rng.choice([[], ["new"], ["other", "words"]])
        texts.append(" ".join(rng.choices("of the in to software copy".split(), k=rng.randint(0, 30)) + words + rng.choice(lines).split()[: rng.randint(0, 20)]))
    docs = spark.createDataFrame(list(enumerate([*lines, *texts, "MIT\n".join(lines)])), "doc_id long, text string")
    for df in (docs, corpus.select("doc_id", "text").limit(40), odd_docs.select("doc_id", "text").where("length(text) < 9000 OR text IS NULL")):
        want = sorted((str(r.doc_id), *whole(r.text)) for r in df.collect())
        assert sorted((str(r.doc_id), r.labels, round(r.score, 9)) for r in scan(df).collect()) == want
    got = {r.doc_id: r.labels.split(",") for r in scan(docs).collect()}
    assert all(label in got[k] for k, (label, _) in enumerate(known.TEXTS))


def test_only_ascii_letters_are_lowered(spark):
    docs = spark.createDataFrame([(1, "\u212aMIT license MIT L\u0130CENSE")], "doc_id long, text string")
    r = scan(docs).first()
    assert (r.n_base, r.first_word, r.n_words) == (0, None, 4)


def test_empty_and_native(texts, no_docs):
    assert scan(no_docs).count() == 0
    plan = scan(texts)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
