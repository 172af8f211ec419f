import hashlib
import re
from collections import Counter, defaultdict

import pytest

from tessera.llm.mixing import mix, mixed_documents

SIZE = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def targets(sizes, cap=3):
    """Water-filling by shares, until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, left = {s: i % 3 + 1 for i, s in enumerate(names)}, sum(sizes.values())
    out, free = {}, set(names)
    while True:
        share = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if share * weight[s] > cap * sizes[s]]
        if not over:
            return out | {s: share * weight[s] for s in free}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            free.remove(s)


@pytest.mark.parametrize("digits", [1, 2, 5])
def test_targets_and_taken(corpus, odd_docs, digits):
    for docs in (corpus, odd_docs):
        source = docs.select("doc_id", "source", "text").collect()
        sizes = defaultdict(int)
        for r in source:
            sizes[r.source] += SIZE(r.text)
        want = targets(sizes)
        got = mix(docs, digits=digits).collect()
        assert Counter((r.doc_id, r.size, r.source_size, round(r.target, 3)) for r in got) == Counter((r.doc_id, SIZE(r.text), sizes[r.source], round(want[r.source], 3)) for r in source)
        assert all(0 <= r.taken <= 3 * r.size for r in got)
        assert Counter(map(tuple, got)) == Counter(map(tuple, mix(docs).collect()))


def test_taken_words_meet_the_target(corpus):
    taken, target = defaultdict(int), {}
    source = {r.doc_id: r.source for r in corpus.collect()}
    for r in mix(corpus).collect():
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)


def test_order_is_the_keyed_hash(corpus):
    rows = {r.doc_id: r for r in mix(corpus).collect()}
    by = defaultdict(list)
    for r in corpus.collect():
        by[r.source].append(r.doc_id)
    for ids in by.values():
        ids.sort(key=lambda d: hashlib.md5(f"20:{d}".encode()).hexdigest())
        extra = [rows[d].taken % rows[d].size if rows[d].taken < 3 * rows[d].size else 0 for d in ids]
        assert sum(e > 0 for e in extra) <= 1


def test_documents_of_the_mix(corpus, no_docs, odd_docs):
    want = {r.doc_id: r.taken for r in mix(corpus).collect()}
    out = mixed_documents(corpus)
    words = defaultdict(int)
    for r in out.collect():
        words[r.doc_id] += SIZE(r.text)
        assert r.n_chars == len(r.text)
    assert dict(words) == {d: n for d, n in want.items() if n} and out.schema.names == corpus.schema.names
    assert mix(no_docs).count() == 0 == mixed_documents(no_docs).count()
    assert mixed_documents(odd_docs).columns == odd_docs.columns


def test_native(corpus):
    plan = mix(corpus)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_clashing_columns_keep_their_values(odd_docs):
    from pyspark.sql import functions as F

    filled = odd_docs.withColumns({c: F.lit("mine") for c in ("target", "_key", "_doc", "whole", "copy")})
    rows = mixed_documents(filled).collect()
    assert rows and all(r[c] == "mine" for r in rows for c in ("target", "_key", "_doc", "whole", "copy"))
