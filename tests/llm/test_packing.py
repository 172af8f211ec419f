import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.common import written
from tessera.llm.packing import VOCABULARY, Index, WordIds, encoded, pack, pack_shard, statistics
from tessera.llm.queries import tokenizer

tokenizers = pytest.importorskip("tokenizers")
PATH = tokenizer("word_bpe_49k.json")
PARTS = ["a", "Hello", "don't", "'re", " ", "\n", "\t", "\u00a0", "é", "e\u0301", "<|endoftext|>", "<|ENDOFTEXT|>", ".", ",", "123", "😀", "\x1c", "word.", "!!", "日本", "İ"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_ids_are_the_librarys(text):
    import pyarrow as pa

    ids, bounds = WordIds.of(PATH).ids(pa.array([text, None, text]))
    want = tokenizers.Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want + want and bounds.tolist() == [0, len(want), len(want), 2 * len(want)]


def check(rows, texts, window):
    """Every id in one piece, sequences without gaps and within the window; returns padding."""
    enc = tokenizers.Tokenizer.from_file(PATH)
    want = defaultdict(list)
    for d, t in texts:
        want[d].append(enc.encode(t or "", add_special_tokens=False).ids + [1])
    got, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        got[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(got) == set(want)
    for d, pieces in got.items():
        copies, ids = len(want[d]), want[d][0]
        if any(x != ids for x in want[d]):
            continue  # rows of one id with several texts
        by_start = sorted(pieces, key=lambda r: r.start)
        assert sum(r.length for r in pieces) == copies * len(ids)
        for r in by_start:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    padding = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_pack_round_trip(corpus):
    texts = [(r.doc_id, r.text) for r in corpus.collect()]
    padding = check(pack(corpus, PATH, window=256, shard_docs=64).collect(), texts, 256)
    assert padding <= 256 * 8


def test_pack_odd_rows(odd_docs, no_docs):
    check(pack(odd_docs, PATH).collect(), [(r.doc_id, r.text) for r in odd_docs.collect()], 2048)
    assert pack(no_docs, PATH).count() == 0


def bm25(docs, q, idf, mean, k1=1.2, b=0.75):
    scores = []
    for d in docs:
        tf = {t: int((d == t).sum()) for t in set(q.tolist())}
        scores.append(sum(idf[t] * n * (k1 + 1) / (n + k1 * (1 - b + b * len(d) / mean)) for t, n in tf.items() if n))
    return np.array(scores)


def rarity(docs):
    held = np.zeros(VOCABULARY)
    for d in docs:
        held[np.unique(d)] += 1
    return np.log1p((len(docs) - held + 0.5) / (held + 0.5)), np.mean([len(d) for d in docs])


@pytest.mark.parametrize("most", [60, 3000])
def test_neighbours_are_ranked_as_by_brute_force(most):
    rng = np.random.default_rng(3)
    docs = [rng.integers(10, most, rng.integers(5, 40)).astype(np.uint16) for _ in range(50)]
    idf, mean = rarity([*docs, *(rng.integers(10, 4000, 30).astype(np.uint16) for _ in range(200))])
    index, used = Index(docs, idf, mean), np.zeros(50, bool)
    used[[0, 5]] = True
    for seed in (0, 7, 20):
        scores = bm25(docs, docs[seed], idf, mean)
        got = index.neighbours(seed, used)
        assert sorted(got.tolist()) == [i for i in range(50) if not used[i] and scores[i] > 0]
        assert np.allclose(scores[got], np.sort(scores[got])[::-1])
        few = index.neighbours(seed, used, terms=3)
        rare = sorted(set(docs[seed].tolist()), key=lambda t: (-idf[t], t))[:3]
        assert set(few.tolist()) <= {i for i in range(50) if set(rare) & set(docs[i].tolist())}


def test_statistics_cover_all_documents(corpus):
    rows = written(encoded(corpus, PATH, window=64), "test")
    enc = tokenizers.Tokenizer.from_file(PATH)
    rests = []
    for r in corpus.collect():
        ids = np.array([*enc.encode(r.text, add_special_tokens=False).ids, 1], np.uint16)
        rests.append(ids[len(ids) // 64 * 64 :])
    total, n, mean, idf = statistics(rows)
    left = [r for r in rests if len(r)]
    want, want_mean = rarity(left)
    assert total == corpus.count() and n == len(left) and abs(mean - want_mean) < 1e-9 and np.allclose(idf, want)


def test_shards_bring_near_copies_together(spark, corpus):
    """Of documents whose best neighbour by BM25 over all of them is a near copy, most have it in their shard of a tenth of the documents."""
    rows = encoded(corpus, PATH).where("n IS NOT NULL").orderBy("sketch").collect()
    docs = [np.frombuffer(r.rest, "<u2") for r in rows]
    idf, mean = rarity(docs)
    size, copies, met_copies = len(docs) // 10, 0, 0
    for k in range(0, len(docs), 7):
        scores = bm25(docs, docs[k], idf, mean)
        scores[k] = 0
        best = int(np.argmax(scores))
        alike = len(set(docs[k].tolist()) & set(docs[best].tolist())) > 0.8 * max(len(set(docs[k].tolist())), len(set(docs[best].tolist())))
        copies += alike
        met_copies += alike and k // size == best // size
    assert copies and met_copies >= 0.6 * copies


def test_all_windows_of_a_shard_but_the_last_are_full():
    rng = np.random.default_rng(4)
    rests = [rng.integers(0, 500, rng.integers(0, 63)).astype(np.uint16) for _ in range(80)]
    for terms in (None, 5):
        sizes = [sum(n for _, _, n in w) for w in pack_shard(list(range(80)), rests, 64, *rarity(rests), terms)]
        assert all(s == 64 for s in sizes[:-1]) and sum(sizes) == sum(map(len, rests))
