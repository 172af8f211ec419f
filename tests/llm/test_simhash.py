import re

import numpy as np
import pytest
import xxhash

from tessera.llm import simhash
from tessera.llm.components import components


def fingerprint(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(values, distance):
    """Component of each value by all pairs: value to its smallest."""
    u = sorted(set(values))
    parent = {x: x for x in u}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(u):
        for b in u[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {x: root(x) for x in u}


def test_components_are_those_of_all_pairs(corpus, odd_docs):
    for docs in (corpus, odd_docs):
        source = docs.select("doc_id", "text").collect()
        fps = [fingerprint(r.text, 4) for r in source]
        roots = linked(fps, 4)
        least = {}
        for r, f in zip(source, fps, strict=True):
            if r.doc_id is not None:
                least[roots[f]] = min(least.get(roots[f], r.doc_id), r.doc_id)
        want = sorted((str(r.doc_id), f"{f:016x}", least.get(roots[f])) for r, f in zip(source, fps, strict=True))
        assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_components(docs).collect()) == want


@pytest.mark.parametrize("most_bucket", [20_000, 330])
def test_dense_fingerprints_either_way(spark, most_bucket):
    rng = np.random.default_rng(2)
    base, fps = int(rng.integers(0, 2**63)), set()
    for _ in range(300):
        x = base
        for i in rng.integers(0, 64, rng.integers(0, 9)):
            x ^= 1 << int(i)
        fps.add(x)
    fps |= {int(x) for x in rng.integers(0, 2**63, 200)}
    signed = lambda x: int(np.array([x], np.uint64).view(np.int64)[0])
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    root = {r.node: r.root for r in components(simhash.fingerprint_links(df, most_bucket)).collect()}
    want, groups = linked(fps, 4), {}
    for x in fps:
        groups.setdefault(root.get(signed(x), signed(x)), set()).add(want[x])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, **{i: 100 for i in range(100, 160)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest_spans_what_pairs_span():
    rng = np.random.default_rng(6)
    fps = np.unique(rng.integers(0, 2**10, 200).astype(np.uint64))
    want = linked(fps.tolist(), 1)
    parent = {int(x): int(x) for x in fps}
    members = simhash.Prints(fps, 1)
    for x, y in zip(*(members.names(v).tolist() for v in simhash.forest(members, np.arange(len(fps)))), strict=True):
        parent[x] = y
    up = lambda x: x if parent[x] == x else up(parent[x])
    assert len({(up(x), want[x]) for x in parent}) == len(set(want.values())) == len({up(x) for x in parent})


def shingle_sets(docs):
    return {r.doc_id: set(zip(*(r.text.lower().split()[k:] for k in range(5)), strict=False)) for r in docs.collect()}


def alike(a, b):
    return len(a & b) / max(1, len(a | b))


def groups_of(sets, least=0.8):
    """Smallest id of each document's component of pairs."""
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and alike(sets[a], sets[b]) >= least:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d in sets}


@pytest.mark.parametrize(("part_rows", "most_bucket"), [(2, 20_000), (500, 20_000), (500, 2)])
def test_keep_one(corpus, no_docs, part_rows, most_bucket):
    kept = sorted(r.doc_id for r in simhash.keep_one(corpus, part_rows=part_rows, most_bucket=most_bucket).collect())
    sets = shingle_sets(corpus)
    assert kept == sorted(set(groups_of(sets).values())) and len(kept) < len(sets)
    assert simhash.keep_one(no_docs).count() == 0 and simhash.near_components(no_docs).count() == 0


def test_keep_one_odd_rows(odd_docs):
    out = simhash.keep_one(odd_docs)
    assert out.columns == odd_docs.columns
    got = [r.doc_id for r in out.collect()]
    assert sorted(x for x in got) == [1, 2, 5, 6, 8, 9, 10]  # one of the empty texts, and one row of "same text"


def test_prefix_index_finds_what_all_pairs_find():
    rng = np.random.default_rng(9)
    base = np.unique(rng.integers(0, 10**6, 60).astype(np.uint64))
    kept, seen = simhash.Kept(0.8), []
    for i in range(200):
        s = np.unique(np.concatenate([rng.choice(base, rng.integers(20, len(base)), replace=False), rng.integers(0, 10**6, rng.integers(0, 12)).astype(np.uint64)]))
        assert [k for k in kept.meets(s) if kept.similar(k, s)] == [k for k, t in enumerate(seen) if alike(set(s.tolist()), t) >= 0.8]
        kept.add(i, s)
        seen.append(set(s.tolist()))


def test_every_pair_of_the_similarity_is_within_a_component(spark):
    rng = np.random.default_rng(12)
    word = lambda: "".join(chr(97 + int(c)) for c in rng.integers(0, 26, 7))
    texts = []
    for _ in range(150):  # near 0.8: 40 shingles, of which the copy's last or first few are others
        words = [word() for _ in range(44)]
        k = int(rng.integers(3, 5))
        texts += [" ".join(words), " ".join(words[:-k] + [word() for _ in range(k)])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = shingle_sets(docs)
    pairs = [(a, a + 1) for a in range(0, 300, 2) if alike(sets[a], sets[a + 1]) >= 0.8]
    of = {r.doc_id: r.component_id for r in simhash.wide_components(docs).collect()}
    assert len(pairs) > 100 and all(of[a] == of[b] for a, b in pairs)
    assert len(set(of.values())) == 150


@pytest.mark.parametrize("part_rows", [1, 500])
def test_one_of_a_chain_of_near_copies_stays(spark, part_rows):
    words = [f"w{i}" for i in range(84)]  # 80 shingles
    left, right = [f"l{i}" for i in range(8)] + words[8:], words[:-8] + [f"r{i}" for i in range(8)]
    docs = spark.createDataFrame([(1, " ".join(left)), (2, " ".join(words)), (3, " ".join(right)), (4, "quite another text " * 3)], "doc_id long, text string")
    sets = shingle_sets(docs)
    assert alike(sets[1], sets[2]) >= 0.8 and alike(sets[2], sets[3]) >= 0.8 and alike(sets[1], sets[3]) < 0.8
    assert sorted(r.doc_id for r in simhash.keep_one(docs, part_rows=part_rows).collect()) == [1, 4]


@pytest.mark.parametrize(("sizes", "shared"), [((40, 300), 0.2), ((250, 270), 0.2), ((500, 1100), 0.2)])
def test_parity_bits_rule_out_no_similar_pair(spark, sizes, shared):
    """Sets on both sides of a border of widths, edited to similarities around 0.8."""
    rng = np.random.default_rng(sizes[0])
    texts = []
    for _ in range(60):
        words = [f"w{x}" for x in rng.integers(0, 10**9, int(rng.integers(*sizes)))]
        n = len(words)
        cut = int(n * rng.uniform(0, shared))
        texts += [" ".join(words), " ".join(words[: n - cut] + [f"x{x}" for x in rng.integers(0, 10**9, int(cut * rng.uniform(0, 1.2)))])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = shingle_sets(docs)
    want = sorted({a if alike(sets[a], sets[a + 1]) >= 0.8 else d for a in range(0, 120, 2) for d in (a, a + 1)})
    assert 60 < len(want) < 120 and sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == want


def test_repeated_rows_and_null_ids_keep_one(spark):
    rows = [(None, "one and the same text of words", 1), (None, "one and the same text of words", 2), (3, "another text that stands here twice", 1), (3, "another text that stands here twice", 2), (3, "and a third one under that id too", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _a long")
    found = simhash.keep_one(docs).collect()
    assert {tuple(r) for r in found} <= set(rows)
    got = sorted((str(r.doc_id), r.text) for r in found)
    assert got == [("3", "and a third one under that id too"), ("3", "another text that stands here twice"), ("None", "one and the same text of words")]
