import hashlib
from collections import defaultdict

import pytest

from tessera.llm.exact_dedup import drop_duplicates, exact_groups


def brute(rows, best):
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    return {t: (best((x for x in ids if x is not None), default=None), len(ids)) for t, ids in groups.items()}


@pytest.mark.parametrize(("keep", "best"), [("smallest", min), ("largest", max)])
@pytest.mark.parametrize("hot_rows", [1, 2, 1000])
def test_groups(corpus, odd_docs, keep, best, hot_rows):
    for docs in (corpus, odd_docs):
        source = docs.select("doc_id", "text").collect()
        want = brute(source, best)
        by_text = defaultdict(list)
        for r in exact_groups(docs, keep, hot_rows=hot_rows).collect():
            by_text[r.text_sha256].append(r)
        assert sum(map(len, by_text.values())) == len(source)
        for t, (kept, size) in want.items():
            rows = by_text[hashlib.sha256(t.encode()).hexdigest()]
            assert len(rows) == size and {(r.keep_id, r.group_size) for r in rows} == {(kept, size)}
            assert [r.doc_id for r in rows if r.kept] == [kept]


def test_empty_and_unknown(no_docs):
    assert exact_groups(no_docs).count() == 0
    with pytest.raises(ValueError):
        exact_groups(no_docs, "first")


def test_drop_duplicates_keeps_columns(corpus):
    out = drop_duplicates(corpus)
    texts = [r.text for r in corpus.collect()]
    assert out.columns == corpus.columns and sorted(r.text for r in out.collect()) == sorted(set(texts))


def test_the_plan_is_native_and_range_partitioned(corpus):
    plan = exact_groups(corpus)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("hot_rows", [1, 1000])
@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_one_row_of_each_text_stays(spark, odd_docs, no_docs, keep, hot_rows):
    """Repeated rows, null ids, and one id with two texts."""
    rows = [(1, "t", "x"), (1, "t", "x"), (2, "t", "y"), (None, "t", "y"), (None, "t", None), (3, "u", "x"), (4, "u", "x"), (4, "w", "x"), (None, "z", "p"), (None, "z", "q"), (5, None, "x"), (6, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    best = min if keep == "smallest" else max
    got = drop_duplicates(docs, keep, hot_rows=hot_rows).collect()
    assert {tuple(r) for r in got} <= set(rows)
    want = {t: ids[0] for t, ids in brute(docs.collect(), best).items()}
    assert len(got) == len(want) and {r.text or "": r.doc_id for r in got} == want
    out = drop_duplicates(odd_docs, keep, hot_rows=hot_rows)
    assert out.schema == odd_docs.schema and sorted(r.text or "" for r in out.collect()) == sorted({r.text or "" for r in odd_docs.collect()})
    assert drop_duplicates(no_docs).count() == 0


def test_texts_cross_the_network_once(corpus):
    out = drop_duplicates(corpus)
    out.collect()
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "SortMergeJoin" not in plan
    final = plan.split("== Physical Plan ==")[1].split("== Initial Plan ==")[0]
    assert final.count("REPARTITION") == 1 or final.count("ReusedExchange") >= 1
