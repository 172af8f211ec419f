import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline", exc_type=ModuleNotFoundError)
from tessera.llm.common import table, written  # noqa: E402

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def test_stages_take_effect(spark):
    docs = table(spark, DIR, "documents")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, DIR), "stage")
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == before.columns and docs.schema == before.schema
        if name == "exact dedup":
            assert docs.select("text").distinct().count() == counts[-1] == before.select("text").distinct().count()
    assert counts[0] > counts[1] > counts[2] >= counts[3] > 0 and counts[4] > 0 and counts[5] >= counts[4]


def test_run(spark):
    assert corpus_pipeline.run(spark, DIR).columns[:3] == ["doc_id", "start", "length"]
    assert corpus_pipeline.ORACLE_SQL is None


def saved(docs, labels, path):
    docs.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_every_stage_against_brute_force(spark, corpus, tmp_path):
    """Each stage on all that its predecessor kept, and run() as the last of them."""
    import duckdb

    from tessera.llm import mixing, quality
    from tests.llm import test_packing, test_simhash

    labels = corpus.selectExpr("doc_id", "CAST(size(split(text, '\\n')) < 5 AS INT) AS quality", "0 AS toxic")
    d = saved(corpus, labels, tmp_path)
    stages = dict(corpus_pipeline.STAGES)
    docs = table(spark, d, "documents")
    good = {r.doc_id for r in quality.assess(docs, quality.fit(docs, labels)).collect() if r.kept}  # held against walked trees in test_quality
    one = written(stages["quality rules"](spark, docs, d), "stage")
    assert {r.doc_id for r in one.collect()} == good and 0 < len(good) < docs.count()
    least = {}
    for r in one.collect():
        least[r.text] = min(least.get(r.text, r.doc_id), r.doc_id)
    two = written(stages["exact dedup"](spark, one, d), "stage")
    assert sorted(r.doc_id for r in two.collect()) == sorted(least.values()) and two.count() < one.count()
    three = written(stages["simhash near-dedup"](spark, two, d), "stage")
    assert sorted(r.doc_id for r in three.collect()) == sorted(set(test_simhash.groups_of(test_simhash.shingle_sets(two)).values())) and three.count() < two.count()
    four = written(stages["mixing"](spark, three, d), "stage")
    con = duckdb.connect()
    con.register("documents", three.toArrow())
    taken = {r[0]: r[-1] for r in con.execute(mixing.SQL).fetchall()}
    words = {}
    for r in four.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert words == {k: n for k, n in taken.items() if n}
    five = stages["packing"](spark, four, d).collect()
    test_packing.check(five, [(r.doc_id, r.text) for r in four.collect()], 2048)
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)
    assert sorted(map(key, corpus_pipeline.run(spark, d).collect())) == sorted(map(key, five))


def test_odd_rows_and_empty_tables_run(spark, odd_docs, no_docs, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    assert corpus_pipeline.run(spark, saved(odd_docs, labels, tmp_path / "odd")).count() > 0
    assert corpus_pipeline.run(spark, saved(no_docs, labels.limit(0), tmp_path / "none")).count() == 0
    docs = odd_docs
    for _, stage in corpus_pipeline.STAGES[1:4]:  # without the rules, which reject most of these rows
        docs = written(stage(spark, docs, str(tmp_path / "odd")), "stage")
        assert docs.columns == odd_docs.columns and docs.count() > 0


def test_what_stages_needed_is_removed(spark, corpus, tmp_path):
    from tessera.plans.loop import shared_dir

    d = saved(corpus, corpus.selectExpr("doc_id", "1 AS quality", "0 AS toxic"), tmp_path)
    tables = os.path.join(shared_dir(spark), "tables")
    before = set(os.listdir(tables)) if os.path.isdir(tables) else set()
    corpus_pipeline.run(spark, d)
    assert [x.rsplit("-", 1)[0] for x in set(os.listdir(tables)) - before] == ["packing"]
