import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm.queries import tokenizer
from tessera.llm.token_counts import PrefixCosts, count_tokens, cut_at, prefix_table, tokens_before

tokenizers = pytest.importorskip("tokenizers")
PATH = tokenizer("byte_bpe_50k.json")
PARTS = ["a", "Hello", "don't", "'re", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "é", "e\u0301", "<|endoftext|>", ".", ",", "123", "😀", "\x1c", "\x85", "x.", "\r\n", "!!", "日本", "\x0b"]


def library(text):
    return len(tokenizers.Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids)


ENCODER = tokenizers.Tokenizer.from_file(PATH)


def prefixes(text):
    return [len(ENCODER.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]


def stored(text):
    steps, chars = PrefixCosts.of(PATH).steps([text.encode()])
    assert chars.tolist() == [len(text)]
    return np.concatenate([[0], np.cumsum(steps, dtype=int)]).tolist()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=10).map("".join))
def test_every_prefix(text):
    assert stored(text) == prefixes(text)


def test_every_prefix_of_long_segments():
    """Long words, runs of blanks, scripts without blanks and special strings within them, which go piece by piece."""
    rng = random.Random(8)
    texts = [" " * 300 + "x", "\n" * 150, "=" * 400, "a" * 300, "日本語のテキスト" * 30, "x" * 70 + "<|endoftext|>" + "!" * 80 + "<|endoftext|>", "\u00a0" * 90 + "é" * 80, "don't" * 40, "12345" * 30 + "it's've'x" * 9]
    texts += ["".join(rng.choice([*PARTS, "ing", "tion", "==", "of", "’s"]).strip() or "x" for _ in range(60)) for _ in range(25)]
    for t in texts:
        assert stored(t) == prefixes(t)


def test_merges_give_the_librarys_tokens():
    rng, merges = random.Random(3), PrefixCosts.of(PATH).merges
    for _ in range(400):
        word = "".join(rng.choice("etaoinshrdluü") for _ in range(rng.randint(1, 40)))
        assert merges.encode(word.encode()) == ENCODER.encode(word, add_special_tokens=False).ids
        assert merges.prefixes(word.encode())[-1] == len(merges.encode(word.encode()))


def test_a_word_without_end_takes_linear_time():
    assert stored("ab" * 100_000)[-1] == library("ab" * 100_000)


def test_counts(odd_docs, no_docs, corpus):
    for docs in (odd_docs, corpus):
        want = sorted((str(r.doc_id), len((r.text or "").encode()), library(r.text or "")) for r in docs.collect())
        got = count_tokens(docs, PATH, limit=20).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want and all(r.over_limit == (r.n_tokens > 20) for r in got)
    assert count_tokens(no_docs, PATH).count() == 0 and prefix_table(no_docs, PATH).count() == 0


@pytest.mark.parametrize("budget", [0, 25, 400])
def test_the_stored_table_answers_every_question(spark, corpus, odd_docs, budget):
    texts = [r.text for r in corpus.limit(25).collect()] + [r.text for r in odd_docs.collect() if len(r.text or "") < 9000] + ["a<|endoftext|> " * 90, "b " * 256, "c" * 255, "c" * 256, "=" * 700]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = prefix_table(docs, PATH)
    rows = {r.doc_id: r for r in table.select("*", *(tokens_before(i).alias(f"p{i}") for i in (0, 1, 255, 256, 300, 10**6))).collect()}
    cuts = {r.doc_id: (r.cut_chars, r.cut_tokens) for r in cut_at(table, budget).collect()}
    for d, t in enumerate(texts):
        p = prefixes(t or "")
        assert np.cumsum([0, *rows[d].steps]).tolist() == p and rows[d].n_tokens == p[-1] and rows[d].n_chars == len(p) - 1
        assert [rows[d][f"p{i}"] for i in (0, 1, 255, 256, 300, 10**6)] == [p[min(i, len(p) - 1)] for i in (0, 1, 255, 256, 300, 10**6)]
        cut = max(i for i, n in enumerate(p) if n <= budget)
        assert cuts[d] == (cut, p[cut])


def test_the_query_reads_the_stored_prefixes(corpus):
    plan = count_tokens(corpus, PATH)._jdf.queryExecution().toString()
    assert "steps" in plan and "lows" in plan and plan.count("MapInArrow") >= 1 and "Exchange" not in plan.split("== Physical Plan ==")[1]
    assert count_tokens(corpus, PATH, limit=30).where("cut_tokens > 30 OR (NOT over_limit AND cut_tokens <> n_tokens)").count() == 0
    assert count_tokens(corpus, PATH, limit=30).agg(F.max("cut_tokens")).first()[0] == 30
