import pytest

#: Names that operators use inside; a table may have them too.
CLASHES = "rid string, key string, node string, fp0 string, n string, shard string, digest string, salt string, words string, bucket string, _key string, size string, label string, keep_id string, score string, rest string, hit string, gone string, target string, whole string, extra string, copy string, _doc string, _place string, component_id string, kept string, run string"
N = len(CLASHES.split(","))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties and clashing columns."""
    long = " ".join(f"wort{i % 977} {i}" for i in range(30_000))
    rows = [
        (1, "a few plain words of text that stand here alone today", "en", "s1", 53), (2, None, "en", "s1", None), (3, "", None, "s2", 0), (4, " \t\n ", "en", None, 4),
        (5, long, "en", "s1", len(long)), (6, "same text", "en", "s2", 9), (6, "same text", "en", "s2", 9), (7, "same text", "en", "s3", 9), (None, "same text", None, None, None),
        (None, None, None, None, None), (8, "x" * 5000, "en", "s3", 5000), (9, "Grüße, naïve 日本語 text\u00a0here", "de", "s3", None), (10, "<|endoftext|> <|ENDOFTEXT|>", "en", "s1", None),
    ]
    return spark.createDataFrame([(*r, *[None] * N) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def corpus(spark):
    """Generated documents: prose, near copies, copies and junk, in four sources."""
    import random

    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = [prose(rng.randint(12, 400)) for _ in range(160)]
    for _ in range(30):
        words = rng.choice(texts[:160]).split()
        for _ in range(rng.randint(1, 3)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    texts += [rng.choice(texts) for _ in range(20)] + [(prose(6) + "\n") * 12 for _ in range(20)]
    rows = [(i, t, "en", f"s{rng.choice([0, 0, 0, 1, 2, 3])}", len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
