import re

import pytest
from pyspark.sql import functions as F

from tessera.llm.url_filter import RULES, BlockedBloom, block_bits_for, entries_of, judge, link_farms, listing

LISTED = [*link_farms(), ("block", "news.Example.org", "/a/b/"), ("block", "example.org", "/one"), ("block", "ads.example.org.", "")]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:end]), rest[end:]
        path = tail[: min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), len(h), a == "block", h + p, a) for a, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    bare = re.sub(r"[.]*(:[0-9]*)?$", "", host.rpartition("@")[2])
    below = lambda p, q: not q or p == q or (q.endswith("/") and p.startswith(q))
    listed = any((bare == h or bare.endswith("." + h)) and below(path, p) for _, h, p in ((a, h.lower().rstrip("."), p) for a, h, p in LISTED))
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "block" if listed else "allow"


URLS = [
    "http://a.example.com/en/1", "https://www.example.com/en/2?x", "http://WWW.Example.COM/en/", "http://example.com", "http://example.com/", "http://com/", "http://xcom/", "http://a.net/es/1", "http://a.net/es",
    "http://net/fr/?q", "nothing", "", None, "http://", "ftp://u@h.example.org:80/p#f", "http://spam-farm.example.org/en/728", "https://www.cheap-pills.example.net?x", "x://y://z.com/", "http://news.example.org/a/b/c/d", "http://news.example.org/a/bc", "http://x.example.org/one", "http://x.example.org/one/two", "http://me@ads.example.org:8080/x", "http://ads.example.org./", "http://free-casino.example.org:80?q", "http://h.org/" + "a/" * 5000, "http://a..com/", "http://é.COM/É", "http://" + "a." * 3000 + "com/",
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, u, "<p>", "a", "b", "c") for i, u in enumerate([*URLS, URLS[0]])] + [(None, URLS[1], None, None, None, None)], "page_id long, url string, html string, key string, host string, rid string")


@pytest.mark.parametrize("most_broadcast", [50_000, 0])
def test_verdicts(spark, pages, most_broadcast):
    got = judge(pages, listing(spark, RULES, LISTED), most_broadcast=most_broadcast).collect()
    want = sorted(str((r.page_id, *brute(r.url))) for r in pages.collect())
    assert sorted(str((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in got) == want


def test_empty(spark, pages):
    assert judge(pages.limit(0), listing(spark, RULES, LISTED)).count() == 0
    assert {r.verdict for r in judge(pages, listing(spark, RULES, LISTED).limit(0)).collect()} == {"allow"}


def test_a_long_list(spark):
    """A list of 150,000 canonical URLs in a table: the filter follows its count, and the join is exact."""
    n = 150_000
    table = spark.range(n).select(F.lit("block").alias("action"), F.concat(F.lit("Host"), "id", F.lit(".example.org")).alias("host"), F.when(F.col("id") % 2 == 0, "").otherwise(F.concat(F.lit("/p"), F.col("id"), F.lit("/"))).alias("path"))
    entries = entries_of(table, False).unionByName(listing(spark, RULES, []))
    pages = spark.range(0, 2 * n, 37).select(F.col("id").alias("page_id"), F.concat(F.lit("http://www.host"), "id", F.lit(".example.org/p"), "id", F.lit("/x")).alias("url"))
    got = {r.page_id: r.verdict for r in judge(pages, entries).collect()}
    assert got == {i: "block" if i < n else "allow" for i in range(0, 2 * n, 37)}


@pytest.mark.parametrize("n", [2000, 120_000])
def test_bloom_has_no_false_negatives_and_few_false_positives(spark, n):
    keys = spark.range(n).select(F.concat(F.lit("host"), "id").alias("key"))
    bloom = BlockedBloom(keys, block_bits_for(n))
    hashes = lambda df: df.select(F.xxhash64("key").alias("h")).toPandas()["h"].to_numpy()
    assert bloom.may_have(hashes(keys)).all()
    other = spark.range(100_000).select(F.concat(F.lit("other"), "id").alias("key"))
    assert bloom.may_have(hashes(other)).mean() < 0.02
    assert 12 * n <= 256 << block_bits_for(n) <= 4 * 12 * n
