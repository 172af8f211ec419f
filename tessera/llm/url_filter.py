"""Operator 8: URL rules and lists through a blocked Bloom filter.

A listed entry is a canonical URL, host and path together: without a path it
stands for a host with its subdomains, with one for that path and, where it
ends in ``/``, for all below it. A rule is an entry too, which fits any path
that starts with its own. From a URL come all keys that could be listed: each
suffix of its canonical host (without user, port and final stops) at a label
border, no longer in labels than any listed host, alone and with the prefixes
of its path that end in ``/``, no deeper than any listed path, and the whole
path; for rules, each suffix of the host as it stands with each prefix of the
path that has the length of a rule's. So the keys of a URL are bounded by the
lists, and lists may be long while rules are few.

A blocked Bloom filter (four bits in one block of 256 for each key) is built by
the executors, block by block, and probed in numpy; keys that may be listed go
on to an exact join, which removes the false ones. It has at least
``bits_per_key`` bits for each counted entry, up to ``2**most_block_bits``
blocks (32 MB); a longer list gives more false hits, which the join removes.
Of the rules that fit a URL the longest wins, of equally long ones that with
the longer host, and then the one that blocks. Where no rule fits, a listed
URL blocks.

The list joins by broadcast only up to a counted ``most_broadcast`` entries;
beyond it the join is a shuffle that Spark may split by size. Nulls and URLs
without ``://`` have an empty host and path and no rule. Very long URLs have no
more keys than others. Repeated rows give one result each, null ids pass
through, empty tables of pages or entries are fine, extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules as (action, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Words that hosts of link farms are named after, two by two, and the domains of documentation.
FIRST = "best big bulk buy cash cheap click daily direct discount easy extra fast free fresh get hot instant lucky mega new online quick real secret seo simple spam super top total ultra win".split()
SECOND = "bets bonus casino clicks codes coins coupons credit deals diet downloads farm gifts hacks links loans lottery meds money movies offers pills poker prizes promo ranks replica sale shop slots traffic wins".split()
DOMAINS = ["example.com", "example.net", "example.org"]


def link_farms() -> list[tuple[str, str, str]]:
    """The list of the registered query, by its rule: every first word with every second one under every domain."""
    return [("block", f"{a}-{b}.{d}", "") for a in FIRST for b in SECOND for d in DOMAINS]


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


ENTRY = "key string, action string, host_length int, labels int, path_length int, slashes int, is_rule boolean"


def entries_of(table: DataFrame, is_rule: bool) -> DataFrame:
    """Entries from a table of ``action, host, path``, as the list of an input table comes."""
    host = F.translate("host", UPPER, LOWER)
    host = host if is_rule else canonical(host)
    slashes = F.length("path") - F.length(F.translate("path", "/", ""))
    return table.select(
        F.concat(F.lit("R" if is_rule else "L"), host, "path").alias("key"), "action", F.length(host).alias("host_length"), F.size(F.split(host, r"\.")).alias("labels"), F.length("path").alias("path_length"), slashes.alias("slashes"), F.lit(is_rule).alias("is_rule")
    ).distinct()


def listing(spark: SparkSession, rules: list[tuple[str, str, str]], listed: list[tuple[str, str, str]]) -> DataFrame:
    """Entries of short lists, as rows of ``action, host, path``."""
    made = lambda rows: spark.createDataFrame(rows, "action string, host string, path string")
    return entries_of(made(rules), True).unionByName(entries_of(made(listed), False))


def canonical(host: Column) -> Column:
    """A host without its user, port and final stops."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), "[.]*(:[0-9]*)?$", "")


class BlockedBloom:
    """Blocks of four 64-bit words; a key sets four bits of one block."""

    def __init__(self, keys: DataFrame, block_bits: int) -> None:
        h = F.xxhash64("key")
        block = F.shiftrightunsigned(h, 64 - block_bits)
        bits = F.array(*(F.shiftrightunsigned(h, 8 * i).bitwiseAND(255) for i in range(4)))
        rows = keys.select(block.alias("block"), F.explode(bits).alias("bit"))
        words = rows.groupBy("block", F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask"))
        self.block_bits, self.table = block_bits, np.zeros((1 << block_bits, 4), np.uint64)
        for r in words.toLocalIterator():
            self.table[r.block, r.word] = np.int64(r.mask).view(np.uint64)

    def may_have(self, hashes: np.ndarray) -> np.ndarray:
        h = hashes.view(np.uint64)
        block, found = (h >> np.uint64(64 - self.block_bits)).astype(np.int64), np.ones(len(h), bool)
        for i in range(4):
            bit = (h >> np.uint64(8 * i)) & np.uint64(255)
            found &= (self.table[block, (bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found


def _suffixes(host: Column, labels: int) -> Column:
    every = F.split(host, r"\.")
    n = F.size(every)
    return F.transform(F.sequence(F.lit(1), F.least(n, F.lit(max(1, labels)))), lambda k: F.array_join(F.slice(every, n - k + 1, k), "."))


def _crossed(mark: str, suffixes: Column, paths: Column) -> Column:
    return F.flatten(F.transform(suffixes, lambda s: F.transform(paths, lambda p: F.concat(F.lit(mark), s, p))))


def candidate_keys(host: Column, path: Column, labels: int, lengths: list[int], listed_labels: int, slashes: int) -> Column:
    """All keys of a URL that could be entries: ``labels`` and ``lengths`` bound those of rules, the others those of the list."""
    starts = F.filter(F.array(*(F.when(F.length(path) >= m, F.substring(path, 1, m)) for m in lengths)), lambda p: p.isNotNull()) if lengths else F.array().cast("array<string>")
    parts = F.slice(F.split(path, "/", slashes + 2), 1, slashes + 1)
    depth = F.least(F.size(F.split(path, "/", slashes + 2)) - 1, F.lit(slashes))
    folders = F.when(depth > 0, F.transform(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), lambda k: F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    paths = F.array_distinct(F.concat(F.array(F.lit("")), folders, F.array(path)))
    return F.concat(_crossed("R", _suffixes(host, labels), starts), _crossed("L", _suffixes(canonical(host), listed_labels), paths))


def block_bits_for(n: int, bits_per_key: int = 12, most: int = 20) -> int:
    """The filter's size for ``n`` keys: ``2**bits`` blocks of 256 bits."""
    return min(most, max(4, (-(-n * bits_per_key // 256) - 1).bit_length()))


def judge(pages: DataFrame, entries: DataFrame, bits_per_key: int = 12, most_block_bits: int = 20, most_broadcast: int = 50_000) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict``."""
    of_rules, listed = F.col("is_rule"), ~F.col("is_rule")
    shape = entries.agg(
        F.max(F.when(of_rules, F.col("labels"))).alias("labels"), F.collect_set(F.when(of_rules, F.col("path_length"))).alias("lengths"),
        F.max(F.when(listed, F.col("labels"))).alias("listed_labels"), F.max(F.when(listed, F.col("slashes"))).alias("slashes"), F.count(F.lit(1)).alias("n"),
    ).first()
    bloom = BlockedBloom(entries, block_bits_for(shape.n, bits_per_key, most_block_bits))

    @F.pandas_udf("array<int>")
    def possible(hashes: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in hashes:
            sizes = s.map(len).to_numpy()
            hit = bloom.may_have(np.concatenate([*s, np.zeros(0, np.int64)]).astype(np.int64))
            at = np.concatenate([np.arange(k) for k in sizes] or [np.zeros(0, int)])
            ends = np.cumsum(sizes)
            yield pd.Series([at[e - k : e][hit[e - k : e]].astype(np.int32) for k, e in zip(sizes, ends, strict=True)], index=s.index)

    rest = after_scheme(F.col("url"))
    rows = pages.select(
        F.monotonically_increasing_id().alias("rid"), "page_id",
        F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER).alias("host"), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1).alias("path"),
    )
    keyed = rows.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), shape.labels or 1, sorted(shape.lengths), shape.listed_labels or 1, shape.slashes or 0))
    probed = keyed.withColumn("hits", possible(F.transform("keys", lambda k: F.xxhash64(k))))
    asked = probed.select("rid", "page_id", "host", "path", F.explode_outer("hits").alias("hit"), "keys").withColumn("key", F.get("keys", F.col("hit"))).drop("hit", "keys")
    exact = entries.select("key", "action", "host_length", "is_rule")
    met = asked.join(F.broadcast(exact) if shape.n <= most_broadcast else exact, "key", "left")
    rank = F.struct((F.length("key") - 1).alias("a"), F.col("host_length").alias("b"), (F.col("action") == "block").alias("c"), F.col("key").alias("key"), F.col("action").alias("action"))
    best = met.groupBy("rid", "page_id", "host", "path").agg(F.max(F.when(F.col("is_rule"), rank)).alias("rule"), F.max(F.when(~F.col("is_rule"), rank)).alias("listed"))
    return best.select("page_id", "host", "path", F.substr("rule.key", F.lit(2)).alias("rule"), F.coalesce(F.col("rule.action"), F.col("listed.action"), F.lit("allow")).alias("verdict"))


SQL = f"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
urls AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(action, h, p) AS (VALUES {", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES)}),
fits AS (
  SELECT u.*, r.h || r.p AS rule, r.action,
         row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.h || r.p) DESC, length(r.h) DESC, r.action DESC) AS place
  FROM urls u LEFT JOIN rules r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p))
SELECT page_id, host, path, rule,
       CASE WHEN rule IS NOT NULL THEN action
            WHEN regexp_matches(host, '(^|[.@])({"|".join(FIRST)})-({"|".join(SECOND)})[.]({"|".join(DOMAINS).replace(".", "[.]")})[.]*(:[0-9]*)?$') THEN 'block' ELSE 'allow' END AS verdict
FROM fits WHERE place = 1
"""
