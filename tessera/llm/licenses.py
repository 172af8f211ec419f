"""Operator 7: licence scans by diagonal voting.

Every rolling pair and run of four words of a text is hashed and joined to the
positions of the templates: phrases and notices by pairs, whole texts of
licences (:data:`LONG` words and more) by fours. A match of document word ``p`` with template word ``t`` votes for the
diagonal ``p - t``: the place where the template would start. Votes are held
against the words themselves. A phrase stands where a diagonal has all of its
votes. For the licences diagonals at most ``slack`` apart are merged, so a
dropped or added word does not split a span, and a span is verified when its
votes cover ``share`` of the template's words, each counted once. The score of
a document is the largest such share of any of its spans, 1 for a phrase.

The templates are fixed here, so their table is bounded and is broadcast; the
scan, the hashes and the join form one stage, and only votes and one row per
document are shuffled, by row. Nulls count as empty texts with no words, very
long texts are scanned whole. Repeated rows give one result each (rows are told
apart by their place in the scan). Null ids pass through. An empty table gives
an empty result. Extra columns are not read. DataFrame functions only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import whole_text
from tessera.llm.licence_texts import TEXTS

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The phrases of the base and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a run, of short templates and of those from LONG words on.
PAIR, RUN, LONG = 2, 4, 20
MARK = -1


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(UPPER, LOWER)))


def templates() -> list[tuple[list[str], str, bool]]:
    """Words, label, and whether it is a phrase of the base."""
    return [(t.split(), label, True) for t, label in PHRASES.items()] + [(template_words(t), label, False) for label, t in TEXTS]


def _templates(docs: DataFrame) -> DataFrame:
    """A row for each run of each template: ``h, template, t, run, size`` (its words), ``label, base``; and one that all documents meet."""
    rows = [(MARK, 0, [], 1, "", True)]
    for k, (words, label, base) in enumerate(templates()):
        n = PAIR if len(words) < LONG else RUN
        rows += [(k, t, words[t : t + n], len(words), label, base) for t in range(len(words) - n + 1)]
    quoted = lambda words: "array(" + ", ".join(f"'{w}'" for w in words) + ")" if words else "cast(array() AS array<string>)"
    values = ", ".join(f"({k}, {t}, {quoted(run)}, {n}, '{label}', {str(base).lower()})" for k, t, run, n, label, base in rows)
    made = docs.sparkSession.sql(f"SELECT * FROM VALUES {values} AS made(template, t, run, size, label, base)")
    hashed = lambda n: F.xxhash64(*(F.get("run", F.lit(k)) for k in range(n)))
    return made.withColumn("h", F.when(F.size("run") == PAIR, hashed(PAIR)).when(F.size("run") == RUN, hashed(RUN)).otherwise(F.lit(0).cast("long")))


def _rolling(words: str, n: int) -> Column:
    """Hashes of all runs of ``n`` words."""
    starts = F.size(words) - n
    return F.when(starts >= 0, F.transform(F.sequence(F.lit(0), F.greatest(starts, F.lit(0))), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(n))))).otherwise(F.array().cast("array<long>"))


def votes(docs: DataFrame) -> DataFrame:
    """``rid, doc_id, n_words`` with one row per verified vote (``template, size, label, base, diagonal, t``) and one with template -1 per document."""
    words = F.filter(F.split(F.translate(whole_text(), UPPER, LOWER), NOT_WORD), lambda w: w != "")
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), words.alias("words"))
    hashes = F.concat(F.array(F.lit(0).cast("long")), _rolling("words", PAIR), _rolling("words", RUN))
    placed = rows.select("rid", "doc_id", "words", F.posexplode(hashes).alias("p", "h"))
    hits = placed.join(F.broadcast(_templates(docs)), "h")
    pairs = F.greatest(F.size("words") - (PAIR - 1), F.lit(0))
    at = F.when(F.size("run") == PAIR, F.col("p") - 1).otherwise(F.col("p") - 1 - pairs)
    mark = (F.col("template") == MARK) & (F.col("p") == 0)
    own = F.when(F.size("run") == PAIR, (F.col("p") > 0) & (F.col("p") <= pairs)).otherwise(F.col("p") > pairs)
    same = (F.col("template") != MARK) & own & (F.slice("words", F.greatest(at, F.lit(0)) + 1, F.size("run")) == F.col("run"))
    return hits.where(mark | same).select("rid", "doc_id", F.size("words").cast("long").alias("n_words"), "template", "size", "label", "base", (at - F.col("t")).alias("diagonal"), "t")


def scan(docs: DataFrame, slack: int = 2, share: float = 0.8) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``."""
    dealt = votes(docs).repartition("rid")
    diagonals = dealt.groupBy("rid", "doc_id", "n_words", "template", "size", "label", "base", "diagonal").agg(F.collect_set("t").alias("ts"))
    by_place = W.partitionBy("rid", "template").orderBy("diagonal")
    apart = F.col("base") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by_place) > slack, F.lit(True))
    spans = diagonals.withColumn("span", F.sum(apart.cast("int")).over(by_place))
    run = F.when(F.col("size") < LONG, PAIR).otherwise(RUN)
    spans = spans.groupBy("rid", "doc_id", "n_words", "template", "size", "label", "base", "span").agg(F.min("diagonal").cast("long").alias("start"), F.array_distinct(F.flatten(F.collect_list("ts"))).alias("ts"))
    spans = spans.withColumns({"got": F.size("ts"), "part": F.size(F.array_distinct(F.flatten(F.transform("ts", lambda t: F.sequence(t, t + run - 1))))) / F.col("size")})
    real = F.col("template") != MARK
    place = real & F.col("base") & (F.col("got") == F.col("size") - 1)
    found = place | (real & ~F.col("base") & (F.col("part") >= share))
    names = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")
    return (
        spans.groupBy("rid", "doc_id", "n_words")
        .agg(
            F.count(F.when(place, 1)).alias("n_base"), F.min(F.when(place, F.col("start"))).alias("first_word"), F.max(F.when(place, F.col("start"))).alias("last_word"),
            names(place).alias("base_labels"), names(found).alias("labels"), F.coalesce(F.max(F.when(place, 1.0).when(real & ~F.col("base"), F.col("part"))), F.lit(0.0)).alias("score"),
        )
        .drop("rid")
    )
