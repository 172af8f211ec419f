"""Operator 10: mixing sources to target weights by capped water-filling.

Sources, by code point with null last, weigh 1, 2, 3, 1, 2, 3 and so on. The
mix has as many words as the input. A source's target is ``level * weight``,
or ``cap`` times its own words where that is less; the level is the one at
which targets add up. With sources by rising ``cap * words / weight`` and the
first k of them capped, the rest would stand at

    level(k) = (all words - cap * words of the first k) / weights of the rest

which rises up to the right k and falls after it, so the level is the largest.

A source then takes each document ``target div words`` times, and what is left
over from a seeded sample: documents in the order of a keyed hash of their id,
until the words are used up; the document at the border gives a part. The
border is found digit by digit: sums over 256 buckets of the hash for each
source, combined before the shuffle, name the bucket that the border lies in,
and only its documents are summed again by the next digits. So no task sees
more than 256 rows of a source, and the documents join a table of one row per
source.

Nulls count as empty texts; a source without words has target 0. Very long
texts are counted whole. Repeated rows of one id share what the border gives,
each rounded down. An empty table gives an empty result. Extra columns are not
read. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import WORD, discard, written

#: Hexadecimal digits of the hash that one step looks at.
DIGITS = 2


def size_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def _keyed(docs: DataFrame, seed: int, whole: bool = False) -> DataFrame:
    """Source as a key that is never null and keeps the order, size, and the place in the seeded order; with ``whole`` the row too, as ``_doc``."""
    return docs.select(
        *([F.struct(*(docs[c] for c in docs.columns)).alias("_doc")] if whole else [docs["doc_id"]]),
        F.when(docs["source"].isNull(), "1").otherwise(F.concat(F.lit("0"), docs["source"])).alias("_key"),
        size_of(F.coalesce(docs["text"], F.lit(""))).alias("_size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(docs["doc_id"].cast("string"), F.lit("")))).alias("_place"),
    )


def _buckets(rows: DataFrame, digits: int) -> DataFrame:
    """Words of each source by the first ``digits`` of the hash, and whether there is one hash only."""
    return rows.groupBy("_key", F.substring("_place", 1, digits).alias("bucket")).agg(F.sum("_size").alias("bucket_size"), F.min("_place").alias("low"), F.max("_place").alias("high"))


def _border(buckets: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bucket of each source in which ``wanted(_key, left_over)`` words are reached, and how many of it are left over."""
    upto = F.sum("bucket_size").over(W.partitionBy("_key").orderBy("bucket"))
    reached = buckets.withColumn("upto", upto).join(wanted, "_key").where("upto - bucket_size < left_over AND left_over <= upto")
    return reached.select("_key", "bucket", "low", "high", "bucket_size", (F.col("left_over") - F.col("upto") + F.col("bucket_size")).alias("left_over"))


def plan(sized: DataFrame, cap: int = 3, cycle: int = 3, digits: int = DIGITS) -> DataFrame:
    """One row per source: ``_key, source_size, target, whole, cut_place, cut_words, cut_size``.

    ``sized`` has ``_key, _size, _place``. The windows without a partition are
    over one row per source.
    """
    buckets = written(_buckets(sized, digits), "buckets")
    sources = buckets.groupBy("_key").agg(F.sum("bucket_size").alias("source_size"))
    sources = sources.withColumn("weight", (F.row_number().over(W.orderBy("_key")) - 1) % cycle + 1)
    rising = W.orderBy((cap * F.col("source_size")).cast("double") / F.col("weight"), "_key")
    before = rising.rowsBetween(W.unboundedPreceding, -1)
    level = (F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0))).cast("double") / F.sum("weight").over(rising.rowsBetween(W.currentRow, W.unboundedFollowing))
    sources = sources.withColumn("at", level).withColumn("level", F.max("at").over(W.partitionBy()))
    sources = sources.withColumn("target", F.round(F.least((cap * F.col("source_size")).cast("double"), F.col("level") * F.col("weight")), 6))
    words = F.floor(F.col("target") + 0.5)
    sources = sources.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long"))
    sources = written(sources.withColumn("extra", (words - F.col("whole") * F.col("source_size")).cast("long")).drop("weight", "at", "level"), "shares")

    at, border = digits, written(_border(buckets, sources.select("_key", F.col("extra").alias("left_over"))), "border")
    steps = [border]
    while not (open_ones := border.where("low <> high")).isEmpty():
        inside = _by_source(sized, open_ones.select("_key", "bucket", "left_over")).where(F.substring("_place", 1, at) == F.col("bucket"))
        at += digits
        border = written(_border(_buckets(inside, at), open_ones.select("_key", "left_over")), "border")
        steps.append(border)
    cut = steps[0].where("low = high")
    for step in steps[1:]:
        cut = cut.unionByName(step.where("low = high"))
    cut = cut.select("_key", F.col("low").alias("cut_place"), F.col("left_over").alias("cut_words"), F.col("bucket_size").alias("cut_size"))
    out = written(sources.join(cut, "_key", "left"), "sources")
    discard(buckets, sources, *steps)
    return out


_EXTRA = "CASE WHEN cut_place IS NULL OR _place > cut_place THEN 0L WHEN _place < cut_place THEN _size ELSE (cut_words * _size) div cut_size END"


def _by_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` with what is known of their source: broadcast up to a counted 20,000 sources, else a join that Spark may split."""
    return rows.join(F.broadcast(sources) if sources.count() <= 20_000 else sources, "_key")


def mix(docs: DataFrame, cap: int = 3, seed: int = 20, digits: int = DIGITS) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken``."""
    sized = written(_keyed(docs, seed), "sized")
    sources = plan(sized, cap, digits=digits)
    return _by_source(sized, sources).select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("whole") * F.col("_size") + F.expr(_EXTRA)).alias("taken"))


def mixed_documents(docs: DataFrame, cap: int = 3, seed: int = 20, digits: int = DIGITS) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``.

    The document at a source's border appears once with its first words only,
    and ``n_chars``, where there is one, follows its text.
    """
    keyed = _keyed(docs, seed, whole=True)
    sized = written(keyed.select("_key", "_size", "_place"), "sized")
    sources = plan(sized, cap, digits=digits)
    discard(sized)
    rows = _by_source(keyed, sources).select("_doc", "_size", "whole", F.expr(_EXTRA).alias("extra")).where("whole > 0 OR extra > 0")
    copies = F.col("whole").cast("int") + (F.col("extra") > 0).cast("int")
    out = rows.select("_doc", "whole", "extra", "_size", F.explode(F.sequence(F.lit(1), copies)).alias("copy"))
    part = (F.col("copy") > F.col("whole")) & (F.col("extra") < F.col("_size"))
    text = F.col("_doc")["text"]
    first = F.array_join(F.slice(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""), F.lit(1), F.greatest("extra", F.lit(1).cast("long")).cast("int")), " ")
    fields = {c: F.col("_doc")[c] for c in docs.columns}
    fields["text"] = F.when(part, first).otherwise(text)
    if "n_chars" in fields:
        fields["n_chars"] = F.when(part, F.length(first)).otherwise(fields["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return out.select(*(v.alias(k) for k, v in fields.items()))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('20:' || CAST(doc_id AS VARCHAR)) AS place
  FROM documents),
weighed AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, CAST((SELECT sum(source_size) FROM weighed) - coalesce(sum(3 * source_size) OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / CAST(sum(weight) OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lvl
  FROM weighed),
targets AS (
  SELECT source, source_size, round(least(CAST(3 * source_size AS DOUBLE), (SELECT max(lvl) FROM levels) * weight), 6) AS target FROM levels),
split AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS whole FROM targets),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.whole, CAST(floor(t.target + 0.5) AS BIGINT) - t.whole * t.source_size AS extra,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.place, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN split t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, extra - before)) AS BIGINT) AS taken FROM placed
"""
