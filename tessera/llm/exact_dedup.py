"""Operator 2: exact duplicates by a content sort.

Rows are range-partitioned by sampled splitters over the first bytes of the
normalised text, its digest and a salt, sorted within partitions (externally:
Spark's sorter spills), so that equal texts are neighbours. Each text is held
whole against its predecessor; a run of equal texts is a group, and its
smallest (or largest) id stays. Splitters are short, whatever the texts.

A group with more than ``max(1000, rows / 10000)`` rows is hot. There are fewer
than 10,000 of those, so their digests fit a broadcast; their rows get a salt
from their id, so that a group is dealt over many tasks, each of which sorts
and compares a part. The first text of each part then meets the others of its
digest in a second comparison. No text is compared by digest alone.

:func:`drop_duplicates` is the same sort with whole rows in it: texts cross the
network once, and the first row of each run stays (of a hot group, the best of
the first rows of its parts), so no row is looked up by its id.

Nulls count as empty; null ids come last and stay only where no other does; of
repeated rows of one id one stays, and one id may have several texts. Ties
between rows of one id and text go to the smallest hash of the row. Very long
texts are compared whole. An empty table gives an empty result. Extra columns
are not read, or returned as they are by :func:`drop_duplicates`. DataFrame
functions only.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import whole_text, written

HEAD_BYTES = 16


def _best_first(keep: str) -> tuple[Callable[[str], Column], Column]:
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep: {keep}")
    return (F.min, F.col("doc_id").asc_nulls_last()) if keep == "smallest" else (F.max, F.col("doc_id").desc_nulls_last())


def _dealt(docs: DataFrame, extra: dict[str, Column], normalise: Callable[[Column], Column], hot_rows: int, hot_share: int) -> DataFrame:
    """``doc_id`` and ``extra`` of each row with its place in the sort: ``digest, head, hot, salt``; range-partitioned."""
    text = normalise(whole_text()).cast("binary")
    keyed = docs.select("doc_id", *(c.alias(k) for k, c in extra.items()), F.unhex(F.sha2(text, 256)).alias("digest"), F.substring(text, 1, HEAD_BYTES).alias("head"))
    line = max(hot_rows, docs.count() // hot_share)
    hot = keyed.groupBy("digest").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > line)
    parts = F.ceil(F.col("rows") / (line / 4)).cast("long")
    salted = keyed.join(F.broadcast(hot), "digest", "left").select(
        "doc_id", *extra, "digest", "head", F.col("rows").isNotNull().alias("hot"), F.coalesce(F.pmod(F.xxhash64("doc_id"), parts), F.lit(0)).alias("salt")
    )
    return salted.repartitionByRange("head", "digest", "salt")


def exact_groups(docs: DataFrame, keep: str = "smallest", normalise: Callable[[Column], Column] = lambda text: text, hot_rows: int = 1000, hot_share: int = 10_000) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    best, by_id = _best_first(keep)
    near = W.partitionBy("head", "digest", "salt").orderBy("bytes", by_id)
    before = F.lag("bytes").over(near)
    run = (
        _dealt(docs, {"bytes": normalise(whole_text()).cast("binary")}, normalise, hot_rows, hot_share)
        .withColumn("opens", before.isNull() | (before != F.col("bytes")))
        .select("doc_id", "head", "digest", "salt", "hot", "opens", F.sum(F.col("opens").cast("long")).over(near).alias("run"), F.when(F.col("hot") & F.col("opens"), F.col("bytes")).alias("first_text"))
    )
    same = W.partitionBy("head", "digest", "salt", "run")
    found = written(
        run.select("doc_id", "digest", "salt", "hot", "opens", "run", "first_text", best("doc_id").over(same).alias("keep_id"), F.count(F.lit(1)).over(same).alias("group_size")),
        "content-runs",
    )

    whole = W.partitionBy("digest", "first_text")
    parts_of_hot = found.where("hot AND opens").select(
        "digest", "salt", "run", best("keep_id").over(whole).alias("all_keep"), F.sum("group_size").over(whole).alias("all_size")
    )  # at most four parts for each `line` rows, and one more for each group: under 50,000
    return found.join(F.broadcast(parts_of_hot), ["digest", "salt", "run"], "left").select(
        "doc_id",
        F.when(F.col("hot"), F.col("all_keep")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(F.col("hot"), F.col("all_size")).otherwise(F.col("group_size")).alias("group_size"),
        (F.col("opens") & F.col("doc_id").eqNullSafe(F.when(F.col("hot"), F.col("all_keep")).otherwise(F.col("keep_id")))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, keep: str = "smallest", normalise: Callable[[Column], Column] = lambda text: text, hot_rows: int = 1000, hot_share: int = 10_000) -> DataFrame:
    """``docs`` without the rows whose text another row keeps: exactly one row stays for each text, with all its columns."""
    _, by_id = _best_first(keep)
    hashed = [F.col("_doc")[f.name] for f in docs.schema if not re.search("map<|variant", f.dataType.simpleString())]
    dealt = _dealt(docs, {"_doc": F.struct(*(docs[c] for c in docs.columns))}, normalise, hot_rows, hot_share)
    rows = dealt.select("doc_id", "_doc", "digest", "head", "hot", "salt", normalise(F.coalesce(F.col("_doc")["text"], F.lit(""))).cast("binary").alias("bytes"), F.xxhash64(*hashed).alias("tie"))
    before = F.lag("bytes").over(W.partitionBy("head", "digest", "salt").orderBy("bytes", by_id, "tie"))
    first = rows.withColumn("before", before).where("before IS NULL OR before <> bytes")
    place = F.row_number().over(W.partitionBy("digest", "bytes").orderBy(by_id, "tie"))
    best_of_hot = first.where("hot").withColumn("place", place).where("place = 1")  # the same range exchange, read again; one row for each part
    stay = first.where("NOT hot").select("_doc").unionByName(best_of_hot.select("_doc"))
    return stay.select(*(F.col("_doc")[c].alias(c) for c in docs.columns))


SQL = """
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept,
       sha256(body) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS body FROM documents)
WINDOW g AS (PARTITION BY body)
"""
