"""The corpus pipeline: quality rules, exact and near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the
last keep the columns of ``documents``, and extra columns of any name; the next
stage reads what the stage wrote as Parquet to the shared folder, and what only
the stage itself needed is removed.

Null texts count as empty: quality rules reject them, as all texts of too few
words. Very long texts are read whole. Null ids stay like others and come after
them where ids decide; repeated rows, and one id with several texts, are rows
like any others: exact dedup keeps one row of each text, the one with the
smallest id, ties to the smallest hash of the row. Near-dedup keeps the one with
the smallest id of each component of pairs. Null sources are one source, the
last. Rows that tie in the mix (one id twice) share what the border gives.
Empty tables go through all stages and give no pieces; without labels of both
kinds quality rules only apply their fixed rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import discard, last_table_only, table, written
from tessera.llm.queries import tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6. The trees learn from the labelled rows of ``sf_dir``; rejected documents go."""
    from tessera.llm.quality import fit, keep_good

    return keep_good(docs, fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2. Of equal texts the one with the smallest id stays."""
    from tessera.llm.exact_dedup import drop_duplicates

    return drop_duplicates(docs, keep="smallest")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5 on five-word shingles. Of near copies the one with the smallest id stays."""
    from tessera.llm.simhash import keep_one

    return keep_one(docs, words=5)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10. Documents appear as often as the mix takes them, a source's last one in part."""
    from tessera.llm.mixing import mixed_documents

    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1. One row per piece of a sequence."""
    from tessera.llm.packing import pack

    return pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("simhash near-dedup", simhash_near_dedup),
    ("mixing", source_mixing),
    ("packing", packing),
]

#: Trees, fingerprints and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with last_table_only():
            docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            discard(before)
        before = docs
    return docs
