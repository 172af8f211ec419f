"""The registered corpus queries: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.url_filter import RULES, judge, link_farms, listing

    return judge(table(spark, sf_dir, "pages"), listing(spark, RULES, link_farms()))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), limit=1024)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.toxicity import fit, score_texts

    docs = table(spark, sf_dir, "documents")
    return score_texts(docs, fit(docs, table(spark, sf_dir, "labels")), threshold=0.7)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.pii import find, fit

    docs = table(spark, sf_dir, "documents")
    return find(docs, fit(docs))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.simhash import near_components

    return near_components(table(spark, sf_dir, "documents"), words=4)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality import assess, fit

    docs = table(spark, sf_dir, "documents")
    return assess(docs, fit(docs, table(spark, sf_dir, "labels")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), cap=3)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_packing, op2_exact_dedup, op3_toxicity, op4_pii, op5_simhash, op6_quality_rules, op7_license_scans, op8_url_filter, op9_token_counts, op10_mixing)}


def oracle_sql() -> dict[str, str]:
    from tessera.llm import exact_dedup, mixing, url_filter

    return {"op2_exact_dedup": exact_dedup.SQL, "op8_url_filter": url_filter.SQL, "op10_mixing": mixing.SQL}
