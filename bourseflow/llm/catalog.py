"""Registered queries of the corpus operators: each applies its operator, with production parameters, to a whole table."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bourseflow.llm import (decontaminate, embedding_dedup, extraction, kneser_ney, language, minhash_dedup, mixing, quality_rules, repair, revisit,
                            sharding, sql, url_filter, whitening)

Query = Callable[[SparkSession, str], DataFrame]

#: Rules of the URL query.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_warc_revisits(spark: SparkSession, folder: str) -> DataFrame:
    return revisit.resolved_text(revisit.resolve(revisit.captures_of(table(spark, folder, "pages"))))


def op2_poisson_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(table(spark, folder, "documents"))


def op3_word_first_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identified(table(spark, folder, "documents"))


def op4_min_cut_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.extracted(table(spark, folder, "pages"))


def op5_boosted_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return url_filter.judged(pages, url_filter.weak_labels(pages.select("url")), url_filter.Settings(rules=RULES))


def op6_kneser_ney(spark: SparkSession, folder: str) -> DataFrame:
    return kneser_ney.language_model_scores(table(spark, folder, "documents"))


def op7_seed_and_align(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op8_cross_polytope(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, folder, "embeddings"))


def op9_minhash_inverted_join(spark: SparkSession, folder: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, folder, "documents"), minhash_dedup.Settings(shingle=3, percent=85))


def op10_virtual_slots(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.place(table(spark, folder, "documents"))


def op11_rule_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judged(table(spark, folder, "documents"))


def op12_checkpointed_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.digests(repair.damaged(table(spark, folder, "conversations")))


def op13_multiplicity_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.components_of(table(spark, folder, "embeddings"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(sql.SQL)
