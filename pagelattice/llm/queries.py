"""Thin queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelattice.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelattice.llm.language_id import language_id

    return language_id(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelattice.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelattice.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelattice.llm.sentencepiece_codec import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), digests=True)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelattice.llm.substring_dedup import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelattice.llm.chat_format import chat_format

    return chat_format(table(spark, sf_dir, "conversations"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelattice.llm.lm_scoring import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelattice.llm import url_filter as uf

    rules = [uf.HostRule(*r) for r in uf.DEFAULT_RULES]
    pages = table(spark, sf_dir, "pages")
    return uf.url_filter(pages, rules, uf.default_list(pages)).drop("url")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelattice.llm.warc import archive_round_trip

    return archive_round_trip(table(spark, sf_dir, "pages"))
