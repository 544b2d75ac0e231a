"""From raw documents to encoded training text, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet in the shared folder and read again as the next stage's documents.
All but the last return the columns of documents.

Defined cases, in every stage: a null text counts as empty (and fails the
quality rules); a null id is a document of its own beside all others; rows that
repeat id and text are one document after near dedup; texts of any length are
processed whole; an empty table stays empty; extra columns pass through to the
last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagelattice.llm.common import Workspace
from pagelattice.llm.decontaminate import clean_documents
from pagelattice.llm.quality_rules import rejected_out
from pagelattice.llm.sentencepiece_codec import encode_documents
from pagelattice.llm.simhash import one_of_each
from pagelattice.llm.substring_dedup import without_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules."""
    return rejected_out(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return one_of_each(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that documents of smaller ids have."""
    return without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document's pieces, and whether they decode to its text."""
    return encode_documents(docs)


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substrings),
    ("decontamination", decontamination),
    ("sentencepiece", encoding),
]

#: SQL cannot express fingerprints and pieces; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = space.keep(stage(spark, docs, sf_dir), name)
    return docs
