"""Writers of results, and readers of what was learned."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice import schema

#: Pages up to which results may go into one document.
ONE_DOCUMENT = 10_000


def write_results(results: DataFrame, path: str) -> None:
    """One JSON line for each page, nulls kept, written by the tasks."""
    results.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def result_document(results: DataFrame, order: str = "doc_id", failed: str = "error") -> str:
    """The fields of a small run as one JSON text: an object for one page, a list for several, null for a page that failed."""
    kept = F.col("fields") if failed not in results.columns else F.when(F.col(failed).isNull(), F.col("fields"))
    rows = results.select(order, F.to_json(kept, {"ignoreNullFields": "false"}).alias("j")).orderBy(order).limit(ONE_DOCUMENT + 1).collect()
    if len(rows) > ONE_DOCUMENT:
        raise ValueError("too many pages for one document; write_results writes any number")
    found = [None if r["j"] is None else json.loads(r["j"]) for r in rows]
    return json.dumps(found[0] if len(found) == 1 else found, ensure_ascii=False, indent=2)


def write_export(pages: DataFrame, path: str) -> None:
    """Inputs and outputs of pages as JSON, each kind in its folder."""
    kinds = F.array(F.struct(F.lit("input").alias("kind"), F.to_json("input").alias("value")), F.struct(F.lit("output").alias("kind"), F.to_json("output").alias("value")))
    pages.select(F.inline(kinds)).write.mode("overwrite").partitionBy("kind").text(path)


def append_occurrences(log: DataFrame, path: str) -> None:
    """Adds to the occurrence log; nothing is rewritten."""
    log.write.mode("append").partitionBy("label_type").parquet(path)


def read_occurrences(spark: SparkSession, path: str) -> DataFrame:
    """The occurrence log; a log that does not exist yet is empty."""
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema.OCCURRENCE)
