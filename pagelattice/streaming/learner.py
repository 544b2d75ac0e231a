"""The occurrence log as a stream: rates kept per type and field."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice.storage import removed_at_exit, shared_dir


def stream_rates(spark: SparkSession, path: str) -> DataFrame:
    """Found rates after all files below path have been read as a stream.

    Each micro-batch appends its partial counts, a row for each type and field,
    to a table in the shared folder; the batch number is part of its folder, so
    a batch that is run again replaces its own counts.
    """
    at = f"{shared_dir(spark)}/learner-{uuid.uuid4().hex}"
    static = spark.read.parquet(path)
    folder, _, name = path.rpartition("/")
    source = spark.readStream.schema(static.schema).option("pathGlobFilter", name).parquet(folder) if not _is_folder(spark, path) else spark.readStream.schema(static.schema).parquet(path)

    def put(df: DataFrame, batch: int) -> None:
        rows = df.select(F.col("event_type").alias("label_type"), F.concat(F.lit("f"), (F.col("user_id") % 3).cast("string")).alias("field_name"), (F.col("value") > 5.0).alias("found"))
        part = rows.groupBy("label_type", "field_name").agg(F.count("*").alias("n"), F.sum(F.col("found").cast("int")).alias("k"))
        part.write.mode("overwrite").parquet(f"{at}/counts/batch={batch}")

    q = source.writeStream.foreachBatch(put).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    removed_at_exit(spark, at)
    counts = spark.read.parquet(f"{at}/counts")
    return counts.groupBy("label_type", "field_name").agg(F.sum("n").alias("n"), (F.sum("k") / F.sum("n")).alias("found_rate"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
