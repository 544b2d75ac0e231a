"""Shared pieces: tokens, sizes, and tables written to the shared folder."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice.storage import removed_at_exit, shared_dir

#: Space and the control characters tab to carriage return separate words.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A document without an id is larger than every identified one.
NO_ID = 2**63 - 1


def ascii_lower(text: Column) -> Column:
    """Lower-cases A to Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE_PATTERN)
    return F.array_remove(parts, "")


def let(value: str, name: str, body: str) -> str:
    """SQL that binds a value once: inside lambdas, an optimizer-inlined column would be computed for each element."""
    return f"transform(array({value}), {name} -> {body})[0]"


def give_back() -> None:
    """Returns what a Python worker has freed to the system, since idle workers stay beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own house
        pass


def tidy(batches: Iterator) -> Iterator:
    """Passes batches on, and gives memory back after the last."""
    yield from batches
    give_back()


class Workspace:
    """Tables of one operator run, in a folder of its own below the shared one."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and reads it back: a lost executor then costs no recomputation."""
        at = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(at)
        removed_at_exit(self.spark, self.path)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, name: str) -> None:
        """Deletes a table that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of text that a worker takes from a batch at once.
BYTES_AT_ONCE = 4_000_000


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def as_bytes(column: pa.Array) -> pa.Array:
    """Text as its UTF-8 bytes, null as empty."""
    return pc.fill_null(column.cast(pa.binary()), b"")


def split_batch(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a batch of texts, and the number of words of each text."""
    text = pc.fill_null(column.cast(pa.string()), "")
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(text))
    flat = lists.flatten()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.not_equal(flat, "")
    if not pc.all(full).as_py() if len(flat) else False:
        owner = np.repeat(np.arange(len(counts)), counts)[full.to_numpy(zero_copy_only=False)]
        counts = np.bincount(owner, minlength=len(counts)).astype(np.int64)
        flat = flat.filter(full)
    return flat, counts


def buckets_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Bucket of each 64-bit hash, from its upper bits."""
    return ((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def text_parts(batch: pa.RecordBatch, column: int, at_once: int = BYTES_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about so many bytes of text; a longer text is a part of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // at_once
    cuts = np.append(np.unique(part, return_index=True)[1], len(batch)).tolist()
    for at, end in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(at, end - at)
