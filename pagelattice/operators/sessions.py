"""Stored sessions: search, grouping, de-duplication, latest messages and changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def search(messages: DataFrame, needle: str, title: str = "title", label: str = "role", result: str = "result") -> DataFrame:
    """Sessions whose title, a label, a message's text or a result as JSON contains the words, in any case; columns that are missing say nothing."""

    def holds(c: Column) -> Column:
        return F.coalesce(F.lower(c).contains(needle.lower()), F.lit(False))

    where = F.lit(False)
    for name in (title, label, "text", result):
        if name in messages.columns:
            plain = messages.schema[name].dataType.typeName() in ("string",)
            where = where | holds(F.col(name) if plain else F.to_json(name))
    return messages.filter(where).select("conv_id").distinct()


def by_label(messages: DataFrame) -> DataFrame:
    """label, n_sessions, newest: the sessions in which a label (role) occurs; a session is in every group of its labels."""
    return messages.select("role", "conv_id").distinct().groupBy(F.col("role").alias("label")).agg(F.count("*").alias("n_sessions"), F.max("conv_id").alias("newest"))


def label_sessions(messages: DataFrame) -> DataFrame:
    """label, place, conv_id: each label's sessions, the newest first."""
    own = messages.select(F.col("role").alias("label"), "conv_id").distinct()
    return own.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("conv_id"))))


def first_of_each(pages: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(key).orderBy(order)
    return pages.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def latest(messages: DataFrame, role: str) -> DataFrame:
    """conv_id, turn, text of each session's last message of a role."""
    m = messages.filter(F.col("role") == role)
    best = m.groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("b"))
    return best.select("conv_id", F.col("b.turn").alias("turn"), F.col("b.text").alias("text"))


def upserted(pages: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Pages with changed rows in place of those of the same key; changes marked as deleted only take rows away."""
    kept = pages.join(changes.select(key).distinct(), key, "left_anti")
    return kept.unionByName(changes.filter(~F.col("deleted")).drop("deleted"))


def replayed(changes: DataFrame, key: str, order: str) -> DataFrame:
    """What a store of sessions holds after its changes: each key's last one, unless it was a deletion."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return changes.withColumn("_r", F.row_number().over(w)).filter("_r = 1 and not deleted").drop("_r", "deleted")
