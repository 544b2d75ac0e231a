"""Role rules that read only what they do not change, each a projection of the page.

Inputs are tokens with roles, and edges; each rule gives (doc_id, token_id,
role) for all tokens, or the edges that stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelattice.functions import text as X
from pagelattice.operators import graph

TOP = 0.20
LARGE = 1.2
DEFAULT_FONT = 12.0
FOOT = 0.95


def _around(tokens: DataFrame, edges: DataFrame) -> DataFrame:
    """Tokens with counts of their distinct neighbours, of those with dates, and of those with codes."""
    n = graph.neighbours(edges).select("doc_id", F.col("from_id").alias("token_id"), F.col("to_id").alias("n_id")).distinct()
    t = tokens.select("doc_id", F.col("token_id").alias("n_id"), X.is_date(F.col("text")).alias("d"), X.is_code(F.col("text")).alias("c"))
    around = n.join(t, ["doc_id", "n_id"]).groupBy("doc_id", "token_id").agg(F.count("*").alias("n_near"), F.max("d").alias("near_date"), F.max("c").alias("near_code"))
    out = tokens.join(around, ["doc_id", "token_id"], "left")
    return out.withColumns({"n_near": F.coalesce("n_near", F.lit(0)), "near_date": F.coalesce("near_date", F.lit(False)), "near_code": F.coalesce("near_code", F.lit(False))})


def initial_label(tokens: DataFrame) -> DataFrame:
    """Texts that end in a separator, or have an interior colon, are labels; given roles stay."""
    label = X.ends_with_separator(F.col("text")) | X.colon_in_middle(F.col("text"))
    return tokens.select("doc_id", "token_id", F.coalesce("role", F.when(label, F.lit("LABEL"))).alias("role"))


def header_preservation(tokens: DataFrame) -> DataFrame:
    """Large text in the top fifth that is no number and ends in no separator is a header."""
    mean = F.coalesce(F.avg("font_size").over(Window.partitionBy("doc_id")), F.lit(DEFAULT_FONT))
    c = F.col("text")
    size = F.col("font_size")
    several = F.size(F.split(X.strip(c), r"\s+")) >= 2
    header = (F.col("y0") < TOP) & ((size >= mean * LARGE) | ((size > mean) & several)) & ~X.ends_with_separator(c) & ~X.is_number(c) & (X.strip(c) != "")
    return tokens.select("doc_id", "token_id", F.when(header, "HEADER").otherwise(F.col("role")).alias("role"))


def date_label_cleanup(tokens: DataFrame, edges: DataFrame, links: DataFrame) -> DataFrame:
    """Labels next to a date and to no code, without interior colon, separator or a link to that date, lose their role."""
    dates = tokens.filter(X.is_date(F.col("text"))).select("doc_id", F.col("token_id").alias("value_id"))
    linked = links.join(dates, ["doc_id", "value_id"], "left_semi").select("doc_id", F.col("label_id").alias("token_id"), F.lit(True).alias("linked")).distinct()
    t = _around(tokens, edges).join(linked, ["doc_id", "token_id"], "left")
    c = F.col("text")
    bare = (F.col("role") == "LABEL") & F.col("near_date") & ~F.col("near_code") & ~X.colon_in_middle(c) & ~X.ends_with_separator(c) & F.col("linked").isNull()
    return t.select("doc_id", "token_id", F.when(~F.coalesce(bare, F.lit(False)), F.col("role")).alias("role"))


def label_without_edges(tokens: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels that touch no edge are headers."""
    t = tokens.join(graph.degree(tokens, edges), ["doc_id", "token_id"])
    lone = (F.col("role") == "LABEL") & (F.col("degree") == 0)
    return t.select("doc_id", "token_id", F.when(lone, "HEADER").otherwise(F.col("role")).alias("role"))


def isolated_short_text(tokens: DataFrame, edges: DataFrame) -> DataFrame:
    """Values or unknown short pure texts with one neighbour at most, above the foot of the page, are headers."""
    t = _around(tokens, edges)
    c = F.col("text")
    short = (F.size(F.split(X.strip(c), r"\s+")) <= 2) & ~c.rlike(r"\d") & ~X.ends_with_separator(c)
    high = (F.col("y0") + F.col("y1")) / 2 < FOOT
    header = (F.col("role").isNull() | (F.col("role") == "VALUE")) & (F.col("n_near") <= 1) & short & high
    return t.select("doc_id", "token_id", F.when(header, "HEADER").otherwise(F.col("role")).alias("role"))


def separated_pair_isolation(tokens: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges without the south ones that leave a label and the value to its right that were split from one text."""
    split = tokens.filter("separated_pair").select("doc_id", "token_id", "role")
    labels = split.filter("role = 'LABEL'").select("doc_id", F.col("token_id").alias("from_id"))
    values = split.filter("role = 'VALUE'").select("doc_id", F.col("token_id").alias("to_id"))
    pairs = edges.filter("relation = 'east'").join(labels, ["doc_id", "from_id"]).join(values, ["doc_id", "to_id"])
    ends = pairs.select("doc_id", F.explode(F.array("from_id", "to_id")).alias("from_id"), F.lit("south").alias("relation")).distinct()
    return edges.join(ends, ["doc_id", "from_id", "relation"], "left_anti")


def label_single_value(edges: DataFrame, roles: DataFrame) -> DataFrame:
    """Edges in which each label leads to one value, the first to the right, below, above or left; those to others go."""
    r = roles.select("doc_id", F.col("token_id").alias("id"), "role")
    labels = r.filter("role = 'LABEL'").select("doc_id", F.col("id").alias("from_id"))
    values = r.filter("role = 'VALUE'").select("doc_id", F.col("id").alias("to_id"))
    place = F.when(F.col("relation") == "east", 0).when(F.col("relation") == "south", 1).when(F.col("relation") == "north", 2).otherwise(3)
    around = graph.neighbours(edges).join(labels, ["doc_id", "from_id"]).join(values, ["doc_id", "to_id"])
    first = around.groupBy("doc_id", "from_id").agg(F.min(F.struct(place.alias("p"), "to_id"))["to_id"].alias("kept"))
    onward = edges.join(labels, ["doc_id", "from_id"]).join(values, ["doc_id", "to_id"]).join(first, ["doc_id", "from_id"])
    gone = onward.filter("to_id <> kept").select("doc_id", "from_id", "to_id", "relation")
    return edges.select("doc_id", "from_id", "to_id", "relation").join(gone, ["doc_id", "from_id", "to_id", "relation"], "left_anti")
