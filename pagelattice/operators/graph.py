"""Lines, edges and access operators of the page graph.

All tables carry doc_id, and every join and window is on it, so one hash
partitioning by page serves the whole chain. Pages are small; a page's tokens
are gathered only for the order-dependent line fold.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelattice.storage import removed_at_exit, shared_dir

SAME_LINE = 0.005
LINE_GROUPING = 0.01
MIN_OVERLAP_X = 0.1
MAX_VERTICAL = 0.30
ABSOLUTE_GAP = 0.042
SPACING_FACTOR = 2.5
HIGH_MEDIAN = 0.03
GAP_WIDTHS = 6.0


def _center(a: str, b: str):
    return (F.col(a) + F.col(b)) / F.lit(2.0)


def materialized(df: DataFrame) -> DataFrame:
    """Writes a table that several plans read to the shared folder, so that it is computed once.

    The files of alike pages are far smaller than their rows, so joins with it
    are not broadcast by the files' size.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}"
    df.write.parquet(path)
    removed_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path).hint("merge")


def lines(tokens: DataFrame) -> DataFrame:
    """doc_id, token_id, ord, box and line (rank of a token's line by its first centre in the page).

    Tokens join, in input order, the nearest line whose running mean centre is
    closer than LINE_GROUPING, else open one. The page's tokens are one array;
    pages of one layout share the fold.
    """
    from pagelattice.operators.page import line_rows

    box = F.struct("ord", "token_id", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    pages = tokens.groupBy("doc_id").agg(F.sort_array(F.collect_list(box)).alias("t"))
    kinds = {f.name: f.dataType.simpleString() for f in tokens.schema}
    ddl = ", ".join(f"{c} {kinds[c]}" for c in ("doc_id", "token_id", "ord")) + ", x0 double, y0 double, x1 double, y1 double, line int"
    return line_rows(pages, ddl)


def east_edges(lined: DataFrame) -> DataFrame:
    """(doc_id, from_id, to_id) of neighbours in a line that are level and near."""
    w = Window.partitionBy("doc_id", "line").orderBy("x0", "ord")
    nxt = {c: F.lead(c).over(w).alias(f"n_{c}") for c in ("token_id", "x0", "x1", "y0", "y1")}
    df = lined.select("doc_id", "token_id", "x0", "x1", "y0", "y1", *nxt.values())
    level = F.abs(_center("y0", "y1") - _center("n_y0", "n_y1")) < SAME_LINE
    near = F.col("n_x0") - F.col("x1") < ((F.col("x1") - F.col("x0")) + (F.col("n_x1") - F.col("n_x0"))) / 2.0 * GAP_WIDTHS
    return df.filter(level & near).select("doc_id", F.col("token_id").alias("from_id"), F.col("n_token_id").alias("to_id"))


def line_spacing(lined: DataFrame) -> DataFrame:
    """doc_id, line, gap: the smallest positive gap from a line to the next one.

    The gap between two tokens is the lower one's top less the upper one's
    bottom; only pairs of neighbouring lines meet.
    """
    up = lined.select("doc_id", "line", F.col("y1").alias("bottom"))
    down = lined.select("doc_id", (F.col("line") - 1).alias("line"), F.col("y0").alias("top"))
    gap = F.col("top") - F.col("bottom")
    return up.join(down, ["doc_id", "line"]).filter(gap > 0).groupBy("doc_id", "line").agg(F.min(gap).alias("gap"))


def spacing_limit(lined: DataFrame) -> DataFrame:
    """doc_id, spacing: the vertical gap above which lines are not linked; null without any."""
    gaps = line_spacing(lined).groupBy("doc_id").agg(F.sort_array(F.collect_list("gap")).alias("g"))
    upper = F.expr("g[cast(size(g) div 2 as int)]")
    quarter = F.expr("g[cast(size(g) div 4 as int)]")
    return gaps.select("doc_id", (F.when(upper > HIGH_MEDIAN, quarter).otherwise(upper) * SPACING_FACTOR).alias("spacing"))


def _edges(lined: DataFrame, *ways: str) -> DataFrame:
    """Edges page by page: one shuffle gathers the tokens of a page, and nothing is joined."""
    from pagelattice.operators.page import edge_rows

    cols = ("line", "x0", "y0", "x1", "y1")
    token = F.struct(F.col("ord").cast("int").alias("ord"), F.col("token_id").cast("int").alias("token_id"), *cols)
    return edge_rows(lined.groupBy("doc_id").agg(F.sort_array(F.collect_list(token)).alias("t")), ways)


def south_edges(lined: DataFrame) -> DataFrame:
    """(doc_id, from_id, to_id): each token's best lower neighbour."""
    return _edges(lined, "south").drop("relation")


def edges(lined: DataFrame) -> DataFrame:
    """East and south edges, computed once for all that reads them."""
    return materialized(_edges(lined, "east", "south"))


REVERSE = {"east": "west", "west": "east", "north": "south", "south": "north"}


def reversed_edges(e: DataFrame) -> DataFrame:
    back = F.create_map(*[F.lit(x) for kv in REVERSE.items() for x in kv])
    return e.select("doc_id", F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), F.element_at(back, F.col("relation")).alias("relation"))


def neighbours(e: DataFrame) -> DataFrame:
    """Each edge both ways, once."""
    own = e.select("doc_id", "from_id", "to_id", "relation")
    return own.unionByName(reversed_edges(own)).distinct()


def degree(tokens: DataFrame, e: DataFrame) -> DataFrame:
    """doc_id, token_id, degree: edges that touch a token, zero included."""
    ends = e.select("doc_id", F.explode(F.array("from_id", "to_id")).alias("token_id"))
    n = ends.groupBy("doc_id", "token_id").agg(F.count("*").alias("degree"))
    return tokens.select("doc_id", "token_id").join(n, ["doc_id", "token_id"], "left").select("doc_id", "token_id", F.coalesce("degree", F.lit(0)).alias("degree"))


def removed(e: DataFrame, gone: DataFrame) -> DataFrame:
    """The edges without those of exactly the same ends and relation."""
    return e.join(gone, ["doc_id", "from_id", "to_id", "relation"], "left_anti")


def label_values(e: DataFrame, roles: DataFrame) -> DataFrame:
    """doc_id, label_id, value_id: each label's first east, else south, neighbour that is a value."""
    r = roles.select("doc_id", F.col("token_id").alias("id"), "role")
    a = r.filter("role = 'LABEL'").select("doc_id", F.col("id").alias("from_id"))
    b = r.filter("role = 'VALUE'").select("doc_id", F.col("id").alias("to_id"))
    out = e.join(a, ["doc_id", "from_id"]).join(b, ["doc_id", "to_id"])
    rank = F.struct((F.col("relation") != "east").cast("int").alias("s"), "to_id")
    return out.filter(F.col("relation").isin("east", "south")).groupBy("doc_id", F.col("from_id").alias("label_id")).agg(F.min(rank)["to_id"].alias("value_id"))


def token_values(tokens: DataFrame, e: DataFrame, roles: DataFrame) -> DataFrame:
    """doc_id, token_id, value: a label's value text, else the token's own."""
    text = tokens.select("doc_id", F.col("token_id").alias("value_id"), F.col("text").alias("value_text"))
    linked = label_values(e, roles).join(text, ["doc_id", "value_id"]).select("doc_id", F.col("label_id").alias("token_id"), "value_text")
    return tokens.join(linked, ["doc_id", "token_id"], "left").select("doc_id", "token_id", F.coalesce("value_text", "text").alias("value"))


def label_value_text(tokens: DataFrame, e: DataFrame, roles: DataFrame) -> DataFrame:
    """doc_id, token_id, text: a label without its final colon, then its value."""
    v = token_values(tokens, e, roles).withColumnRenamed("value", "v")
    label = F.regexp_replace("text", r":\s*$", "")
    both = F.when(F.col("v") == F.col("text"), F.col("text")).otherwise(F.concat_ws(" ", label, "v"))
    return tokens.join(v, ["doc_id", "token_id"]).select("doc_id", "token_id", both.alias("text"))


def prefixes(texts: Column) -> Column:
    """The texts of a path joined, then without the last, and so on to the first alone; blank ones left out, each string once."""
    full = F.filter(texts, lambda x: x != "")
    shorter = F.transform(F.sequence(F.size(full), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(full, 1, k), " "))
    return F.when(F.size(full) > 0, F.array_distinct(shorter)).otherwise(F.array().cast("array<string>"))


def corners(e: DataFrame) -> DataFrame:
    """doc_id, tl, tr, bl, br: two-by-two cells linked all around, one neighbour each way."""
    one = lambda rel, name: (
        e.filter(F.col("relation") == rel).groupBy("doc_id", "from_id").agg(F.min("to_id").alias(name), F.count("*").alias("n")).filter("n = 1").drop("n")
    )
    east, south = one("east", "tr"), one("south", "bl")
    first = east.join(south, ["doc_id", "from_id"])
    low = east.select("doc_id", F.col("from_id").alias("bl"), F.col("tr").alias("br"))
    right = south.select("doc_id", F.col("from_id").alias("tr"), F.col("bl").alias("br2"))
    out = first.join(low, ["doc_id", "bl"]).join(right, ["doc_id", "tr"]).filter("br = br2")
    return out.select("doc_id", F.col("from_id").alias("tl"), "tr", "bl", "br")


def oriented_corners(e: DataFrame) -> DataFrame:
    """Corners with their orientation: horizontal if the next column is linked, else vertical if the next row is."""
    from pagelattice.operators.page import corner_rows

    own = e.filter(F.col("relation").isin("east", "south"))
    edge = F.struct(F.col("from_id").cast("int").alias("from_id"), F.col("to_id").cast("int").alias("to_id"), (F.col("relation") == "east").alias("east"))
    return corner_rows(own.groupBy("doc_id").agg(F.sort_array(F.collect_list(edge)).alias("t")))
