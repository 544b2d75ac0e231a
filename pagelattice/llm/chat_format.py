"""Conversations without quotes, linked to what their messages quote.

Lines that begin with ">" are quoted, at the level of how many marks they begin
with. A passage is a run of lines of one level; runs split again into their
lines, so a reply may quote a part. Passages are normalised (A to Z lower-cased,
words joined by one space) and meet by hash and words. A quoted passage links to
the latest earlier message of its conversation that wrote it itself, found by one
ordered pass over (conversation, passage), never by pairs. A message answers the
message with most linked passages of its lowest quoted level, the latest of
several; a message without links answers the one before it, and the first one
none.

A conversation is one row with its messages in reply order: an answer comes
after what it answers, and answers of one message from the earliest on. As an
answer is always later than what it answers, that is the order of turns. Only a
conversation of more than PART_BYTES of text is several rows, parts by turn (by
message where all turns are one), so that no task gathers it whole.

All of it is built-in expressions.

Defined cases: null text is empty; a null role is "unknown"; a null turn comes
first, as turn -1; a null conversation id is a conversation; repeated rows are
one message; different messages of one turn are ordered by role and text, and
answer messages of earlier turns; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelattice.llm.common import SPACE_PATTERN, Workspace, ascii_lower, let

PART_BYTES = 8_000_000
#: Turns that are looked at together for the one before.
TURN_BLOCK = 4_096
QUOTE = r"^[ \t]*(>[> \t]*)"
#: Stands after a run's level, as the character 2 does before it; in texts both are spaces.
LEVEL = "\x01"


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(ascii_lower(text), SPACE_PATTERN, " "))


def messages(conversations: DataFrame) -> DataFrame:
    """One row for each distinct message, with its lines, their levels and its body."""
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.coalesce(F.col("turn").cast("bigint"), F.lit(-1)).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).distinct()
    marks = lambda x: F.regexp_extract(x, QUOTE, 1)
    lines = F.transform(
        F.split(F.replace("text", F.lit("\r\n"), F.lit("\n")), "\n"),
        lambda x: F.struct(
            F.length(F.regexp_replace(marks(x), "[^>]", "")).alias("level"),
            F.when(marks(x) == "", x).otherwise(F.regexp_replace(x, QUOTE, "")).alias("line"),
        ),
    )
    rows = rows.withColumn("lines", lines)
    own = F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["line"]), "\n")
    return rows.withColumn("body", F.regexp_replace(F.regexp_replace(own, r"\A\s+|\s+\z", ""), r"\n{3,}", "\n\n")).withColumn(
        "mid", F.xxhash64("conv_id", "turn", "role", "text")
    )


def runs(lines: str) -> Column:
    """Runs of lines of one level, and each line, as its level, LEVEL and its text; blank lines end a run.

    Lines are joined to one string in which runs are marked, and split there, so
    a message takes time in proportion to its length.
    """
    plain = f"transform({lines}, x -> named_struct('level', x.level, 'line', translate(x.line, concat(char(1), char(2)), '  '), 'blank', trim(x.line) = ''))"
    begin = "concat(cast(x.level as string), char(1), x.line)"
    goes_on = "i > 0 and get(a, i - 1).level = x.level and not get(a, i - 1).blank"
    piece = f"case when x.blank then '' when {goes_on} then concat(' ', x.line) else concat(char(2), {begin}) end"
    whole = let(plain, "a", f"array_join(transform(a, (x, i) -> {piece}), '')")
    single = let(plain, "a", f"transform(filter(a, x -> not x.blank), x -> {begin})")
    return F.expr(f"concat(filter(split({whole}, char(2)), r -> r <> ''), {single})")


def passages(rows: DataFrame) -> DataFrame:
    """conv_id, turn, mid, level, hash, text, size: runs of lines of one level, and their lines."""
    out = rows.select("conv_id", "turn", "mid", F.explode_outer(runs("lines")).alias("p")).filter("p is not null")
    level, line = F.substring_index("p", LEVEL, 1).cast("int"), F.substring_index("p", LEVEL, -1)
    out = out.select("conv_id", "turn", "mid", level.alias("level"), _normal(line).alias("text")).filter(F.col("text") != "")
    return out.withColumns({"hash": F.xxhash64("text"), "size": F.length("text")}).distinct()


def quotation_links(rows: DataFrame) -> DataFrame:
    """mid, level, reply_to (turn), n_linked: the message that most linked passages come from."""
    found = passages(rows)
    keys = found.filter("level > 0").select(F.col("conv_id").alias("_c"), F.col("hash").alias("_h")).distinct()
    near = found.join(keys, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("hash") == F.col("_h")), "left_semi")
    before = Window.partitionBy("conv_id", "hash", "text").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    linked = near.withColumn("origin", F.max(F.when(F.col("level") == 0, F.col("turn"))).over(before))
    linked = linked.filter("level > 0 and origin is not null")
    votes = linked.groupBy("mid", "level", "origin").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    best = votes.groupBy("mid").agg(F.min(F.struct("level", -F.col("size"), -F.col("n"), -F.col("origin"))).alias("b"), F.sum("n").alias("n_linked"))
    names = best.schema["b"].dataType.names
    return best.select("mid", F.col("b.level").alias("level"), (-F.col(f"b.`{names[3]}`")).alias("reply_to"), "n_linked")


def turns_before(rows: DataFrame) -> DataFrame:
    """conv_id, turn, before: the turn before each turn of a conversation, null for the first.

    Turns go in blocks of TURN_BLOCK; the last turns of blocks, one row each, give
    what the first turns of the next blocks follow.
    """
    block = F.floor(F.col("turn") / TURN_BLOCK)
    turns = rows.select("conv_id", "turn").distinct().withColumn("block", block)
    inside = F.lag("turn").over(Window.partitionBy("conv_id", "block").orderBy("turn"))
    last = turns.groupBy("conv_id", "block").agg(F.max("turn").alias("last"))
    last = last.withColumn("earlier", F.lag("last").over(Window.partitionBy("conv_id").orderBy("block")))
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b"))
    joined = turns.withColumn("inside", inside).join(last.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), "earlier"), same, "left")
    return joined.select("conv_id", "turn", F.coalesce("inside", "earlier").alias("before"))


def chat_messages(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, body, reply_to, n_quoted, n_linked for each message."""
    rows = Workspace(conversations.sparkSession, "chat").keep(messages(conversations), "messages")
    links = quotation_links(rows)
    b = turns_before(rows).select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), "before")
    joined = rows.join(links, "mid", "left").join(b, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("turn") == F.col("_t")), "left")
    return joined.select(
        "conv_id",
        "turn",
        "role",
        "text",
        "body",
        F.coalesce("reply_to", "before").alias("reply_to"),
        F.size(F.filter("lines", lambda x: x["level"] > 0)).alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"),
    )


def chat_format(conversations: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """conv_id, part, n_messages, n_quoted, n_linked, replies (turns answered) and the rendered chat."""
    rows = chat_messages(conversations)
    shown = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("body"), F.lit("\n<|end|>"))
    rows = rows.withColumn("shown", shown)
    size = rows.groupBy("conv_id").agg(F.sum(F.octet_length("shown") + F.octet_length("text")).alias("bytes"), F.min("turn").alias("low"), F.max("turn").alias("high"))
    large = size.filter(F.col("bytes") > part_bytes).withColumn("parts", F.ceil(F.col("bytes") / part_bytes)).withColumnRenamed("conv_id", "_c")
    # At most one conversation for each PART_BYTES of all texts is large; the sizes of conversations are not proven small, so the engine picks the join.
    rows = rows.join(large, F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    span = F.col("high") - F.col("low")
    by_turn = F.floor((F.col("turn") - F.col("low")) * F.col("parts") / (span + 1))
    by_message = F.pmod(F.xxhash64("role", "text"), F.col("parts"))
    rows = rows.withColumn("part", F.coalesce(F.when(span > 0, by_turn).otherwise(by_message), F.lit(0)).cast("bigint"))
    piece = F.struct("turn", "role", "text", "reply_to", "shown")
    out = rows.groupBy("conv_id", "part").agg(
        F.count("*").alias("n_messages"), F.sum("n_quoted").alias("n_quoted"), F.sum("n_linked").alias("n_linked"), F.sort_array(F.collect_list(piece)).alias("m")
    )
    return out.select(
        "conv_id",
        "part",
        "n_messages",
        "n_quoted",
        "n_linked",
        F.array_join(F.transform("m", lambda x: F.coalesce(x["reply_to"].cast("string"), F.lit("-"))), ",").alias("replies"),
        F.array_join(F.transform("m", lambda x: x["shown"]), "\n").alias("chat"),
    )
