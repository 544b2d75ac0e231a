"""Quality rules: a threshold table compiled into one projection.

Every measure is a built-in expression over one row, so the operator is a scan
and a projection: no shuffle, no Python, nothing kept between rows.

Defined cases: a null text counts as empty and fails the base rule; texts of
any length are measured whole; repeated rows are judged alike; an empty table
gives an empty result; the documents' own columns all pass through, those named
like a measure or verdict as own_ and their name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.common import SPACE_PATTERN, ascii_lower, let, words

# Frequent function words of English, German, French, Spanish.
STOP_WORDS = (
    "the of and to in that is was for on with as it by be this are from at or "
    "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als für "
    "de la le et les des en un du une que est pour qui dans a par plus pas au "
    "de la que el en y a los se del las un por con no una su para es al"
)
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


@dataclass(frozen=True)
class Rule:
    """A text is kept while lowest <= measure <= highest."""

    name: str
    measure: str
    lowest: float | None = None
    highest: float | None = None


#: Ratios are per word, per character of words, or per line.
RULES = (
    Rule("word_length", "mean_word_chars", 2.0, 10.0),
    Rule("symbols", "symbol_ratio", None, 0.05),
    Rule("stop_words", "stop_word_ratio", 0.02, None),
    Rule("shouting", "exclamation_ratio", None, 0.30),
    Rule("dup_lines", "dup_line_ratio", None, 0.40),
)


#: Columns that the operator adds, and a passing one.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words", "n_exclamations", "n_repeat_words")
RATIOS = ("mean_word_chars", "symbol_ratio", "stop_word_ratio", "exclamation_ratio", "dup_line_ratio")
ROW = "quality_rules_row"
MEASURES = (*COUNTS, *RATIOS, "base_failed", "failed_rules", "kept", ROW)

#: Places of windows fit in so many low bits of a sort key beside a hash.
PLACE_BITS = 24


def _repeat_words(w: str, windows: str) -> str:
    """Words inside windows that occur twice or more.

    Keys of hash and place sort as plain longs; neighbours of one hash whose
    words are equal mark their places, and a fold over the sorted places adds
    up what they cover. Where windows of one hash differ, or there are more
    windows than places, the windows sort by their words instead.
    """

    def covered(s: str, place: str, same: str) -> str:
        equal = lambda j: f"({same.format('k', j)} and slice(w, {place.format('k')} + 1, {WINDOW}) = slice(w, {place.format(j)} + 1, {WINDOW}))"
        body = f"""
      aggregate(
        sort_array(transform(
          filter(sequence(0, size(s) - 1), k -> (k > 0 and {equal("greatest(k - 1, 0)")})
            or (k < size(s) - 1 and {equal("least(k + 1, size(s) - 1)")})),
          k -> {place.format("k")})),
        struct(0L as n, 0 as till),
        (a, p) -> struct(a.n + cast(p + {WINDOW} - greatest(p, a.till) as bigint) as n, p + {WINDOW} as till),
        a -> a.n)"""
        return let(w, "w", let(s, "s", body))

    low = 2**PLACE_BITS - 1
    packed = covered(
        f"sort_array(transform({windows}, (h, i) -> (h & {~low}L) | i))",
        f"cast(s[{{0}}] & {low}L as int)",
        f"shiftright(s[{{0}}], {PLACE_BITS}) = shiftright(s[{{1}}], {PLACE_BITS})",
    )
    by_words = covered(f"sort_array(transform({windows}, (h, i) -> struct(slice(w, i + 1, {WINDOW}) as h, i as i)))", "s[{0}].i", "s[{0}].h = s[{1}].h")
    one_hash = f"shiftright(s[k], {PLACE_BITS}) = shiftright(s[k + 1], {PLACE_BITS})"
    differ = f"slice(w, cast(s[k] & {low}L as int) + 1, {WINDOW}) <> slice(w, cast(s[k + 1] & {low}L as int) + 1, {WINDOW})"
    keys = f"sort_array(transform({windows}, (h, i) -> (h & {~low}L) | i))"
    clash = let(w, "w", let(keys, "s", f"exists(sequence(0, size(s) - 2), k -> {one_hash} and {differ})"))
    return f"""case when size({windows}) < 2 or size(array_distinct({windows})) = size({windows}) then 0L
      when size({windows}) > {low} or {clash} then {by_words} else {packed} end"""


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts and ratios that rules refer to."""
    own = [F.col(f"`{c}`").alias(f"own_{c}" if c in MEASURES else c) for c in docs.columns]
    p = "_qr_"
    while any(c.startswith(p) for c in docs.columns):
        p += "_"
    df = docs.select(*own, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(f"{p}t"), words(F.col(f"`{text}`")).alias(f"{p}w"))
    lines = F.filter(F.split(f"{p}t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumns({f"{p}1": F.transform(f"{p}w", lambda w: F.xxhash64(w)), f"{p}l": lines})
    for n in (1, 2, 4):  # hashes of twice as many words; those that the end cuts are left off below
        df = df.withColumn(f"{p}{2 * n}", F.expr(let(f"{p}{n}", "a", f"transform(a, (h, i) -> xxhash64(h, get(a, i + {n})))")))
    df = df.withColumn(f"{p}h", F.expr(f"slice({p}{WINDOW}, 1, greatest(size({p}w) - {WINDOW - 1}, 0))"))
    stop = sorted(set(STOP_WORDS.split()))
    length = F.length(f"{p}t")

    def without(characters: str) -> Column:
        left = F.col(f"{p}t")
        for c in characters:
            left = F.replace(left, F.lit(c), F.lit(""))
        return left

    df = df.withColumns(
        {
            "n_words": F.size(f"{p}w").cast("bigint"),
            "word_chars": F.length(without(" \t\n\x0b\x0c\r")).cast("bigint"),
            "n_symbols": (length - F.length(without(SYMBOLS))).cast("bigint"),
            "n_lines": F.size(f"{p}l").cast("bigint"),
            "n_dup_lines": (F.size(f"{p}l") - F.size(F.array_distinct(f"{p}l"))).cast("bigint"),
            "n_stop_words": F.size(F.filter(F.split(F.trim(ascii_lower(F.col(f"{p}t"))), SPACE_PATTERN), lambda w: w.isin(stop))).cast("bigint"),
            "n_exclamations": (length - F.length(without("!"))).cast("bigint"),
            "n_repeat_words": F.expr(_repeat_words(f"{p}w", f"{p}h")),
            ROW: F.monotonically_increasing_id(),
        }
    )
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return df.withColumns(
        {
            "mean_word_chars": per("word_chars", "n_words"),
            "symbol_ratio": per("n_symbols", "word_chars"),
            "stop_word_ratio": per("n_stop_words", "n_words"),
            "exclamation_ratio": per("n_exclamations", "n_words"),
            "dup_line_ratio": per("n_dup_lines", "n_lines"),
        }
    ).drop(*[f"{p}{x}" for x in ("t", "w", "h", "l", "1", "2", "4", "8")])


def passes(rule: Rule) -> Column:
    value = F.col(rule.measure)
    low = F.lit(True) if rule.lowest is None else value >= F.lit(rule.lowest)
    high = F.lit(True) if rule.highest is None else value <= F.lit(rule.highest)
    return low & high


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Measures, base_failed, one failed_rules list, and kept."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    failed = F.array_compact(F.array(*[F.when(~passes(r), F.lit(r.name)) for r in rules])) if rules else F.array().cast("array<string>")
    out = measured(docs, text).withColumns({"base_failed": base, "failed_rules": failed})
    # A row number keeps a filter on the verdict above the measures, which it would else compute again.
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0) & (F.col(ROW) >= 0)).drop(ROW)


def rejected_out(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with their own columns."""
    names = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}
    inner = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    judged = quality_rules(inner, rules, names["text"]).filter("kept")
    return judged.select(*[F.col(n).alias(c) for c, n in names.items()])
