"""Scalar predicates and string functions on token texts, as column builders."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and stop words of the field language.
DATE = r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2}"
CODE = r"[$€£]\s*\d|\d[.,/-]\d"
SEPARATOR = r"[:—–.•/]$"
STOP = (
    "o a de do da em no na para com por e ou um uma profissional normalmente canto superior inferior "
    "esquerdo direito imagem pode ser que qual faz parte"
)


def _bases() -> dict[str, str]:
    """Base letter of each composed letter of the Latin blocks."""
    found = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base != chr(code):
            found[chr(code)] = base
    return found


BASES = _bases()
ACCENTS, PLAIN = "".join(BASES), "".join(BASES.values())
MARKS = r"\p{Mn}+"


def strip(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def ends_with_colon(c: Column) -> Column:
    return strip(c).endswith(":")


def colon_in_middle(c: Column) -> Column:
    """Whether the first colon is neither the first nor the last character."""
    t = strip(c)
    return F.instr(t, ":").between(2, F.length(t) - 1)


def is_date(c: Column) -> Column:
    return c.rlike(DATE)


def is_code(c: Column) -> Column:
    return ~is_date(c) & c.rlike(CODE)


def is_number(c: Column) -> Column:
    return strip(c).rlike(r"^\d+$")


def is_text_only(c: Column) -> Column:
    return ~is_date(c) & ~is_code(c) & ~is_number(c) & c.rlike("[A-Za-zÀ-ÿ]")


def ends_with_separator(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "").rlike(SEPARATOR)


def is_whitish(c: Column) -> Column:
    """#fff, white, or every channel above 240."""
    low = F.lower(c)
    channel = lambda k: F.conv(F.substring(low, k, 2), 16, 10).cast("int") > 240
    return F.coalesce(low.isin("#fff", "white") | (low.rlike("^#[0-9a-f]{6}$") & channel(2) & channel(4) & channel(6)), F.lit(False))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def ascii_norm(c: Column) -> Column:
    """Lower-cased words of ASCII letters and digits; composed letters lose their marks, other characters go or part words."""
    low = F.translate(F.lower(c), ACCENTS + "_", PLAIN + " ")
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"[^\x00-\x7F]+", ""), r"[^a-z0-9]+", " "))


def plain_words(text: str) -> str:
    """ascii_norm of a text of the schema."""
    low = text.lower().translate(str.maketrans(BASES | {"_": " "}))
    return "".join(x if x.isalnum() else " " for x in low if x.isascii())


def accent_norm(c: Column) -> Column:
    return collapse(F.regexp_replace(F.lower(F.translate(c, ACCENTS, PLAIN)), MARKS, ""))


def keywords(c: Column, stop: str = STOP, shortest: int = 3) -> Column:
    """Distinct normalised words that are long enough and no stop words."""
    found = F.array_distinct(F.split(ascii_norm(c), " "))
    return F.filter(found, lambda w: (F.length(w) >= shortest) & ~w.isin(stop.split()))


def label_score(a: Column, b: Column, threshold: float = 0.0) -> Column:
    """The larger of word Jaccard and edit similarity, zero below a threshold."""
    x, y = accent_norm(a), accent_norm(b)
    s, t = F.array_distinct(F.split(x, " ")), F.array_distinct(F.split(y, " "))
    jaccard = F.size(F.array_intersect(s, t)) / F.size(F.array_union(s, t))
    edit = 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1))
    best = F.greatest(jaccard, edit)
    return F.when(best >= threshold, best).otherwise(0.0)


def label_words(x: Column) -> Column:
    """The distinct words of a text in its accent_norm."""
    return F.array_distinct(F.split(x, " "))


def near_length(x: Column, y: Column, threshold: float) -> Column:
    """Whether the lengths of two texts let their edit similarity reach a threshold."""
    return 1 - F.abs(F.length(x) - F.length(y)) / F.greatest(F.length(x), F.length(y), F.lit(1)) >= threshold


def words_score(x: Column, s: Column, y: Column, t: Column, threshold: float = 0.0) -> Column:
    """label_score of texts by their accent_norm (x, y) and label_words (s, t); below the threshold it may be any less.

    The edit distance is at least the difference in length, so it is only taken
    of texts whose lengths let it reach the threshold.
    """
    both = F.when(F.size(t) == 1, F.array_contains(s, y).cast("int")).otherwise(F.size(F.array_intersect(s, t)))
    jaccard = both / (F.size(s) + F.size(t) - both)
    edit = 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1))
    return F.greatest(jaccard, F.when(near_length(x, y, threshold), edit))


SEPARATORS = (" - ", " / ", " | ", ";", ",")
VALUE_LIKE = r"^\d+[.,]\d+|^R\s*\$|^\d{1,2}[/-]\d{1,2}|^\d{11,14}"


def multi_value(c: Column) -> Column:
    """Whether some separator leaves two or more parts that look like values."""
    hits = [F.size(F.filter(F.split(c, _quoted(s)), lambda x: F.trim(x).rlike(VALUE_LIKE))) >= 2 for s in SEPARATORS]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return out


def individual_values(c: Column) -> Column:
    """Distinct trimmed parts by the first separator present."""
    out = F.array(F.trim(c))
    for s in reversed(SEPARATORS):
        parts = F.array_distinct(F.filter(F.transform(F.split(c, _quoted(s)), lambda x: F.trim(x)), lambda x: x != ""))
        out = F.when(c.contains(s), parts).otherwise(out)
    return out


def _quoted(s: str) -> str:
    return s.replace("|", r"\|")


def truncated(c: Column, n: int) -> Column:
    """At most n characters, cut at a space beyond 0.7 n, with dots."""
    head = F.left(c, F.lit(n))
    at = n - F.instr(F.reverse(head), " ")
    cut = F.when((F.instr(F.reverse(head), " ") > 0) & (at > 0.7 * n), F.substring(head, F.lit(1), at)).otherwise(head)
    return F.when(F.length(c) <= n, c).otherwise(F.concat(cut, F.lit("...")))


def caps_ratio(c: Column) -> Column:
    """Share of upper-case letters among the letters."""
    letters = F.regexp_count(c, F.lit(r"\p{L}"))
    return F.when(letters > 0, F.regexp_count(c, F.lit(r"\p{Lu}")) / letters).otherwise(0.0)


def letter_spacing(c: Column, width: Column) -> Column:
    """Mean gap between characters, if all take the same share of the width; zero below two characters."""
    n, solid = F.length(c), F.length(F.regexp_replace(c, r"(?U)\s", ""))
    gap = (width - width / n * solid) / F.greatest(solid - 1, F.lit(1))
    return F.when((solid > 1) & (width > 0), gap).otherwise(0.0)


def contains_any(c: Column, needles: list[str]) -> Column:
    """Whether the normalised text contains one of the normalised needles."""
    low = accent_norm(c)
    found = [low.contains(accent_norm(F.lit(n))) for n in needles]
    return F.coalesce(F.greatest(*[x.cast("int") for x in found], F.lit(0), F.lit(0)) > 0, F.lit(False))


def first_line(c: Column) -> Column:
    return strip(F.split_part(F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n|\r", "\n"), F.lit("\n"), F.lit(1)))


def after_label(c: Column, names: list[str]) -> Column:
    """What follows the longest of the names that a text contains, without the colon between; null without any."""
    out = F.lit(None).cast("string")
    for name in sorted((n.strip() for n in names if n.strip()), key=len):
        low = name.lower()
        at = F.instr(F.lower(c), low)
        rest = F.regexp_replace(F.substring(c, at + len(low), F.length(c)), "^[ :\u200b\t]+", "")
        out = F.when((at > 0) & (rest != ""), rest).otherwise(out)
    return out


def run_id(at: Column, path: Column) -> Column:
    """A run's name: its time and the file's name without folder and ending."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")
    return F.concat(F.date_format(at, "yyyyMMdd_HHmmss"), F.lit("_"), stem)


def center_distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.least(F.lit(1.0), F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by)) / F.sqrt(F.lit(2.0)))
