"""Rules that give the tokens of a page their roles: header, label or value.

A rule is a function of the page that may change roles, links and edges. Rules
run by rank, and later ones see what earlier ones did. Tables come before the
rules and have the last word over them; a role that came with a token, or that
the pairing of headers wrote to it, stands above both.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pagelattice.operators.page import Page, Token, touch

TOP = 0.20
LARGE = 1.2
DEFAULT_FONT = 12.0
FOOT = 0.95
ROW_STEP = 0.01
FONT_STEP = 1.0
NEAR_FACTOR = 3
#: Header above this height, or a section's between these, when it has one neighbour.
UPPER_HALF, SECTION = 0.5, (0.3, 0.9)


@dataclass(frozen=True)
class Rule:
    name: str
    rank: int
    after: tuple[str, ...]
    apply: Callable[[Page], None]


RULES: list[Rule] = []


def rule(rank: int, *after: str):
    def register(f: Callable[[Page], None]) -> Callable[[Page], None]:
        RULES.append(Rule(f.__name__, rank, after, f))
        return f

    return register


def ordered(rules: list[Rule]) -> list[Rule]:
    """By rank, each after the rules that it names; a rule whose needs cannot be met comes when nothing else can."""
    left, out, done = sorted(rules, key=lambda r: r.rank), [], set()
    while left:
        pick = next((r for r in left if set(r.after) <= done), left[0])
        left.remove(pick)
        out.append(pick)
        done.add(pick.name)
    return out


def mean_font(p: Page) -> float:
    sizes = [t.font_size for t in p.tokens if t.font_size and t.font_size > 0]
    return sum(sizes) / len(sizes) if sizes else DEFAULT_FONT


def prominent(t: Token, mean: float) -> bool:
    """Large text at the top of a page that is no number and ends in no separator."""
    if not t.text or not t.font_size or t.font_size <= 0 or t.y0 >= TOP or t.separator or t.number:
        return False
    return t.font_size >= mean * LARGE or (t.font_size > mean and t.n_words >= 2)


def short_text(t: Token) -> bool:
    return bool(t.text) and not t.digits and t.n_words <= 2 and not t.separator


def value_like(t: Token) -> bool:
    return bool(t.text) and not t.separator and (t.digits or t.n_words >= 2)


def over(upper: Token, lower: Token) -> bool:
    """Whether a token lies above another one and in its column."""
    return upper.y1 < lower.y0 and touch(upper.x0, upper.x1, lower.x0, lower.x1)


def values_to_place(p: Page) -> Iterator[Token]:
    """Values and dates without a label, one at a time, so that each sees what the others changed."""
    for t in p.tokens:
        if p.role(t.token_id) != "VALUE" and not t.date:
            continue
        if p.role(t.token_id) != "VALUE":
            p.give(t.token_id, "VALUE", "date")
        if t.token_id not in p.label_of:
            yield t


@rule(10)
def initial_label(p: Page) -> None:
    for t in p.tokens:
        role = p.role(t.token_id)
        if t.text and role == "LABEL":
            p.labels.setdefault(t.token_id)
        elif t.text and not role and (t.separator or t.colon_inside):
            p.give(t.token_id, "LABEL", "initial_label")


@rule(20, "initial_label")
def initial_value(p: Page) -> None:
    """Labels claim the first free value to their right, else below."""
    fits = lambda n: n not in p.label_of and (p.role(n) == "VALUE" or value_like(p.by_id[n]))
    for label in list(p.labels):
        if label in p.value_of:
            continue
        value = next((n for n in p.near(label, "east", "south") if fits(n)), None)
        if value is None:
            continue
        p.link(label, value)
        if p.role(value) != "VALUE":
            p.give(value, "VALUE", "initial_value")


@rule(30, "initial_value")
def initial_header(p: Page) -> None:
    mean = mean_font(p)
    for t in p.tokens:
        if not t.text or p.role(t.token_id) is not None:
            continue
        around = p.around(t.token_id)
        known = {p.role(n) for n in around} - {None}
        on_dark = bool(t.font_size and t.font_size > 0) and t.white and not (t.separator or t.number or t.date)
        if known == {"LABEL"} or on_dark or prominent(t, mean):
            p.give(t.token_id, "HEADER", "initial_header")
        elif len(around) <= 1 and short_text(t):
            section = bool(around) and (p.by_id[around[0]].cy < t.cy or SECTION[0] < t.cy < SECTION[1])
            if not around or t.cy < UPPER_HALF or section:
                p.give(t.token_id, "HEADER", "initial_header")
        elif value_like(t) and t.token_id not in p.label_of and not any(n in p.labels for n in around):
            p.give(t.token_id, "VALUE", "initial_header")


@rule(35, "initial_value")
def separated_pair_isolation(p: Page) -> None:
    """The two parts of a split text lose the edges that lead down from them."""
    gone = set()
    for t in p.tokens:
        if not t.separated_pair or p.role(t.token_id) != "LABEL":
            continue
        value = next((n for n in p.near(t.token_id, "east") if p.by_id[n].separated_pair and p.role(n) == "VALUE"), None)
        if value is not None:
            gone |= {(a, n, "south") for a, b in ((t.token_id, value), (value, t.token_id)) for n in p.near(a, "south") if n != b}
    if gone:
        p.drop_edges(gone)


@rule(40, "initial_header")
def label_only_connections(p: Page) -> None:
    for t in p.tokens:
        onward = p.near(t.token_id, "east", "south")
        if p.role(t.token_id) == "LABEL" and onward and all(p.role(n) == "LABEL" for n in onward):
            p.give(t.token_id, "HEADER", "label_only_connections")
            p.labels.pop(t.token_id, None)


@rule(50)
def header_preservation(p: Page) -> None:
    mean = mean_font(p)
    for t in p.tokens:
        if prominent(t, mean) and p.role(t.token_id) != "HEADER":
            p.give(t.token_id, "HEADER", "header_preservation")


@rule(60)
def value_label_uniqueness(p: Page) -> None:
    """A value without a label takes the nearest plain text above, else to its left."""
    for v in values_to_place(p):
        plain = [o for o in p.tokens if o is not v and o.plain]
        above = [(v.y0 - o.y1, abs(o.cx - v.cx), k, o) for k, o in enumerate(plain) if over(o, v)]
        left = [(v.x0 - o.x1, abs(o.cy - v.cy), k, o) for k, o in enumerate(plain) if o.x1 < v.x0 and touch(o.y0, o.y1, v.y0, v.y1)]
        found = min(above or left, default=None, key=lambda c: c[:3])
        if found is None or p.role(found[3].token_id) == "HEADER":
            continue
        label = found[3].token_id
        if p.role(label) != "LABEL":
            p.give(label, "LABEL", "value_label_uniqueness")
        p.link(label, v.token_id)


def style_groups(p: Page) -> list[list[Token]]:
    """Tokens of one row and style, where a font may differ by FONT_STEP from the group's."""
    groups: dict[tuple, list[Token]] = {}
    for t in p.tokens:
        size = t.font_size or 0.0
        row, look = round(t.cy / ROW_STEP) * ROW_STEP, (t.bold, t.italic, t.color)
        base = round(size / FONT_STEP) * FONT_STEP if size > 0 else 0
        key = next((k for k in groups if k[0] == row and k[2] == look and abs(size - k[1]) <= FONT_STEP), (row, base, look))
        groups.setdefault(key, []).append(t)
    return [sorted(g, key=lambda t: t.x0) for g in groups.values() if len(g) > 1]


@rule(70, "value_label_uniqueness")
def typographic_hierarchy(p: Page) -> None:
    """Roles go on along the east edges of a row of one style."""
    for group in style_groups(p):
        for a, b in zip(group, group[1:], strict=False):
            role, has = p.role(a.token_id), p.role(b.token_id)
            if not role or has == "HEADER" or b.token_id not in p.near(a.token_id, "east"):
                continue
            if role == "LABEL":
                p.give(b.token_id, "VALUE" if b.typed else "LABEL", "typographic_hierarchy")
            elif not b.typed and not has:
                p.give(b.token_id, role, "typographic_hierarchy")


@rule(80, "typographic_hierarchy")
def numeric_code_label(p: Page) -> None:
    """A code's plain neighbour above, left or right is its label."""
    for t in p.tokens:
        if not t.code:
            continue
        label = next((n for n in p.near(t.token_id, "north", "west", "east") if p.by_id[n].plain and p.role(n) in (None, "", "VALUE")), None)
        if label is None:
            continue
        p.give(label, "LABEL", "numeric_code_label")
        p.link(label, t.token_id)
        p.give(t.token_id, "VALUE", "numeric_code_label")
        p.labels.pop(t.token_id, None)


@rule(90, "numeric_code_label")
def date_label_cleanup(p: Page) -> None:
    for t in p.tokens:
        if p.role(t.token_id) != "LABEL" or t.separator or t.colon_inside:
            continue
        around = p.around(t.token_id)
        dates = [n for n in around if p.by_id[n].date]
        if dates and not any(p.by_id[n].code for n in around) and not any(p.label_of.get(n) == t.token_id for n in dates):
            p.labels.pop(t.token_id, None)
            p.give(t.token_id, None, "date_label_cleanup")


@rule(100)
def label_without_edges(p: Page) -> None:
    for t in p.tokens:
        if p.role(t.token_id) == "LABEL" and not p.out[t.token_id] and not p.into[t.token_id]:
            p.labels.pop(t.token_id, None)
            p.give(t.token_id, "HEADER", "label_without_edges")


@rule(105, "label_without_edges")
def isolated_short_text_header(p: Page) -> None:
    for t in p.tokens:
        i = t.token_id
        if p.role(i) not in ("VALUE", None) or not short_text(t) or t.cy >= FOOT or len(p.around(i)) > 1:
            continue
        p.give(i, "HEADER", "isolated_short_text_header")
        p.value_of.pop(p.label_of.pop(i, None), None)
        p.label_of.pop(p.value_of.pop(i, None), None)


@rule(110)
def value_label_guarantee(p: Page) -> None:
    """A value without a label takes the first plain text above it, in input order, that is free."""
    for v in values_to_place(p):
        label = next((o.token_id for o in p.tokens if o is not v and o.plain and over(o, v) and p.role(o.token_id) in (None, "", "VALUE")), None)
        if label is not None:
            p.give(label, "LABEL", "value_label_guarantee")
            p.link(label, v.token_id)


def after_colons(p: Page, i: int, seen: set[int]) -> int | None:
    """The first token down, else right, of a chain of texts that end in a colon."""
    if i in seen:
        return None
    if not p.by_id[i].colon_end:
        return i
    seen.add(i)
    return next((v for n in p.near(i, "south", "east") if (v := after_colons(p, n, seen)) is not None), None)


@rule(120)
def colon_recursive(p: Page) -> None:
    for t in p.tokens:
        value = after_colons(p, t.token_id, set()) if t.colon_end else None
        if value is None:
            continue
        p.give(t.token_id, "LABEL", "colon_recursive")
        p.give(value, "VALUE", "colon_recursive")
        p.link(t.token_id, value)
        p.labels.pop(value, None)


def no_header(p: Page, t: Token, role_of: Callable[[int], str | None], source: str) -> None:
    """The role of a header that turned out to be none."""
    if t.colon_end:
        role = "LABEL"
    elif t.typed or any(role_of(n) == "LABEL" for n in p.near(t.token_id, "south", "east")):
        role = "VALUE"
    else:
        role = "LABEL"
    p.give(t.token_id, role, source)


@rule(130)
def header_no_north(p: Page) -> None:
    for t in p.tokens:
        if p.role(t.token_id) == "HEADER" and p.near(t.token_id, "north"):
            no_header(p, t, p.role, "header_no_north")


@rule(140)
def value_no_label_connections(p: Page) -> None:
    """Below and right of a value there is no label, unless it ends in a colon."""
    for t in p.tokens:
        if p.role(t.token_id) != "VALUE":
            continue
        for n in p.near(t.token_id, "south", "east"):
            if p.role(n) == "LABEL" and not p.by_id[n].colon_end:
                p.give(n, "VALUE", "value_no_label_connections")
                p.labels.pop(n, None)
                p.label_of.pop(p.value_of.pop(n, None), None)


def before(o: Token, v: Token) -> str | None:
    """Where a token lies as a label of a value should: left at any height, or above in its column."""
    if o.x1 <= v.x0:
        return "left"
    return "above" if o.y1 <= v.y0 and touch(o.x0, o.x1, v.x0, v.x1) else None


@rule(150, "value_label_uniqueness", "value_label_guarantee")
def value_must_have_label(p: Page) -> None:
    for v in p.tokens:
        i = v.token_id
        if p.role(i) != "VALUE":
            continue
        has = p.label_of.get(i)
        if has is not None and p.role(has) == "LABEL" and before(p.by_id[has], v):
            continue
        placed = [(o, side) for o in p.tokens if o is not v and (side := before(o, v))]
        labels = [(v.x0 - o.x1 if side == "left" else v.y0 - o.y1, o.token_id) for o, side in placed if p.role(o.token_id) == "LABEL"]
        free = [o.token_id for o, _ in placed if not p.role(o.token_id) and not o.digits]
        if labels:
            p.link(min(labels, key=lambda c: c[0])[1], i)
        elif free:
            p.give(free[0], "LABEL", "value_must_have_label")
            p.link(free[0], i)


@rule(200, "value_label_uniqueness", "value_no_label_connections")
def label_single_value(p: Page) -> None:
    """A label keeps one value: the first to the right, below, above or left; edges to others go."""
    first = {}
    for t in p.tokens:
        if p.role(t.token_id) == "LABEL":
            value = next((n for n in p.near(t.token_id, "east", "south", "north", "west") if p.settled(n) == "VALUE"), None)
            if value is not None:
                first[t.token_id] = value
                p.link(t.token_id, value)
    gone = {(a, b, w) for a, b, w in p.edges if p.settled(a) == "LABEL" and p.settled(b) == "VALUE" and first.get(a, b) != b}
    if gone:
        p.drop_edges(gone)


def beside(h: Token, o: Token, loose: bool) -> float | None:
    """Distance of a token close below a header, or close to its right; loosely also of one in its row and column."""
    columns, rows = touch(o.x0, o.x1, h.x0, h.x1), touch(o.y0, o.y1, h.y0, h.y1)
    high, wide = h.y1 - h.y0, h.x1 - h.x0
    if o.y0 > h.y1 and columns and o.y0 - h.y1 < high * NEAR_FACTOR:
        return o.y0 - h.y1
    if o.x0 > h.x1 and rows and o.x0 - h.x1 < wide * NEAR_FACTOR:
        return o.x0 - h.x1
    if loose and rows and columns and abs(o.y0 - h.y0) < high * 2:
        return abs(o.y0 - h.y0)
    return None


@rule(200)
def adjacent_headers(p: Page) -> None:
    """A header without a value makes a pair with the nearest header, else unknown token, beside it."""
    has_value = lambda i: any(p.role(n) == "VALUE" for n, _ in p.out[i])
    headers = [t for t in p.tokens if p.role(t.token_id) == "HEADER"]
    for h in headers:
        if has_value(h.token_id):
            continue
        unknown = [t for t in p.tokens if p.role(t.token_id) in ("HEADER", None)]
        best = None
        for pool, loose in ((headers, False), (unknown, True)):
            near = [(d, k, o) for k, o in enumerate(pool) if o is not h and (d := beside(h, o, loose)) is not None and not has_value(o.token_id)]
            if near:
                best = min(near, key=lambda c: c[:2])[2]
                break
        if best is None:
            continue
        for t, role in ((h, "LABEL"), (best, "VALUE")):
            p.give(t.token_id, role, "adjacent_headers")
            t.role = role
        p.link(h.token_id, best.token_id)
        if all(n != best.token_id for n, _ in p.out[h.token_id]):
            p.edges.append((h.token_id, best.token_id, "south" if best.y0 > h.y1 else "east"))
            p.rebuild()


@rule(250, "header_no_north", "label_single_value")
def header_no_north_west(p: Page) -> None:
    """Edges into headers from others go; headers that headers still lead to are none."""
    headers = {t.token_id for t in p.tokens if p.settled(t.token_id) == "HEADER"}
    gone = {(a, b, w) for a, b, w in p.edges if (b in headers and w in ("south", "east") and p.settled(a) != "HEADER") or (a in headers and w in ("north", "west"))}
    if gone:
        p.drop_edges(gone)
    for t in p.tokens:
        if t.token_id in headers and p.near(t.token_id, "north", "west"):
            no_header(p, t, p.settled, "header_no_north_west")


ORDER = ordered(RULES)
