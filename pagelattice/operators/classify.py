"""Pages to graphs with tables and roles, in one pass over each page."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.operators import role_rules, tables
from pagelattice.operators.page import Batch, Layouts, Page, Token, in_batches, list_of, page_rows

FACT_DDL = (
    "token_id int, ord int, text string, x0 double, y0 double, x1 double, y1 double, role string, source string, degree int, first boolean, "
    "value_id int, value_text string, label_id int, label_text string, label_far double, child_text string, has_label_child boolean, "
    "grandchild_text string, header_alone boolean, paths array<array<string>>, below array<string>"
)
EDGE_DDL = "from_id int, to_id int, relation string, edge_ord int"


def _struct(ddl: str) -> str:
    """A list of columns as a struct type."""
    parts, depth, at = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth == 0:
            parts.append(ddl[at:i].strip().replace(" ", ": ", 1))
            at = i + 1
    return f"struct<{', '.join(parts)}>"


PAGE_DDL = f"doc_id bigint, facts array<{_struct(FACT_DDL)}>, edges array<{_struct(EDGE_DDL)}>, cells array<{_struct(tables.CELL_DDL)}>, links array<struct<label_id: int, value_id: int>>"


def classified(tokens: list[Token], rules: list[role_rules.Rule] | None = None) -> tuple[Page, list[tables.Table]]:
    """A page with its roles settled, and its tables."""
    p = Page(tokens)
    found = tables.page_tables(p)
    settled = tables.give_roles(p, found)
    for r in role_rules.ORDER if rules is None else role_rules.ordered(rules):
        r.apply(p)
    for i, role in settled.items():
        p.give(i, role, "table")
    for t in tokens:
        role = p.settled(t.token_id)
        if role is not None:
            p.roles[t.token_id] = t.role = role
    tables.repaired(p, found)
    return p, found


def ruled(tokens: DataFrame, names: list[str]) -> DataFrame:
    """pages() after the named rules alone, from the roles that the tokens came with."""
    rules = role_rules.ordered([r for r in role_rules.RULES if r.name in names])

    def settle(tokens: list[Token]) -> tuple[Page, list[tables.Table]]:
        p = Page(tokens)
        for r in rules:
            r.apply(p)
        return p, []

    return _passed(tokens, settle)


def below(p: Page, i: int) -> list[int]:
    """Everything that edges lead to from a token, children before their next siblings, as often as it is met."""
    out, seen, stack = [], {i}, [iter(p.out[i])]
    while stack:
        nxt = next(stack[-1], None)
        if nxt is None:
            stack.pop()
            continue
        n = nxt[0]
        if n == i:
            continue
        out.append(n)
        if n not in seen:
            seen.add(n)
            stack.append(iter(p.out[n]))
    return out


def path(p: Page, i: int) -> list[int]:
    """A token and all that edges lead to from it, each once, children from the top and the left."""
    place = lambda n: (p.by_id[n].cy, p.by_id[n].cx)
    out, seen, stack = [], set(), [i]
    while stack:
        n = stack.pop()
        if n in seen:
            continue
        seen.add(n)
        out.append(n)
        stack += sorted((m for m, _ in p.out[n]), key=place, reverse=True)
    return out


def linked_value(p: Page, i: int) -> int | None:
    """The first value that an edge to the east or south of a label leads to."""
    if p.role(i) != "LABEL":
        return None
    return next((n for n, w in p.out[i] if w in ("east", "south") and p.role(n) == "VALUE"), None)


def linked_label(p: Page, i: int) -> int | None:
    if p.role(i) != "VALUE":
        return None
    return next((n for n, w in p.into[i] if w in ("east", "south") and p.role(n) == "LABEL"), None)


FACT = np.dtype(
    [("role", "i2"), ("source", "i2"), ("degree", "i4"), ("first", "?"), ("value", "i4"), ("label", "i4"), ("far", "f8"), ("child", "i4")]
    + [("has", "?"), ("grandchild", "i4"), ("alone", "?"), ("paths", "i4"), ("below", "i4")]
)
EDGE, CELL, LINK = (np.dtype([(n, "i4") for n in names.split()]) for names in ("from_id to_id relation edge_ord", "table_id token_id row col orientation", "label_id value_id"))
#: Roles, sources, relations and orientations that a worker has met, by code.
_NAMES: dict[str, int] = {}


def _code(name: str | None) -> int:
    return -1 if name is None else _NAMES.setdefault(name, len(_NAMES))


def _named(codes: np.ndarray) -> pa.Array:
    return pa.array(list(_NAMES), pa.string()).take(pa.array(codes.astype(np.int64), mask=codes < 0))


@dataclass
class Shape:
    """What matching asks of each token of a layout, and its edges, cells and links; tokens by place, -1 for none."""

    facts: np.ndarray
    path_sizes: np.ndarray
    path_at: np.ndarray
    below_at: np.ndarray
    edges: np.ndarray
    cells: np.ndarray
    links: np.ndarray

    @property
    def nbytes(self) -> int:
        return sum(v.nbytes for v in vars(self).values())


def shape(p: Page, found: list[tables.Table]) -> Shape:
    at = {t.token_id: k for k, t in enumerate(p.tokens)}
    index = lambda i: -1 if i is None else at[i]
    place = lambda n: (p.by_id[n].cy, p.by_id[n].cx)
    rows, paths, under = [], [], []
    for k, t in enumerate(p.tokens):
        i, role = t.token_id, p.role(t.token_id)
        value, label = linked_value(p, i), linked_label(p, i)
        children = [n for n, _ in p.out[i]]
        label_children = [n for n in children if p.role(n) == "LABEL"]
        far = -1.0
        if label is not None:
            o = p.by_id[label]
            far = min(1.0, (((o.cx - t.cx) ** 2 + (o.cy - t.cy) ** 2) ** 0.5) / 2**0.5)
        own = [[at[m] for m in path(p, n)] for n in sorted(children, key=place)] if role == "HEADER" else None
        lower = [at[n] for n in sorted(below(p, i), key=place)] if role == "LABEL" and value is None else None
        paths += own or []
        under += lower or []
        child = next((n for n in children if p.role(n) == "VALUE"), None)
        grandchild = next((v for n in label_children if (v := linked_value(p, n)) is not None), None)
        alone = not any(w in ("south", "east") and p.role(n) == "VALUE" for n, w in p.out[i])
        size = lambda x: -1 if x is None else len(x)
        rows.append(
            (_code(role), _code(p.sources.get(i) if role else None), len(p.out[i]) + len(p.into[i]), k == 0, index(value), index(label), far, index(child))
            + (bool(label_children), index(grandchild), alone, size(own), size(lower))
        )
    whole = lambda x: np.array(x, np.int32)
    edges = [(a, b, _code(w), k) for k, (a, b, w) in enumerate(p.edges)]
    cells = [(c["table_id"], c["token_id"], c["row"], c["col"], _code(c["orientation"])) for n, t in enumerate(found) for c in t.cells(n)]
    return Shape(
        np.array(rows, FACT), whole([len(x) for x in paths]), whole([k for x in paths for k in x]), whole(under), np.array(edges, EDGE), np.array(cells, CELL), np.array(list(p.value_of.items()), LINK)
    )


#: All of a token that the pass reads, but for color and role, which are compared as texts, and the words of vertical tables.
_READ = (
    "token_id text x0 y0 x1 y1 font_size bold italic separated_pair date code number plain separator colon_end colon_inside digits white n_words"
).split()


def _passed(tokens: DataFrame, settle: Callable[[list[Token]], tuple[Page, list[tables.Table]]], shared: bool = True) -> DataFrame:
    """PAGE_DDL of pages through settle; pages of one layout go through it once, unless it may read more than _READ."""

    def shapes(b: Batch, layouts: Layouts) -> list[Shape]:
        m, text = b.matrix(_READ), b.columns["text"]
        given = [None if c.null_count == len(c) else c.to_pylist() for c in (b.columns["color"], b.columns["role"])]
        out = []
        for i, j in zip(b.starts.tolist(), b.ends.tolist(), strict=True):

            def whole(i=i, j=j) -> tuple[Page, list[tables.Table]]:
                return settle([Token(**t) for t in b.tokens.slice(i, j - i).to_pylist()])

            def first(size: int, whole=whole, at=i) -> tuple:
                """A shape, or the places of words that it depends on."""
                p, found = whole()
                vertical = {i for t in found if t.orientation == "vertical" for line in t.rows for i in line}
                if vertical:
                    return [k for k, t in enumerate(p.tokens) if t.token_id in vertical], size
                made = shape(p, found)
                return made, made.nbytes + size

            def second(size: int, whole=whole) -> tuple[Shape, int]:
                made = shape(*whole())
                return made, made.nbytes + size

            if not shared:
                out.append(second(0)[0])
                continue
            key = (m[i:j].tobytes(), *[c and tuple(c[i:j]) for c in given])
            own = layouts.of(key, lambda: first(len(key[0])))
            if isinstance(own, list):
                words = tuple((tables.keyed(s), tables.telling(s)) for k in own for s in (text[i + k].as_py(),))
                own = layouts.of((key, words), lambda: second(len(key[0])))
            out.append(own)
        return out

    def work(b: Batch, layouts: Layouts) -> list[pa.Array]:
        found = shapes(b, layouts)
        joined = lambda name, kind: np.concatenate([*[getattr(s, name) for s in found], np.zeros(0, kind)])
        f, base = joined("facts", FACT), np.repeat(b.starts, b.sizes)
        text, token_id = b.columns["text"], b.columns["token_id"]
        pick = lambda c, n: c.take(pa.array(f[n] + base, mask=f[n] < 0))
        texts = lambda name: text.take(pa.array(joined(name, np.int32) + np.repeat(b.starts, [len(getattr(s, name)) for s in found])))
        lists = lambda name, values: list_of(np.maximum(f[name], 0), values, f[name] < 0)
        facts = {
            "token_id": token_id,
            **{n: b.columns[n] for n in ("ord", "text", "x0", "y0", "x1", "y1")},
            "role": _named(f["role"]),
            "source": _named(f["source"]),
            "degree": pa.array(f["degree"]),
            "first": pa.array(f["first"]),
            "value_id": pick(token_id, "value"),
            "value_text": pick(text, "value"),
            "label_id": pick(token_id, "label"),
            "label_text": pick(text, "label"),
            "label_far": pa.array(f["far"], mask=f["far"] < 0),
            "child_text": pick(text, "child"),
            "has_label_child": pa.array(f["has"]),
            "grandchild_text": pick(text, "grandchild"),
            "header_alone": pa.array(f["alone"]),
            "paths": lists("paths", list_of(joined("path_sizes", np.int32), texts("path_at"))),
            "below": lists("below", texts("below_at")),
        }
        columns = lambda v: {n: _named(v[n]) if n in ("relation", "orientation") else pa.array(v[n]) for n in v.dtype.names}
        rows = lambda c: pa.StructArray.from_arrays(list(c.values()), list(c))
        parts = [list_of([len(getattr(s, n)) for s in found], rows(columns(joined(n, kind)))) for n, kind in (("edges", EDGE), ("cells", CELL), ("links", LINK))]
        return [b.doc_id, list_of(b.sizes, rows(facts)), *parts]

    return in_batches(page_rows(tokens), PAGE_DDL, work)


def pages(tokens: DataFrame, rules: list[role_rules.Rule] | None = None) -> DataFrame:
    """doc_id with facts of tokens, edges, table cells and links as arrays; one shuffle by page."""
    known = rules is None or all(r in role_rules.RULES for r in rules)
    return _passed(tokens, lambda own: classified(own, rules), known)


def part(classified_pages: DataFrame, name: str) -> DataFrame:
    """One of the arrays of pages() as rows."""
    return classified_pages.select("doc_id", F.inline(name))
