"""One page as a plain graph: its tokens, lines, edges and neighbours.

Role rules read what earlier rules changed on the same page, so a page goes
through them as one value. The graph is built in the same pass, which spares
the shuffles that joins of neighbours would take; the operators of graph.py
take lines and edges from here too, for use on their own. Pages of one layout
share what is computed for them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pagelattice.functions import text as X
from pagelattice.operators import graph as G

WAYS = ("east", "west", "north", "south")
PAGES_AT_ONCE = 64


@dataclass(slots=True, eq=False)
class Token:
    """A token with its box, style and what its text is."""

    token_id: int
    ord: int
    text: str
    x0: float
    y0: float
    x1: float
    y1: float
    font_size: float | None = None
    bold: bool | None = None
    italic: bool | None = None
    color: str | None = None
    role: str | None = None
    separated_pair: bool | None = None
    date: bool = False
    code: bool = False
    number: bool = False
    plain: bool = False
    separator: bool = False
    colon_end: bool = False
    colon_inside: bool = False
    digits: bool = False
    white: bool = False
    n_words: int = 0
    cx: float = field(init=False)
    cy: float = field(init=False)

    def __post_init__(self):
        self.cx, self.cy = (self.x0 + self.x1) / 2.0, (self.y0 + self.y1) / 2.0

    @property
    def typed(self) -> bool:
        return self.date or self.code or self.number


def flags(c: Column) -> dict[str, Column]:
    """What the rules ask of a text."""
    return {
        "date": X.is_date(c),
        "code": X.is_code(c),
        "number": X.is_number(c),
        "plain": X.is_text_only(c),
        "separator": X.ends_with_separator(c),
        "colon_end": X.ends_with_colon(c),
        "colon_inside": X.colon_in_middle(c),
        "digits": c.rlike(r"\d"),
        "n_words": F.when(c == "", 0).otherwise(F.size(F.split(c, r"(?U)\s+"))),
    }


_OPTIONAL = {"font_size": "double", "bold": "boolean", "italic": "boolean", "color": "string", "role": "string", "separated_pair": "boolean"}


def page_rows(tokens: DataFrame) -> DataFrame:
    """doc_id, t: each page's tokens with their flags, in input order, as one array."""
    missing = {c: F.lit(None).cast(kind) for c, kind in _OPTIONAL.items() if c not in tokens.columns}
    t = tokens.withColumns(missing | {"text": X.strip(F.coalesce(F.col("text"), F.lit("")))})
    t = t.withColumns(flags(F.col("text")) | {"white": X.is_whitish(F.col("color"))})
    names = [f.name for f in Token.__dataclass_fields__.values() if f.init]
    kinds = {"token_id": "int", "ord": "int", "x0": "double", "y0": "double", "x1": "double", "y1": "double", "n_words": "int"} | _OPTIONAL
    item = F.struct(F.col("ord").cast("int").alias("ord"), *[F.col(n).cast(kinds[n]).alias(n) if n in kinds else F.col(n) for n in names if n != "ord"])
    return t.groupBy("doc_id").agg(F.sort_array(F.collect_list(item)).alias("t"))


def per_page(pages: DataFrame, work: Callable[[dict], dict], ddl: str) -> DataFrame:
    """Each row of pages through work, in batches of bounded numbers of pages."""
    schema = T.StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), PAGES_AT_ONCE):
                yield pa.RecordBatch.from_pylist([work(p) for p in b.slice(at, PAGES_AT_ONCE).to_pylist()], schema=arrow)

    return pages.mapInArrow(run, schema)


#: Pages of one batch that goes out, and bytes of layouts that a worker keeps.
ROWS_AT_ONCE, LAYOUT_BYTES = 256, 64_000_000
_LAYOUTS: dict[str, dict] = {}


class Layouts:
    """What pages of one layout have in common, computed once in a worker: pages of a form differ in their texts alone.

    The key of a layout is all that the pass reads, byte by byte, so a page that
    is not like an earlier one is computed. name tells the plans of a worker apart.
    """

    def __init__(self, name: str):
        if name not in _LAYOUTS:
            _LAYOUTS.clear()
        self.found = _LAYOUTS.setdefault(name, {})
        self.bytes = sum(n for _, n in self.found.values())

    def of(self, key, make: Callable):
        """The layout of a key; make gives it and its size in bytes."""
        hit = self.found.get(key)
        if hit is None:
            if self.bytes > LAYOUT_BYTES:
                self.found.clear()
                self.bytes = 0
            made, size = make()
            hit = self.found[key] = (made, size + 2000)
            self.bytes += hit[1]
        return hit[0]


class Batch:
    """Pages of one Arrow batch as flat columns of tokens."""

    def __init__(self, pages: pa.RecordBatch):
        self.doc_id = pages.column("doc_id")
        lists = pages.column("t")
        self.sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.tokens = lists.flatten()
        self.columns = dict(zip([f.name for f in self.tokens.type], self.tokens.flatten(), strict=True))

    def matrix(self, names: list[str]) -> np.ndarray:
        """A row for each token of fixed width, with nulls told apart; of strings only whether they are empty."""
        parts = []
        for n in names:
            c = self.columns[n]
            parts.append((f"{n}_ok", c.is_valid().to_numpy(zero_copy_only=False)))
            if pa.types.is_string(c.type):
                c = pa.compute.greater(pa.compute.binary_length(c), 0)
            parts.append((n, c.fill_null(False if pa.types.is_boolean(c.type) else 0).to_numpy(zero_copy_only=False)))
        out = np.zeros(len(self.tokens), np.dtype([(n, v.dtype) for n, v in parts]))
        for n, v in parts:
            out[n] = v
        return out


def in_batches(pages: DataFrame, ddl: str, work: Callable[[Batch, Layouts], pa.RecordBatch]) -> DataFrame:
    """Batches of pages (doc_id, t) through work, with the layouts that this plan has met."""
    schema = T.StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layouts = Layouts(name)
        for b in batches:
            for at in range(0, len(b), ROWS_AT_ONCE):
                out = work(Batch(b.slice(at, ROWS_AT_ONCE)), layouts)
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow)

    return pages.mapInArrow(run, schema)


def list_of(sizes: np.ndarray, values: pa.Array, null: np.ndarray | None = None) -> pa.Array:
    """A list array of the given sizes."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, values, mask=None if null is None else pa.array(null))


def line_ranks(centers: list[float | None]) -> list[int]:
    """Line of each centre in input order, by the lines' first centres; -1 without a centre."""
    sums, sizes, first, own = [], [], [], []
    for cy in centers:
        if cy is None:
            own.append(None)
            continue
        far, at = min(((abs(cy - s / n), i) for i, (s, n) in enumerate(zip(sums, sizes, strict=True))), default=(G.LINE_GROUPING, -1))
        if far < G.LINE_GROUPING:
            sums[at] += cy
            sizes[at] += 1
        else:
            sums.append(cy)
            sizes.append(1)
            first.append(cy)
            at = len(first) - 1
        own.append(at)
    rank = {k: i for i, k in enumerate(sorted(set(first)))}
    return [-1 if at is None else rank[first[at]] for at in own]


def line_rows(pages: DataFrame, ddl: str) -> DataFrame:
    """The tokens of pages (doc_id, t in input order) as rows with their line."""

    def ranks(rows: np.ndarray) -> tuple[np.ndarray, int]:
        ok = rows["y0_ok"] & rows["y1_ok"]
        return np.array(line_ranks([(a + b) / 2.0 if k else None for k, a, b in zip(ok.tolist(), rows["y0"].tolist(), rows["y1"].tolist(), strict=True)]), np.int32), 2 * rows.nbytes

    def work(b: Batch, layouts: Layouts) -> list[pa.Array]:
        m = b.matrix(["y0", "y1"])
        found = [layouts.of(m[i:j].tobytes(), lambda i=i, j=j: ranks(m[i:j])) for i, j in zip(b.starts, b.ends, strict=True)]
        line = np.concatenate([*found, np.zeros(0, np.int32)])
        doc = b.doc_id.take(pa.array(np.repeat(np.arange(len(found)), b.sizes)))
        return [doc, *[b.columns[c] for c in ("token_id", "ord", "x0", "y0", "x1", "y1")], pa.array(line, mask=line < 0)]

    return in_batches(pages, ddl, work)


EDGE = np.dtype([("from_id", "i4"), ("to_id", "i4"), ("relation", "U5")])


def edge_rows(pages: DataFrame, ways: tuple[str, ...]) -> DataFrame:
    """doc_id, from_id, to_id, relation of pages of lined tokens (doc_id, t in input order with line)."""
    names = ["token_id", "line", "x0", "y0", "x1", "y1"]

    def edges(rows: np.ndarray) -> tuple[np.ndarray, int]:
        grouped: dict[int, list[Token]] = {}
        for r in rows[names].tolist():
            grouped.setdefault(r[1], []).append(Token(r[0], 0, "", *r[2:]))
        own = list(grouped.items())
        found = (east(own) if "east" in ways else []) + (south(own) if "south" in ways else [])
        out = np.array(found, EDGE)
        return out, out.nbytes + rows.nbytes

    def work(b: Batch, layouts: Layouts) -> list[pa.Array]:
        m = b.matrix(names)
        found = [layouts.of(m[i:j].tobytes(), lambda i=i, j=j: edges(m[i:j])) for i, j in zip(b.starts, b.ends, strict=True)]
        sizes = np.array([len(x) for x in found], np.int64)
        e = np.concatenate([*found, np.zeros(0, EDGE)])
        doc = b.doc_id.take(pa.array(np.repeat(np.arange(len(found)), sizes)))
        return [doc, pa.array(e["from_id"]), pa.array(e["to_id"]), pa.array(e["relation"].tolist(), pa.string())]

    return in_batches(pages, "doc_id bigint, from_id int, to_id int, relation string", work)


def lines(tokens: list[Token]) -> list[tuple[float, list[Token]]]:
    """Lines by key, in the order they were opened."""
    found: dict[float, list[Token]] = {}
    sums: dict[float, float] = {}
    for t in tokens:
        far, key = G.LINE_GROUPING, t.cy
        for k, own in found.items():
            if (d := abs(t.cy - sums[k] / len(own))) < far:
                far, key = d, k
        found.setdefault(key, []).append(t)
        sums[key] = sums.get(key, 0.0) + t.cy
    return list(found.items())


def east(grouped: list[tuple[float, list[Token]]]) -> list[tuple[int, int, str]]:
    """Edges between neighbours of a line that are level and near."""
    out = []
    for _, own in grouped:
        row = sorted(own, key=lambda t: t.x0)
        for a, b in zip(row, row[1:], strict=False):
            if abs(a.cy - b.cy) < G.SAME_LINE and b.x0 - a.x1 < ((a.x1 - a.x0) + (b.x1 - b.x0)) / 2.0 * G.GAP_WIDTHS:
                out.append((a.token_id, b.token_id, "east"))
    return out


def spacing(grouped: list[tuple[float, list[Token]]]) -> float | None:
    """The gap above which lines are not linked; lines are in order of their keys."""
    gaps = []
    for (_, up), (_, down) in zip(grouped, grouped[1:], strict=False):
        positive = [g for a in up for b in down if (g := b.y0 - a.y1) > 0]
        gaps += [min(positive)] if positive else []
    if not gaps:
        return None
    gaps.sort()
    middle = gaps[len(gaps) // 2]
    return (gaps[len(gaps) // 4] if middle > G.HIGH_MEDIAN else middle) * G.SPACING_FACTOR


def south(grouped: list[tuple[float, list[Token]]]) -> list[tuple[int, int, str]]:
    """Each token's best neighbour in a lower line."""
    rows = sorted(grouped)
    limit = spacing(rows)
    top = [min(t.y0 for t in own) for _, own in rows]
    for i in range(len(top) - 2, -1, -1):
        top[i] = min(top[i], top[i + 1])
    out = []
    for i, (_, own) in enumerate(rows):
        for a in own:
            if (b := _below(a, i, rows, top, limit)) is not None:
                out.append((a.token_id, b.token_id, "south"))
    return out


def _below(a: Token, i: int, rows: list, top: list[float], limit: float | None) -> Token | None:
    best, best_rank = None, None
    for j in range(i + 1, len(rows)):
        if top[j] - a.y1 > G.MAX_VERTICAL or (j > i + 1 and top[j] >= a.y1):
            break  # lower lines neither overlap nor lie next
        beside_found = False
        for b in rows[j][1]:
            drop = b.y0 - a.y1
            if drop > G.MAX_VERTICAL:
                continue
            ox = max(0.0, min(a.x1, b.x1) - max(a.x0, b.x0))
            oy = max(0.0, min(a.y1, b.y1) - max(a.y0, b.y0))
            wide = (a.x1 - a.x0, b.x1 - b.x0)
            off = abs(a.cx - b.cx)
            aligned = off < max(wide) * 0.6
            if oy > 0:
                if not (ox > 0 or aligned):
                    continue
                beside_found = True
                gap = -oy * 0.001 if drop < 0 else drop
            elif j == i + 1 and b.y0 >= a.y0 - 0.02 and (ox >= min(wide) * G.MIN_OVERLAP_X or aligned):
                gap = max(0.0, drop)
            else:
                continue
            if gap > G.ABSOLUTE_GAP or (limit is not None and gap > limit):
                continue
            rank = (oy > 0, oy, ox, -off, -gap, i - j)
            if best_rank is None or rank > best_rank:
                best, best_rank = b, rank
        if beside_found:
            break
    return best


def oriented(edges: list[tuple[int, int, bool]]) -> list[tuple[int, int, int, int, str]]:
    """Two-by-two cells linked all around, one neighbour each way, with every orientation that the edges beyond them give."""
    east, south = {}, {}
    for a, b, is_east in edges:
        (east if is_east else south).setdefault(a, []).append(b)
    one = lambda n: n[0] if n and len(n) == 1 else None

    def linked(first: int, second: int, way: dict, side: dict) -> set[bool]:
        """Whether the next cells are two that are linked, for each choice of them."""
        return {None not in (a, b, c) and a != b and c == b for a in way.get(first, [None]) for b in way.get(second, [None]) for c in side.get(a, [None])}

    out = set()
    for tl in east:
        tr, bl = one(east[tl]), one(south.get(tl))
        br = one(east.get(bl))
        if None in (tr, bl, br) or one(south.get(tr)) != br:
            continue
        across, down = linked(tr, br, east, south), linked(bl, br, south, east)
        kinds = ["horizontal"] * (True in across) + (["vertical"] * (True in down) + ["unknown"] * (False in down)) * (False in across)
        out |= {(tl, tr, bl, br, k) for k in kinds}
    return sorted(out)


CORNER = np.dtype([("tl", "i4"), ("tr", "i4"), ("bl", "i4"), ("br", "i4"), ("orientation", "U10")])


def corner_rows(pages: DataFrame) -> DataFrame:
    """doc_id, tl, tr, bl, br, orientation of pages of edges (doc_id, t of from_id, to_id, east)."""
    names = ["from_id", "to_id", "east"]

    def corners(rows: np.ndarray) -> tuple[np.ndarray, int]:
        out = np.array(oriented(rows[names].tolist()), CORNER)
        return out, out.nbytes + rows.nbytes

    def work(b: Batch, layouts: Layouts) -> list[pa.Array]:
        m = b.matrix(names)
        found = [layouts.of(m[i:j].tobytes(), lambda i=i, j=j: corners(m[i:j])) for i, j in zip(b.starts, b.ends, strict=True)]
        c = np.concatenate([*found, np.zeros(0, CORNER)])
        doc = b.doc_id.take(pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found])))
        return [doc, *[pa.array(c[n]) for n in ("tl", "tr", "bl", "br")], pa.array(c["orientation"].tolist(), pa.string())]

    return in_batches(pages, "doc_id bigint, tl int, tr int, bl int, br int, orientation string", work)


def touch(a0: float, a1: float, b0: float, b1: float) -> bool:
    return a1 >= b0 and a0 <= b1


class Page:
    """Tokens, edges, roles and links of a page while rules change them."""

    def __init__(self, tokens: list[Token], edges: list[tuple[int, int, str]] | None = None):
        self.tokens = tokens
        self.by_id = {t.token_id: t for t in tokens}
        if edges is None:
            grouped = lines(tokens)
            edges = east(grouped) + south(grouped)
        self.edges = list(edges)
        self.roles = {t.token_id: t.role for t in tokens if t.role}
        self.sources = dict.fromkeys(self.roles, "given")
        self.labels: dict[int, None] = {}
        self.value_of: dict[int, int] = {}
        self.label_of: dict[int, int] = {}
        self.rebuild()

    def rebuild(self) -> None:
        """Neighbours by way, both ways of each edge, and edges out of each token."""
        self.sides: dict[int, dict[str, list[int]]] = {i: {w: [] for w in WAYS} for i in self.by_id}
        self.out: dict[int, list[tuple[int, str]]] = {i: [] for i in self.by_id}
        self.into: dict[int, list[tuple[int, str]]] = {i: [] for i in self.by_id}
        for a, b, way in self.edges:
            self.out[a].append((b, way))
            self.into[b].append((a, way))
            for x, y, w in ((a, b, way), (b, a, G.REVERSE[way])):
                if y not in self.sides[x][w]:
                    self.sides[x][w].append(y)

    def near(self, i: int, *ways: str) -> list[int]:
        return [n for w in ways for n in self.sides[i][w]]

    def around(self, i: int) -> list[int]:
        return list(dict.fromkeys(self.near(i, *WAYS)))

    def role(self, i: int) -> str | None:
        return self.roles.get(i)

    def settled(self, i: int) -> str | None:
        """A role given with the token, or written to it, before that of the rules."""
        return self.by_id[i].role or self.roles.get(i)

    def give(self, i: int, role: str | None, source: str) -> None:
        self.roles[i] = role
        self.sources[i] = source
        if role == "LABEL":
            self.labels.setdefault(i)

    def link(self, label: int, value: int) -> None:
        self.value_of[label] = value
        self.label_of[value] = label

    def drop_edges(self, gone: set[tuple[int, int, str]]) -> None:
        """Removes edges and their reverses."""
        both = gone | {(b, a, G.REVERSE[w]) for a, b, w in gone}
        self.edges = [e for e in self.edges if e not in both]
        self.rebuild()
