"""Implicit tables of a page: two rows or two columns of linked cells, and tables by aligned boxes.

Scanning a page for tables depends on what earlier tables took, so it is part
of the pass over the page. Cells are rows, so access to a cell, a row or a
column is a filter.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelattice.operators.page import Page, Token

# Words of labels in tables that have two columns of labels.
LABEL_WORDS = "produto sistema tipo categoria classe grupo refinanciamento consignado operacao operação"
CURRENCY = "$€£"
TOLERANCE = 0.02
FONT_TOLERANCE = 2.0
CELL_DDL = "table_id int, token_id int, row int, col int, orientation string"


@dataclass
class Table:
    """Token ids by row and column."""

    rows: list[list[int]]
    orientation: str = "unknown"
    ids: set[int] = field(default_factory=set)

    def cells(self, number: int) -> list[dict]:
        return [
            {"table_id": number, "token_id": i, "row": r, "col": c, "orientation": self.orientation} for r, line in enumerate(self.rows) for c, i in enumerate(line)
        ]


def corner(p: Page, tl: int) -> Table | None:
    """The two-by-two cells below and right of a token, each linked to exactly one neighbour."""
    one = lambda i, way: n[0] if i is not None and len(n := p.near(i, way)) == 1 else None
    tr, bl = one(tl, "east"), one(tl, "south")
    br = one(bl, "east")
    if None in (tr, bl, br) or one(tr, "south") != br:
        return None
    return Table([[tl, tr], [bl, br]], ids={tl, tr, bl, br})


def grown(p: Page, t: Table, way: str, side: str) -> bool:
    """Adds columns (east) or rows (south) of two linked cells while there are any."""
    more = False
    while True:
        last = (t.rows[0][-1], t.rows[1][-1]) if way == "east" else (t.rows[-1][0], t.rows[-1][1])
        nxt = [p.near(i, way) for i in last]
        if any(len(n) != 1 for n in nxt):
            return more
        a, b = nxt[0][0], nxt[1][0]
        if a == b or b not in p.near(a, side) or {a, b} & t.ids:
            return more
        more = True
        t.ids |= {a, b}
        if way == "east":
            t.rows[0].append(a)
            t.rows[1].append(b)
        else:
            t.rows.append([a, b])


def page_tables(p: Page) -> list[Table]:
    """Tables from the top down; a token of a table begins no other."""
    taken: set[int] = set()
    out = []
    for t in sorted(p.tokens, key=lambda t: t.y0):
        found = corner(p, t.token_id) if t.token_id not in taken else None
        if found is None:
            continue
        if grown(p, found, "east", "south"):
            found.orientation = "horizontal"
        elif grown(p, found, "south", "east"):
            found.orientation = "vertical"
        taken |= found.ids
        out.append(found)
    return out


def keyed(text: str) -> bool:
    return any(w in text.lower() for w in LABEL_WORDS.split())


def telling(text: str) -> bool:
    return not text[:1].isdigit() and not any(c in text for c in CURRENCY) and len(text) > 3


def two_label_columns(p: Page, t: Table) -> bool:
    """Whether the two columns of a vertical table both hold labels, with their values below them."""
    if t.orientation != "vertical":
        return False
    wordy = lambda x: not x.typed and not x.colon_end and x.n_words <= 4
    for r, line in enumerate(t.rows):
        a, b = (p.by_id[i] for i in line[:2])
        if r == len(t.rows) - 1 and a.typed and b.typed:
            return True
        if (a.date and b.date) or (a.code and b.code) or (a.number and b.number):
            return True
        if wordy(a) and wordy(b) and ((keyed(a.text) and keyed(b.text)) or (telling(a.text) and telling(b.text) and (keyed(a.text) or keyed(b.text)))):
            return True
    return False


def give_roles(p: Page, tables: list[Table]) -> dict[int, str]:
    """Labels and values of oriented tables, linked; the roles that they settle."""
    settled = {}
    for t in tables:
        if t.orientation == "unknown":
            continue
        double = two_label_columns(p, t)
        for r, line in enumerate(t.rows):
            for c, i in enumerate(line):
                place = r % 2 if double or t.orientation == "horizontal" else c
                if place == 0:
                    p.give(i, "LABEL", "table")
                else:
                    p.give(i, "VALUE", "table")
                    p.link(t.rows[r][0] if t.orientation == "vertical" and not double else t.rows[r - 1][c], i)
                settled[i] = p.role(i)
    return settled


def repaired(p: Page, tables: list[Table]) -> None:
    """In vertical tables of labels and values, a label without a value is linked to its row's."""
    for t in tables:
        if t.orientation != "vertical" or not all(p.settled(a) == "LABEL" and p.settled(b) == "VALUE" for a, b in t.rows):
            continue
        for a, b in t.rows:
            if not any(p.settled(n) == "VALUE" for n, _ in p.out[a]):
                p.edges.append((a, b, "east"))
                p.rebuild()


def row_of(cells: DataFrame, row: int) -> DataFrame:
    return cells.filter(F.col("row") == row)


def column_of(cells: DataFrame, col: int) -> DataFrame:
    return cells.filter(F.col("col") == col)


def cell_at(cells: DataFrame, row: int, col: int) -> DataFrame:
    return cells.filter((F.col("row") == row) & (F.col("col") == col))


def aligned_pairs(tokens: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, band, row, left_id, right_id: tokens of neighbouring columns that lie on one level.

    Columns are left edges rounded to the tolerance. A token takes the free one
    of the next column that is nearest to its level; as both columns go from the
    top, that is the first pairing of ranks by distance.
    """
    step = F.bround(F.col("x0") / tolerance)
    page = Window.partitionBy("doc_id")
    t = tokens.select("doc_id", "token_id", "ord", "y0", ((F.col("y0") + F.col("y1")) / 2.0).alias("cy"), step.alias("k"))
    t = t.withColumn("band", F.dense_rank().over(page.orderBy("k")))
    a = t.select("doc_id", "band", F.col("token_id").alias("left_id"), F.col("cy").alias("a_cy"), F.col("y0").alias("a_y"), F.col("ord").alias("a_ord"))
    b = t.select("doc_id", (F.col("band") - 1).alias("band"), F.col("token_id").alias("right_id"), F.col("cy").alias("b_cy"), F.col("y0").alias("b_y"), F.col("ord").alias("b_ord"))
    far = F.abs(F.col("a_cy") - F.col("b_cy"))
    pairs = a.join(b, ["doc_id", "band"]).withColumn("far", far).filter(F.col("far") < 2 * tolerance)
    of_left = Window.partitionBy("doc_id", "band", "left_id").orderBy("far", "b_y", "b_ord")
    of_right = Window.partitionBy("doc_id", "band", "right_id").orderBy("far", "a_y", "a_ord")
    best = pairs.withColumns({"l": F.row_number().over(of_left), "r": F.row_number().over(of_right)}).filter("l = 1 and r = 1")
    row = F.row_number().over(Window.partitionBy("doc_id", "band").orderBy("a_y", "a_ord")) - 1
    return best.select("doc_id", "band", row.alias("row"), "left_id", "right_id")


def aligned_tables(tokens: DataFrame, tolerance: float = TOLERANCE, least: int = 2) -> DataFrame:
    """doc_id, band, row, col, token_id of two-column tables of aligned tokens of steady left edges and fonts."""
    pairs = aligned_pairs(tokens, tolerance)
    cells = pairs.select("doc_id", "band", "row", F.posexplode(F.array("left_id", "right_id")).alias("col", "token_id"))
    font = F.col("font_size") if "font_size" in tokens.columns else F.lit(None).cast("double")
    cells = cells.join(tokens.select("doc_id", "token_id", "x0", font.alias("font")), ["doc_id", "token_id"])
    column = Window.partitionBy("doc_id", "band", "col")
    spread = cells.withColumns({"sx": F.stddev_pop("x0").over(column), "sf": F.coalesce(F.stddev_pop("font").over(column), F.lit(0.0))})
    ok = F.max(F.greatest(F.col("sx") / tolerance, F.col("sf") / FONT_TOLERANCE)).over(Window.partitionBy("doc_id", "band")) <= 1
    n = F.max("row").over(Window.partitionBy("doc_id", "band")) + 1
    return spread.withColumns({"_ok": ok, "_n": n}).filter(F.col("_ok") & (F.col("_n") >= least)).select("doc_id", "band", "row", "col", "token_id")
