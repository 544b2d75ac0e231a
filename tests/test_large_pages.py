"""Plans that hold at size: no broadcast by the size of files, and layouts shared by pages."""

import random

from pyspark.sql import functions as F

from pagelattice.operators import classify, graph, page
from pagelattice.sources import adapters

SF = "/root/testdata/sf0.001"
DDL = "doc_id bigint, token_id int, ord int, text string, x0 double, y0 double, x1 double, y1 double"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_south_edges_join_nothing(spark):
    plan = plan_of(graph.south_edges(graph.lines(adapters.kv_form(spark, SF).localCheckpoint())))
    assert "Join" not in plan and "Broadcast" not in plan


def test_written_edges_are_not_broadcast(spark):
    t = adapters.kv_form(spark, SF)
    e = graph.edges(graph.lines(t)).select("doc_id", "from_id", "to_id", "relation")
    for df in (graph.removed(e, e.filter("from_id % 4 = 0")), graph.degree(t.localCheckpoint(), e), graph.corners(e)):
        assert "Broadcast" not in plan_of(df) and "SortMergeJoin" in plan_of(df)


def test_corners_of_a_page_equal_the_joins(spark):
    rng = random.Random(3)
    rows = {(d, rng.randint(0, 8), rng.randint(0, 8), rng.choice(("east", "south"))) for d in range(200) for _ in range(24)}
    rows |= {(d, i, i + 1, "east") for d in range(200, 300) for i in range(8) if i % 3 < 2 and rng.random() < 0.95}
    rows |= {(d, i, i + 3, "south") for d in range(200, 300) for i in range(6) if rng.random() < 0.95}
    e = spark.createDataFrame(sorted(rows), "doc_id bigint, from_id int, to_id int, relation string")
    c = graph.corners(e)
    step = lambda rel, a, b: e.filter(F.col("relation") == rel).select("doc_id", F.col("from_id").alias(a), F.col("to_id").alias(b))
    j = c.join(step("east", "tr", "tr2"), ["doc_id", "tr"], "left").join(step("east", "br", "br2"), ["doc_id", "br"], "left").join(step("south", "tr2", "tr2s"), ["doc_id", "tr2"], "left")
    j = j.join(step("south", "bl", "bl2"), ["doc_id", "bl"], "left").join(step("south", "br", "br3"), ["doc_id", "br"], "left").join(step("east", "bl2", "bl2e"), ["doc_id", "bl2"], "left")
    across, down = F.expr("coalesce(tr2 <> br2 and tr2s = br2, false)"), F.expr("coalesce(bl2 <> br3 and bl2e = br3, false)")
    want = j.select("doc_id", "tl", "tr", "bl", "br", F.when(across, "horizontal").when(down, "vertical").otherwise("unknown").alias("orientation")).distinct()
    got = [tuple(r) for r in graph.oriented_corners(e).select(*want.columns).collect()]
    assert sorted(got) == sorted(tuple(r) for r in want.collect()) and len({r[5] for r in got}) == 3


def test_pages_of_one_layout_share_the_fold(monkeypatch):
    made = []
    layouts = page.Layouts("one")
    for key in (b"a", b"b", b"a"):
        assert layouts.of(key, lambda key=key: (made.append(key) or key, 1)) == key
    assert made == [b"a", b"b"]
    monkeypatch.setattr(page, "LAYOUT_BYTES", 0)
    assert layouts.of(b"c", lambda: (b"c", 1)) == b"c" and len(layouts.found) == 1


def test_pages_of_one_layout_go_through_the_pass_once(spark):
    """Texts that differ alone do not make a page be computed again; words of two label columns do."""
    seen = []
    rows = [(d, 2 * r + c, 2 * r + c, f"{t} {d}" if r else t, 0.1 + 0.3 * c, 0.1 + 0.04 * r, 0.25 + 0.3 * c, 0.12 + 0.04 * r) for d in range(60) for r in range(3) for c, t in enumerate(("Produto", "Sistema") if d % 2 else ("abc", "def"))]
    b = page.Batch(page.page_rows(spark.createDataFrame(rows, DDL)).toArrow().combine_chunks().to_batches()[0])
    m = b.matrix(classify._READ)
    keys = {m[i:j].tobytes() for i, j in zip(b.starts, b.ends, strict=True)}
    layouts = page.Layouts("tables")
    for key in [m[i:j].tobytes() for i, j in zip(b.starts, b.ends, strict=True)]:
        layouts.of(key, lambda: (seen.append(1), 1))
    assert len(seen) == len(keys) < 5
    got = {(r["doc_id"] % 2, r["token_id"], r["role"]) for r in classify.part(classify.pages(spark.createDataFrame(rows, DDL), rules=[]), "facts").collect()}
    assert len(got) == 12 and {(1, 0, "LABEL"), (1, 1, "LABEL"), (0, 0, "LABEL"), (0, 1, "VALUE")} <= got


def test_rules_of_others_see_whole_pages(spark):
    """A rule that is not one of the known ones may read the texts, so its pages are not shared."""
    from pagelattice.operators import role_rules

    def by_text(p):
        for t in p.tokens:
            p.give(t.token_id, t.text, "own")

    rows = [(d, 0, 0, f"t{d}", 0.1, 0.1, 0.2, 0.12) for d in range(9)]
    got = classify.part(classify.pages(spark.createDataFrame(rows, DDL), [role_rules.Rule("by_text", 1, (), by_text)]), "facts").collect()
    assert {r["role"] for r in got} == {f"t{d}" for d in range(9)}


def test_an_expanded_query_finds_its_words_once(spark):
    from pagelattice.functions import expansion

    df = spark.createDataFrame([("data_x", "Data de vencimento do valor")], "name string, description string")
    plan = df.select(expansion.expanded_query(F.col("name"), F.col("description")).alias("q"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all(") == 1
