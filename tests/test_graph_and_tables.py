import random

import pytest

from pagelattice.operators import classify, graph, page, tables, tokenize
from pagelattice.operators.page import Page, Token
from pagelattice.sources import adapters

SF = "/root/testdata/sf0.001"
DDL = "doc_id bigint, token_id int, ord int, text string, x0 double, y0 double, x1 double, y1 double"


def token(i, text, x0, y0, x1=None, y1=None, **more):
    """A token with the flags of simple texts."""
    x1, y1 = x0 + 0.1 if x1 is None else x1, y0 + 0.02 if y1 is None else y1
    digits, date = any(c.isdigit() for c in text), text.count("/") == 2
    flags = {
        "date": date,
        "code": not date and text.startswith("$"),
        "number": text.isdigit(),
        "plain": any(c.isalpha() for c in text) and not date and not text.startswith("$"),
        "separator": text.endswith((":", ".", "/")),
        "colon_end": text.endswith(":"),
        "colon_inside": ":" in text[1:-1],
        "digits": digits,
        "n_words": len(text.split()),
    }
    return Token(i, i, text, x0, y0, x1, y1, **(flags | more))


def random_pages(rng, n, size):
    rows = []
    for doc in range(n):
        for i in range(size):
            y, x, w, h = rng.randint(50, 400) / 1000, rng.randint(0, 80) / 100, rng.randint(3, 20) / 100, rng.randint(10, 40) / 1000
            rows.append((doc, i, i, rng.choice(["a", "b:", "12", "Some Text"]), x, y, x + w, y + h))
    return rows


def spec_lines(tokens):
    """Line number of each token, by running means in input order."""
    found = []
    for t in tokens:
        cy = (t[5] + t[7]) / 2
        near = [(abs(cy - sum(x[1]) / len(x[1])), i) for i, x in enumerate(found)]
        near = [x for x in near if x[0] < 0.01]
        if near:
            x = found[min(near)[1]]
            x[1].append(cy)
            x[2].append(t[1])
        else:
            found.append((cy, [cy], [t[1]]))
    return {i: k for k, line in enumerate(sorted(found)) for i in line[2]}


def test_lines_follow_the_running_mean(spark):
    rng = random.Random(5)
    rows = []
    for doc in range(30):
        for i in range(25):
            y, x = rng.randint(100, 190) / 1000, rng.random() * 0.8
            rows.append((doc, i, i, "t", x, y, x + 0.05, y + 0.02))
    got = {(r["doc_id"], r["token_id"]): r["line"] for r in graph.lines(spark.createDataFrame(rows, DDL)).collect()}
    for doc in range(30):
        for i, line in spec_lines([r for r in rows if r[0] == doc]).items():
            assert got[doc, i] == line


def test_joins_and_the_pass_over_pages_give_the_same_edges(spark):
    df = spark.createDataFrame(random_pages(random.Random(7), 60, 18), DDL).repartition(3)
    joined = graph.edges(graph.lines(df)).select("doc_id", "from_id", "to_id", "relation")
    passed = classify.part(classify.ruled(df, []), "edges").select("doc_id", "from_id", "to_id", "relation")
    assert joined.exceptAll(passed).count() == passed.exceptAll(joined).count() == 0
    assert passed.filter("relation = 'south'").count() > 100


def test_form_becomes_one_vertical_table(spark):
    p = classify.pages(adapters.kv_form(spark, SF).filter("doc_id < 4"))
    assert {r["orientation"] for r in classify.part(p, "cells").collect()} == {"vertical"}
    assert {(r["token_id"] % 2, r["role"]) for r in classify.part(p, "facts").collect()} == {(0, "LABEL"), (1, "VALUE")}


def square(n_rows, n_cols, texts=None):
    texts = texts or [f"t{k}" for k in range(n_rows * n_cols)]
    return [token(k, t, 0.1 + 0.2 * (k % n_cols), 0.1 + 0.04 * (k // n_cols)) for k, t in enumerate(texts)]


@pytest.mark.parametrize("shape,kinds,cells", [((2, 2), ["unknown"], 4), ((2, 3), ["horizontal"], 6), ((4, 2), ["vertical"], 8), ((4, 3), ["horizontal"] * 2, 12), ((1, 3), [], 0)])
def test_shapes_of_tables(shape, kinds, cells):
    found = tables.page_tables(Page(square(*shape)))
    assert [t.orientation for t in found] == kinds and sum(len(t.ids) for t in found) == cells


def test_two_columns_of_labels_have_their_values_below():
    p = Page(square(4, 2, ["Produto", "Sistema", "$ 1", "x y", "Grupo:", "Area:", "a", "b"]))
    found = tables.page_tables(p)
    assert tables.two_label_columns(p, found[0])
    roles = tables.give_roles(p, found)
    assert [roles[k] for k in range(8)] == ["LABEL", "LABEL", "VALUE", "VALUE"] * 2 and p.value_of[0] == 2
    both = Page(square(3, 2, ["a:", "b:", "c", "d", "12", "13"]))
    assert tables.two_label_columns(both, tables.page_tables(both)[0])
    plain = Page(square(3, 2, ["a:", "12", "b:", "13", "c:", "x"]))
    assert not tables.two_label_columns(plain, tables.page_tables(plain)[0])


def test_label_without_value_gets_its_rows():
    p = Page([t for t in square(3, 2, ["a:", "1", "b:", "2", "c:", "3"])])
    found = tables.page_tables(p)
    for i, role in tables.give_roles(p, found).items():
        p.by_id[i].role = role
    p.drop_edges({(2, 3, "east")})
    tables.repaired(p, found)
    assert (2, 3, "east") in p.edges and len(p.edges) == len(set(p.edges))


def test_paths_and_what_is_below():
    p = Page(square(3, 2))
    assert classify.path(p, 0) == [0, 1, 3, 5, 2, 4]
    assert sorted(classify.below(p, 0)) == [1, 2, 3, 3, 4, 5, 5]


def test_prefixes_of_a_path(spark):
    row = spark.createDataFrame([(["a", "", "b", "b"],), (["", ""],)], "p array<string>").select(graph.prefixes(page.F.col("p")).alias("s")).collect()
    assert [r["s"] for r in row] == [["a b b", "a b", "a"], []]


def test_splits(spark):
    box = "doc_id bigint, text string, x0 double, y0 double, x1 double, y1 double"
    one = tokenize.colon_split(spark.createDataFrame([(1, "Nome: Ana", 0.0, 0.0, 0.9, 0.1), (2, "a:b", 0.0, 0.0, 1.0, 0.1)], box)).orderBy("doc_id", "part").collect()
    assert [(r["text"], r["role"]) for r in one] == [("Nome:", "LABEL"), ("Ana", "VALUE"), ("a:b", None)]
    texts = lambda s: [p[0] for p in tokenize.pieces(s)]
    assert texts("Cidade: Mozarlândia U.F.: GO CEP: 76709970") == ["Cidade:", "Mozarlândia", "U.F.:", "GO", "CEP:", "76709970"]
    assert texts("Data Base: x Data Venc: y") == ["Data Base:", "x Data", "Venc:", "y"]
    assert texts("Cidade: X U.F .: GO") == ["Cidade:", "X", "U.F .:", "GO"]
    assert texts("Tel:\n12 34") == ["Tel:", "12 34"] and texts("a\nb") == ["a\nb"] and texts(":") == [":"] and texts("ab:") == ["ab:"]
    many = tokenize.pieces("Cidade: Mozarlândia U.F.: GO CEP: 76709970")
    assert many[0][1] == 0 and many[-1][2] == 1 and all(a[2] == pytest.approx(b[1]) for a, b in zip(many, many[1:]))
    t = spark.createDataFrame([(1, 0, 0, "A: b C: d", 0.0, 0.0, 0.9, 0.1, "x"), (1, 1, 1, None, 0.0, 0.2, 0.9, 0.3, "y"), (1, 2, 2, "plain", 0.0, 0.4, 0.9, 0.5, "z")], DDL + ", extra string")
    got = tokenize.numbered(tokenize.split_tokens(t)).orderBy("token_id").collect()
    assert [(r["token_id"], r["text"], r["extra"]) for r in got] == [(0, "A:", "x"), (1, "b", "x"), (2, "C:", "x"), (3, "d", "x"), (4, None, "y"), (5, "plain", "z")]
    assert got[3]["x1"] == 0.9 and got[3]["role"] == "VALUE"


def test_merges_join_what_goes_on():
    a, b = token(0, "Telefone da", 0.1, 0.1, 0.3, 0.12), token(1, "Cobradora", 0.1, 0.112, 0.28, 0.132)
    far = token(2, "x", 0.6, 0.1)
    got = tokenize.merged_page([a, b, far])
    assert [(t.token_id, t.text, t.y1) for t in got] == [(0, "Telefone da Cobradora", 0.132), (2, "x", far.y1)]
    assert len(tokenize.merged_page([token(0, "TITLE", 0.1, 0.1, 0.3, 0.12), b])) == 2
    between = token(3, "y", 0.1, 0.118, 0.3, 0.128)
    assert tokenize.merged_page([a, b, between])[0].text == "Telefone da"
    covered = tokenize.merged_page([token(0, "Tel:", 0.1, 0.1, 0.2, 0.12), token(5, "99", 0.1, 0.1, 0.19, 0.12), far])
    assert [(t.token_id, t.text, t.role) for t in covered] == [(0, "Tel:", "LABEL"), (6, "99", "VALUE"), (2, "x", None)]
