"""Each role rule and each stage of the cascade on pages made for it."""

import pytest
from pyspark.sql import functions as F

from pagelattice.functions import hints as H
from pagelattice.functions.vectors import trigram_vectors
from pagelattice.operators import classify, extraction, graph, learning, matching, role_rules, roles
from pagelattice.operators.page import Page
from pagelattice.sources import adapters
from tests.test_graph_and_tables import DDL, token

SF = "/root/testdata/sf0.001"


def after(tokens, *names, edges=None):
    """Roles of a page after the named rules."""
    p = Page(tokens, edges)
    for r in role_rules.ordered([r for r in role_rules.RULES if r.name in names]):
        r.apply(p)
    return p


def roles_of(p):
    return {i: r for i, r in p.roles.items() if r}


def test_rules_run_by_rank_after_what_they_need():
    names = [r.name for r in role_rules.ORDER]
    assert len(names) == 20 and names[0] == "initial_label" and names[-1] == "header_no_north_west"
    late = role_rules.Rule("late", 1, ("b",), lambda p: None)
    assert [r.name for r in role_rules.ordered([late, role_rules.Rule("b", 9, (), lambda p: None)])] == ["b", "late"]


def test_labels_claim_values_once():
    t = [token(0, "A:", 0.1, 0.1), token(1, "B:", 0.1, 0.13), token(2, "12", 0.25, 0.13)]
    p = after(t, "initial_label", "initial_value", edges=[(1, 2, "east"), (0, 2, "south"), (0, 1, "south")])
    assert p.value_of == {0: 2} and roles_of(p) == {0: "LABEL", 1: "LABEL", 2: "VALUE"}


def test_first_headers():
    t = [token(0, "Title", 0.1, 0.02, font_size=16.0), token(1, "Small", 0.1, 0.3, font_size=10.0), token(2, "a b c", 0.5, 0.3, font_size=10.0), token(3, "White", 0.1, 0.6, font_size=10.0, white=True), token(4, "Low", 0.5, 0.95, font_size=10.0)]
    p = after(t, "initial_header", edges=[(1, 2, "east"), (2, 4, "south"), (3, 2, "east")])
    assert roles_of(p) == {0: "HEADER", 1: "HEADER", 2: "VALUE", 3: "HEADER", 4: "HEADER"}
    only_labels = after([token(0, "A:", 0.1, 0.1), token(1, "x", 0.1, 0.13)], "initial_label", "initial_header", edges=[(0, 1, "south")])
    assert only_labels.roles[1] == "HEADER"


def test_split_pairs_keep_their_own_edge():
    t = [token(0, "A:", 0.1, 0.1, role="LABEL", separated_pair=True), token(1, "b", 0.25, 0.1, role="VALUE", separated_pair=True), token(2, "c", 0.1, 0.13), token(3, "d", 0.25, 0.13)]
    p = after(t, "separated_pair_isolation", edges=[(0, 1, "east"), (0, 2, "south"), (1, 3, "south"), (2, 3, "east")])
    assert p.edges == [(0, 1, "east"), (2, 3, "east")]


def test_labels_among_labels_are_headers():
    t = [token(k, f"L{k}", 0.1, 0.1 + 0.03 * k, role="LABEL") for k in range(3)]
    assert roles_of(after(t, "label_only_connections", edges=[(0, 1, "south"), (1, 2, "south")])) == {0: "HEADER", 1: "HEADER", 2: "LABEL"}


def test_value_takes_the_nearest_text_above_else_left():
    t = [token(0, "Far", 0.1, 0.1), token(1, "Near", 0.1, 0.2), token(2, "$ 1", 0.1, 0.3, role="VALUE"), token(3, "Left", 0.3, 0.5), token(4, "01/02/2020", 0.5, 0.5)]
    p = after(t, "value_label_uniqueness", edges=[])
    assert p.label_of == {2: 1, 4: 3} and roles_of(p) == {1: "LABEL", 2: "VALUE", 3: "LABEL", 4: "VALUE"}


def test_roles_go_on_along_a_row_of_one_style():
    t = [token(0, "A", 0.1, 0.1, role="LABEL", bold=True), token(1, "B", 0.25, 0.1, bold=True), token(2, "12", 0.4, 0.1, bold=True), token(3, "C", 0.55, 0.1, bold=False)]
    p = after(t, "typographic_hierarchy", edges=[(0, 1, "east"), (1, 2, "east"), (2, 3, "east")])
    assert roles_of(p) == {0: "LABEL", 1: "LABEL", 2: "VALUE"}


def test_codes_have_their_label_above_first():
    t = [token(0, "Up", 0.1, 0.1), token(1, "Left", 0.0, 0.13), token(2, "$ 5", 0.1, 0.13)]
    p = after(t, "numeric_code_label", edges=[(1, 2, "east"), (0, 2, "south")])
    assert roles_of(p) == {0: "LABEL", 2: "VALUE"} and p.value_of == {0: 2}


def test_short_text_alone_is_no_value():
    t = [token(0, "Alone", 0.1, 0.3, role="VALUE"), token(1, "x", 0.5, 0.3, role="LABEL")]
    p = Page(t, [])
    p.link(1, 0)
    role_rules.isolated_short_text_header(p)
    assert p.roles[0] == "HEADER" and p.value_of == p.label_of == {}


def test_first_text_above_in_input_order_is_the_label():
    t = [token(0, "Top", 0.1, 0.1), token(1, "Near", 0.1, 0.2), token(2, "$ 1", 0.1, 0.3, role="VALUE")]
    assert after(t, "value_label_guarantee", edges=[]).label_of == {2: 0}


def test_colons_lead_down_then_right():
    t = [token(0, "A:", 0.1, 0.1), token(1, "B:", 0.1, 0.13), token(2, "v", 0.25, 0.13), token(3, "w", 0.25, 0.1)]
    p = after(t, "colon_recursive", edges=[(0, 3, "east"), (1, 2, "east"), (0, 1, "south")])
    assert p.value_of == {0: 2, 1: 2} and roles_of(p) == {0: "LABEL", 1: "LABEL", 2: "VALUE"}
    loop = after([token(0, "A:", 0.1, 0.1), token(1, "B:", 0.1, 0.13)], "colon_recursive", edges=[(0, 1, "south"), (1, 0, "south")])
    assert roles_of(loop) == {}


def test_headers_under_something_are_none():
    t = [token(0, "x", 0.1, 0.1), token(1, "A:", 0.1, 0.13, role="HEADER"), token(2, "y", 0.3, 0.1), token(3, "12", 0.3, 0.13, role="HEADER"), token(4, "z", 0.5, 0.1), token(5, "Over", 0.5, 0.13, role="HEADER"), token(6, "L", 0.65, 0.13, role="LABEL")]
    p = after(t, "header_no_north", edges=[(0, 1, "south"), (2, 3, "south"), (4, 5, "south"), (5, 6, "east")])
    assert [p.roles[k] for k in (1, 3, 5)] == ["LABEL", "VALUE", "VALUE"]


def test_values_turn_what_follows_into_values():
    t = [token(0, "v", 0.1, 0.1, role="VALUE"), token(1, "a", 0.25, 0.1, role="LABEL"), token(2, "b", 0.4, 0.1, role="LABEL"), token(3, "C:", 0.1, 0.13, role="LABEL")]
    p = after(t, "value_no_label_connections", edges=[(0, 1, "east"), (1, 2, "east"), (0, 3, "south")])
    assert [p.roles[k] for k in range(4)] == ["VALUE", "VALUE", "VALUE", "LABEL"]


def test_every_value_finds_a_label():
    t = [token(0, "Low", 0.1, 0.8, role="LABEL"), token(1, "$ 1", 0.5, 0.3, role="VALUE")]
    assert after(t, "value_must_have_label", edges=[]).label_of == {1: 0}
    free = [token(0, "Free", 0.1, 0.8), token(1, "$ 1", 0.5, 0.3, role="VALUE")]
    p = after(free, "value_must_have_label", edges=[])
    assert p.label_of == {1: 0} and p.roles[0] == "LABEL"


def test_a_label_keeps_one_value():
    t = [token(0, "L", 0.1, 0.1, role="LABEL"), token(1, "v", 0.25, 0.1, role="VALUE"), token(2, "w", 0.1, 0.13, role="VALUE")]
    assert after(t, "label_single_value", edges=[(0, 1, "east"), (0, 2, "south")]).edges == [(0, 1, "east")]


def test_headers_side_by_side_are_label_and_value():
    t = [token(0, "Sistema", 0.1, 0.1, role="HEADER"), token(1, "Consignado", 0.1, 0.13, role="HEADER"), token(2, "Far", 0.1, 0.5, role="HEADER")]
    p = after(t, "adjacent_headers", edges=[])
    assert roles_of(p) == {0: "LABEL", 1: "VALUE", 2: "HEADER"} and (0, 1, "south") in p.edges and t[0].role == "LABEL"


def test_nothing_but_headers_leads_to_headers():
    t = [token(0, "v", 0.1, 0.1, role="VALUE"), token(1, "H", 0.25, 0.1, role="HEADER"), token(2, "H2", 0.4, 0.1, role="HEADER")]
    p = after(t, "header_no_north_west", edges=[(0, 1, "east"), (1, 2, "east")])
    assert p.edges == [(1, 2, "east")] and p.roles[1] == "HEADER" and p.roles[2] == "LABEL"


def test_given_roles_and_tables_stand_above_rules():
    t = [token(0, "Title:", 0.1, 0.02, role="HEADER"), *[token(1 + k, x, 0.1 + 0.2 * (k % 2), 0.1 + 0.04 * (k // 2)) for k, x in enumerate(["a", "b", "c", "d", "e", "f"])]]
    p, found = classify.classified(t)
    assert p.roles[0] == "HEADER" and [t.orientation for t in found] == ["vertical"]
    assert [p.roles[k] for k in range(1, 7)] == ["LABEL", "VALUE"] * 3


@pytest.mark.parametrize("rule,native", [("label_without_edges", roles.label_without_edges), ("isolated_short_text_header", roles.isolated_short_text), ("header_preservation", None), ("initial_label", None)])
def test_rules_as_projections_agree_with_the_pass(spark, rule, native):
    k = (F.col("token_id") * 5 + F.col("doc_id")) % 4
    t = adapters.order_form(spark, SF).filter("doc_id < 60").withColumn("role", F.when(k == 0, "LABEL").when(k == 1, "VALUE").when(k == 2, "HEADER"))
    passed = classify.part(classify.ruled(t, [rule]), "facts").select("doc_id", "token_id", "role")
    e = graph.edges(graph.lines(t))
    joined = native(t, e) if native else getattr(roles, rule)(t)
    assert joined.exceptAll(passed).count() == 0


PAGE = [
    (1, 0, "Vencimento:", 0.1, 0.10, 0.25), (1, 1, "05/09/2025", 0.30, 0.10, 0.45),
    (1, 2, "Cliente", 0.1, 0.13, 0.25), (1, 3, "Maria Souza", 0.30, 0.13, 0.45),
    (1, 4, "Valores:", 0.1, 0.16, 0.25), (1, 5, "R$ 10,00 - R$ 20,00", 0.30, 0.16, 0.55),
    (2, 0, "nothing here", 0.1, 0.10, 0.30),
]


def page(spark, rows=PAGE):
    return spark.createDataFrame([(d, i, i, t, x0, y, x1, y + 0.02) for d, i, t, x0, y, x1 in rows], DDL)


def found(df):
    return {(r["doc_id"], r["field"]): (r["value"], r["strategy"]) for r in df.collect()}


def test_stages_of_the_cascade(spark):
    fields = [("vencimento", "data de vencimento"), ("nome", "nome completo"), ("primeiro_valor", "valores"), ("segundo_valor", "valores"), ("terceiro", "nada")]
    got = found(extraction.extract(page(spark), fields))
    assert got[1, "vencimento"] == ("05/09/2025", "regex_perfect_value")
    assert got[1, "nome"] == ("Maria Souza", "name_heuristic")
    both = "R$ 10,00 - R$ 20,00"
    assert got[1, "primeiro_valor"] == (both, "regex_perfect_value") and got[1, "segundo_valor"] == (both, "regex_perfect_value")
    assert got[1, "terceiro"] == ("Maria Souza", "pattern_partial")  # any text will do for a field without a type
    assert {v for (d, _), v in got.items() if d == 2 and v[1] != "name_heuristic"} == {(None, "none")}


def test_results_have_a_row_for_every_page(spark):
    out = {r["doc_id"]: r for r in extraction.results(extraction.extract(page(spark), [("vencimento", "x"), ("nada", "telefone")])).collect()}
    assert out[1]["fields"] == {"vencimento": "05/09/2025", "nada": None} and out[1]["success_rate"] == 0.5 and out[1]["nodes_used"] == [0]
    assert out[2]["extracted_fields"] == 0 and out[2]["strategies"] == {"vencimento": "none", "nada": "none"}


def candidate(i, **more):
    base = {"ord": 0, "token_ord": i, "token_id": i, "role": "VALUE", "x": 0.0, "y": 0.0, "degree": 2, "near": True, "perfect": False, "partial": None, "own": "v", "own_good": True, "own_fits": True,
            "settled": None, "settled_by": None, "pattern": None, "pattern_text": None, "pattern_good": True, "pattern_fits": True, "name_points": None, "name_text": None, "score": 0.5, "vector": None,
            "vector_text": None, "vector_good": True, "vector_fits": True, "label": None, "below": None, "text": f"t{i}"}
    return base | more


FIELD = {"ord": 0, "field": "f", "kind": None, "typed": False, "is_name": False}


def choice(*rows, field=None, service=None):
    c = extraction.Cascade(list(rows), [FIELD | (field or {})], service).run()[0]
    return c.value, c.strategy


def test_exact_words_settle_a_field_even_without_a_value():
    assert choice(candidate(0, perfect=True, own="", settled=None, settled_by="regex_perfect_label_no_value"), candidate(1, partial=0.5)) == (None, "regex_perfect_label_no_value")
    a = candidate(0, perfect=True, settled="a", settled_by="regex_perfect_value", score=0.4)
    assert choice(a, candidate(1, perfect=True, settled="b", settled_by="regex_perfect_value", score=0.6)) == ("b", "regex_perfect_value_tiebreak")
    assert choice(a | {"vector": 0.9}, candidate(1, perfect=True, settled="b", settled_by="regex_perfect_value", score=0.6, vector=0.8)) == ("a", "regex_perfect_value_tiebreak")


def test_later_stages_pass_their_gates():
    assert choice(candidate(0, partial=0.5, own="a", own_fits=False), candidate(1, pattern=0.9, pattern_text="p", near=False), field={"typed": True}) == ("p", "pattern_perfect")
    assert choice(candidate(0, near=False, pattern=0.9, pattern_text="p", pattern_good=False), candidate(1, near=False, pattern=0.8, pattern_text="q")) == (None, "none")
    assert choice(candidate(0, near=False, pattern=0.8, pattern_text="q")) == ("q", "pattern_partial")
    assert choice(candidate(0, near=False, pattern=0.9, pattern_text="p", score=0.1), candidate(1, near=False, pattern=0.9, pattern_text="q", score=0.2)) == ("q", "pattern_perfect_tiebreak")
    assert choice(candidate(0, near=False, vector=0.9, vector_text="a"), candidate(1, near=False, vector=0.5, vector_text="b")) == ("a", "embedding")
    assert choice(candidate(0, near=False, vector=0.9, vector_text="a"), candidate(1, near=False, vector=0.88, vector_text="b")) == ("a", "embedding_tiebreak")
    assert choice(candidate(0, near=False, partial=0.4, own="a"), candidate(1, near=False, partial=0.6, own="b", score=0.9)) == ("b", "regex_partial_tiebreak")


def test_used_tokens_serve_no_other_field():
    rows = [candidate(0, perfect=True, settled="a", settled_by="regex_perfect_value"), candidate(0, perfect=True, settled="a", settled_by="regex_perfect_value") | {"ord": 1}]
    out = extraction.Cascade(rows, [FIELD, FIELD | {"ord": 1}]).run()
    assert [c.value for c in out] == ["a", None] and out[0].used
    taken = extraction.Taken()
    assert not taken.take(5, "R$ 1,00 / R$ 2,00") and 5 not in taken.whole
    assert taken.take(6, "plain") and 6 in taken.whole and taken.take(7, None)


def test_a_service_settles_what_it_is_asked():
    class Says(extraction.Service):
        def choose(self, field, texts):
            return texts.index("t1")

        def is_kind(self, text, kind):
            return text == "Tel 99"

    rows = [candidate(0, near=False, partial=0.5, own="a", score=0.9), candidate(1, near=False, partial=0.5, own="b", score=0.1)]
    assert choice(*rows) == ("a", "regex_partial_tiebreak") and choice(*rows, service=Says()) == ("b", "regex_partial_tiebreak")
    label = candidate(0, perfect=True, role="LABEL", own="", settled_by="regex_perfect_label_no_value", text="Tel", below=["99", "x"])
    assert choice(label, field={"kind": "phone", "typed": True}, service=Says()) == ("Tel 99", "regex_perfect_label_service")


def test_headers_give_the_longest_path_that_fits(spark):
    rows = [(1, 0, "Vencimento", 0.1, 0.02, 0.3), (1, 1, "em", 0.1, 0.05, 0.3), (1, 2, "05/09/2025", 0.1, 0.08, 0.3), (1, 3, "fim", 0.1, 0.11, 0.3)]
    t = page(spark, rows).withColumn("role", F.when(F.col("token_id") == 0, "HEADER").otherwise("VALUE"))
    facts = classify.part(classify.ruled(t, []), "facts")
    own = extraction.schema_fields([("vencimento", "data")])
    r = extraction.candidates(facts, own).filter("perfect").first()
    assert (r["own"], r["settled_by"]) == ("em 05/09/2025 fim", "regex_perfect_header")


def test_what_was_learned_rules_matches_out(spark):
    t = adapters.order_form(spark, SF).filter("doc_id % 30 = 2")
    fields = [("limite", "data limite")]
    plain = found(extraction.extract(t, fields))
    assert {v[1] for v in plain.values()} == {"pattern_perfect"}
    never = learning.patterns(spark.createDataFrame([("order", "limite", i, None, None, None, None, "none", None, False) for i in range(2)], extraction.T.StructType.fromDDL("label_type string, field_name string, seq bigint, x double, y double, role string, data_type string, strategy string, connections int, found boolean")))
    assert {v for v in found(extraction.extract(t, fields, known=never, doc_type="order")).values()} == {(None, "none")}
    log = extraction.occurrences(extraction.extract(t, fields), "order")
    assert log.filter("found and role = 'VALUE' and data_type = 'date'").count() == len(plain)


def test_vectors_find_what_words_do_not(spark):
    t = adapters.order_form(spark, SF).filter("doc_id % 60 = 5")
    got = found(extraction.extract(t, [("situation", "statuses")], embed=trigram_vectors()))
    assert {v[1] for v in got.values()} == {"embedding"}


def test_types_of_low_priority_have_to_be_clear(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.0]), (3, [0.0, 0.5])], "vec_id bigint, embedding array<float>")
    p = spark.createDataFrame([("date", [1.0, 0.0], 10), ("acronym", [0.0, 1.0], 1)], "kind string, prototype array<double>, priority int")
    assert {(r["vec_id"], r["kind"]) for r in matching.type_classifier(v, p).collect()} == {(1, "date"), (2, "date")}


def test_values_with_labels_count_a_tenth_more(spark):
    pairs = spark.createDataFrame([(1, 0, "VALUE", "R$ 5,00", "Valor:"), (1, 1, "VALUE", "five", "R$ 5,00")], "doc_id bigint, token_id int, role string, text string, label string")
    got = matching.label_pattern_matches(pairs, "valor", "valor pago").collect()
    assert [(r["token_id"], r["score"]) for r in got] == [(0, 0.9)]


def test_names_keep_what_remains_a_name(spark):
    df = spark.createDataFrame([("Maria Souza.",), ("SP",), ("....",), ("12 3456 ab",)], "t string")
    h = H.BY_NAME["name"]
    assert [r["x"] for r in df.filter(h.detect(F.col("t"))).select(h.extract(F.col("t")).alias("x")).collect()] == ["Maria Souza"]


def test_one_page_error_is_its_own(spark, monkeypatch):
    own = extraction.schema_fields([("a", "b")])
    df = spark.createDataFrame([(1, *[None] * len(extraction.T.StructType.fromDDL(extraction.CANDIDATE_DDL)))], "doc_id bigint, " + extraction.CANDIDATE_DDL)
    out = extraction.chosen(df, own).collect()
    assert len(out) == 1 and out[0]["value"] is None and out[0]["strategy"].startswith("error")
