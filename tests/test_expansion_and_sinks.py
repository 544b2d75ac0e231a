import json

import pytest
from pyspark.sql import functions as F

from pagelattice import schema
from pagelattice.functions import expansion as E
from pagelattice.operators import candidates, roles
from pagelattice.sources import adapters, sinks


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_variants(spark):
    got = one(spark, E.synonyms(F.array(F.lit("vencimento"), F.lit("situação"), F.lit("data_base"))))
    assert got[:6] == ["vencimento", "venci", "vnco", "vcto", "ven", "venc"]
    assert {"situacao", "situa", "sit", "situ", "data", "base"} <= set(got) and len(set(got)) == len(got)
    assert one(spark, E.synonyms(F.array(F.lit("ab")))) == ["ab"]


def test_words_and_boost(spark):
    assert one(spark, E.keywords(F.lit("Data de vencimento da parcela dos saldos"))) == ["data", "vencimento", "parcela"]
    words = E.boost_words(F.lit("data base"))
    assert one(spark, E.boost(F.lit("Data Base:"), words)) == pytest.approx(1.35)
    assert one(spark, E.boost(F.lit("Data:"), words)) == pytest.approx(1.1)
    assert one(spark, E.boost(F.lit("x"), words)) == 1.0 and one(spark, E.boost(F.lit(None).cast("string"), words)) == 1.0


def test_expanded_query_repeats_what_weighs(spark):
    got = one(spark, E.expanded_query(F.lit("data_base"), F.lit("Data base"))).split()
    assert got.count("base") > 1 and got.count("data") == 1


def test_files_find_their_first_schema(spark):
    files = spark.createDataFrame([(1, "/x/a.pdf"), (2, "/y/b.pdf"), (3, "c.pdf")], "doc_id bigint, path string")
    f = lambda k: [(k, "d")]
    entries = spark.createDataFrame([(1, "L2", "a.pdf", f("late")), (0, "L1", "a.pdf", f("x")), (2, "L2", "b.pdf", f("y"))], "ord bigint, label string, pdf_path string, fields array<struct<key: string, value: string>>")
    got = {r["doc_id"]: (r["label"], r["fields"][0]["key"]) for r in adapters.with_schema(files, entries).collect()}
    assert got == {1: ("L1", "x"), 2: ("L2", "y"), 3: ("unknown", "texto")}
    assert [r["doc_id"] for r in adapters.with_schema(files, entries, "L2").collect()] == [2]


def test_result_document_has_the_shape_of_its_run(spark):
    ddl = "doc_id bigint, fields map<string,string>, error string"
    rows = [(2, {"a": None}, None), (1, {"a": "x"}, "broken")]
    assert json.loads(sinks.result_document(spark.createDataFrame(rows, ddl))) == [None, {"a": None}]
    assert json.loads(sinks.result_document(spark.createDataFrame(rows[:1], ddl))) == {"a": None}


def test_log_is_appended_and_read(spark, tmp_path):
    at = str(tmp_path / "log")
    assert sinks.read_occurrences(spark, at).count() == 0
    log = spark.createDataFrame([("t", "f", 1, 0.1, 0.2, "VALUE", "date", "s", 2, True)], schema.OCCURRENCE)
    sinks.append_occurrences(log, at)
    sinks.append_occurrences(log, at)
    assert sinks.read_occurrences(spark, at).count() == 2


def test_export_parts_inputs_and_outputs(spark, tmp_path):
    df = spark.createDataFrame([((1,), ("v",))], "input struct<a: int>, output struct<b: string>")
    sinks.write_export(df, str(tmp_path / "e"))
    assert {(r["kind"], r["value"]) for r in spark.read.text(str(tmp_path / "e")).collect()} == {("input", '{"a":1}'), ("output", '{"b":"v"}')}


def test_schema_spellings():
    assert E.parse_schema('{"a": "d"}') == E.parse_schema('[["a", "d"]]') == {"a": "d"}
    assert E.parse_schema('[{"a": "d"}, {"b": "e"}, {"a": "f"}]') == {"a": "f", "b": "e"}
    with pytest.raises(ValueError):
        E.parse_schema('["a"]')


def test_results_sink_keeps_nulls(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "doc_id bigint, value string")
    sinks.write_results(df, str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first()["value"]) == {"doc_id": 1, "value": None}


def test_dataset_file(spark, tmp_path):
    p = tmp_path / "d.json"
    p.write_text(json.dumps([{"label": "a", "extraction_schema": {"x": "1", "y": "2"}, "pdf_path": "p"}, {"label": None}]))
    row = adapters.dataset_entries(spark, str(p)).first()
    assert row["label"] == "a" and [tuple(f) for f in row["fields"]] == [("x", "1"), ("y", "2")]
    assert adapters.dataset_entries(spark, str(tmp_path / "none.json")).count() == 0


def test_spans_become_tokens(spark):
    ddl = "doc_id bigint, ord int, text string, bx0 double, by0 double, bx1 double, by1 double, page_width double, page_height double, size double, flags int, font string, color int"
    rows = [(1, 0, " ", 0.0, 0.0, 1.0, 1.0, 100.0, 200.0, 9.0, 0, "A", 0), (1, 1, "x", -5.0, 20.0, 150.0, 40.0, 100.0, 200.0, 9.0, 18, "Arial-Bold", 255)]
    got = adapters.spans_to_tokens(spark.createDataFrame(rows, ddl)).collect()
    assert len(got) == 1 and got[0]["token_id"] == 0 and (got[0]["x0"], got[0]["y0"], got[0]["x1"], got[0]["y1"]) == (0.0, 0.1, 1.0, 0.2)
    assert got[0]["bold"] and got[0]["italic"] and got[0]["color"] == "#0000ff"


def test_pareto_and_assignment(spark):
    c = spark.createDataFrame(
        [(1, "a", 1, "r", 0.9, 0.2), (1, "a", 2, "r", 0.8, 0.3), (1, "a", 3, "r", 0.8, 0.1), (1, "b", 1, "r", 0.95, 0.1), (1, "b", 4, "r", 0.7, 0.1)],
        "doc_id bigint, field string, block_id int, relation string, score double, far double",
    )
    assert sorted((r["field"], r["block_id"]) for r in candidates.pareto(c, ("score",), ("far",)).collect()) == [("a", 1), ("a", 3), ("b", 1)]
    kinds = c.selectExpr("*", "if(field = 'b', 'money', 'text') as kind")
    assert sorted((r["field"], r["block_id"]) for r in candidates.assign(kinds).collect()) == [("a", 2), ("b", 1)]


def test_fields_take_blocks_and_values_from_each_other():
    row = lambda f, kind, block, score, text: {"field": f, "kind": kind, "block_id": block, "score": score, "text": text}
    pick = lambda *rows: {x["field"]: x["block_id"] for x in candidates.assigned_page(list(rows))}
    assert pick(row("a", "date", 1, 0.7, "x"), row("b", "text", 1, 0.9, "x")) == {"b": 1}
    assert pick(row("a", "date", 1, 0.9, "x"), row("b", "text", 1, 0.95, "x")) == {"a": 1}
    assert pick(row("a", "date", 1, 0.7, "01/02"), row("b", "date", 2, 0.8, " 01/02 "), row("b", "date", 3, 0.65, "03/04")) == {"a": 1, "b": 3}
    assert pick(row("a", "date", 1, 0.7, "01/02"), row("b", "date", 2, 0.9, "01/02")) == {"a": 1, "b": 2}
    assert pick(row("a", "text", 1, 0.5, "x")) == {}


def test_names_and_settings():
    assert candidates.names_of("Nome Completo") == ["nome completo", "nome", "name"]
    assert candidates.names_of("x", (" A ", "")) == ["a"]
    assert candidates.settings({"use_assignment": True}, None)["use_assignment"] and not candidates.SETTINGS["use_assignment"]


def test_rules_keep_other_roles(spark):
    t = spark.createDataFrame(
        [(1, 0, "05/09/2025", "VALUE", 0.5), (1, 1, "Emitido", "LABEL", 0.5), (1, 2, "Total:", "LABEL", 0.5)], "doc_id bigint, token_id int, text string, role string, y0 double"
    )
    e = spark.createDataFrame([(1, 1, 0, "east"), (1, 2, 0, "south")], "doc_id bigint, from_id int, to_id int, relation string")
    none = spark.createDataFrame([], "doc_id bigint, label_id int, value_id int")
    got = {r["token_id"]: r["role"] for r in roles.date_label_cleanup(t, e, none).collect()}
    assert got == {0: "VALUE", 1: None, 2: "LABEL"}
