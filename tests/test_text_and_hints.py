from pyspark.sql import functions as F

from pagelattice.functions import hints as H
from pagelattice.functions import text as X


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_predicates(spark):
    assert one(spark, " Total: ", X.ends_with_colon)
    assert one(spark, "a: b", X.colon_in_middle)
    assert not one(spark, "ab:", X.colon_in_middle)
    assert one(spark, "due 05/09/2025", X.is_date)
    assert one(spark, "R$ 5", X.is_code)
    assert not one(spark, "05/09/2025", X.is_code)
    assert one(spark, "Nome", X.is_text_only)
    assert one(spark, "#FFF1F2", X.is_whitish)
    assert not one(spark, "#000000", X.is_whitish)


def test_normal_forms(spark):
    assert one(spark, "Operação_Nº  2", X.ascii_norm) == "operacao n 2"
    assert one(spark, " Ção  x ", X.accent_norm) == "cao x"
    assert sorted(one(spark, "valor da parcela da valor", X.keywords)) == ["parcela", "valor"]


def test_multi_value(spark):
    assert one(spark, "R$ 1.000,00 - R$ 2.000,00", X.multi_value)
    assert not one(spark, "R$ 1.000,00", X.multi_value)
    assert one(spark, "a; b; a", X.individual_values) == ["a", "b"]


def test_truncated(spark):
    assert one(spark, "abcdefgh ij", lambda c: X.truncated(c, 10)) == "abcdefgh..."
    assert one(spark, "abc", lambda c: X.truncated(c, 10)) == "abc"


def test_money_takes_the_first_alternative(spark):
    money = next(h for h in H.HINTS if h.name == "money")
    assert one(spark, "R$ 1.234,56", money.extract) == "R$ 1.234,56"
    assert one(spark, "R$ 1234,56", money.extract) == "R$ 123"


def test_relevance_and_priority():
    r = H.Registry()
    assert [h.name for h in r.relevant("endereco", "")] == ["date", "address", "text"]
    assert [h.name for h in r.specific("cpf", "")] == ["cpf_cnpj"]
    assert [h.name for h in r.relevant("x", "nome completo")][0] == "name"


def test_aggregates(spark):
    df = spark.createDataFrame([("R$ 1,50",), ("R$ 2",)], "t string")
    assert df.agg(H.aggregated(F.col("t"), "sum").alias("x")).first()["x"] == "3.5"
    mixed = spark.createDataFrame([("R$ 1,50",), ("x",)], "t string")
    assert mixed.agg(H.aggregated(F.col("t"), "sum").alias("x")).first()["x"] == "R$ 1,50 + x"
