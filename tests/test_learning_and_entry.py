import __spark_entry__ as entry
from pagelattice.operators import learning

LOG = "label_type string, field_name string, seq bigint, x double, y double, role string, data_type string, strategy string, connections int, found boolean"


def log(spark, n, found):
    return spark.createDataFrame([("t", "f", i, 0.5, 0.5, "VALUE", "date", "s", 2, found) for i in range(n)], LOG)


def test_never_found_is_rejected(spark):
    known = learning.patterns(log(spark, 2, False))
    assert learning.vetoed(log(spark, 1, True), known).first()["rejected"]


def test_rigidity_needs_many(spark):
    assert learning.patterns(log(spark, 499, True)).first()["rigidity"] == 0.5
    assert learning.patterns(log(spark, 500, True)).first()["rigidity"] == 1.0


def test_rigidity_of_one_part_and_of_none(spark):
    bare = spark.createDataFrame([("t", "f", i, None, None, "VALUE" if i % 4 else "LABEL", None, "s", None, True) for i in range(500)], LOG)
    assert learning.patterns(bare).first()["rigidity"] == 0.75
    assert learning.patterns(bare.withColumn("role", bare.data_type)).first()["rigidity"] == 0.5


def test_rigid_field_rejects_another_role(spark):
    known = learning.patterns(log(spark, 500, True))
    other = spark.createDataFrame([("t", "f", 1, 0.5, 0.5, "LABEL", "date", "s", 2, True)], LOG)
    assert learning.vetoed(other, known).first()["rejected"]
    assert not learning.vetoed(log(spark, 1, True), known).first()["rejected"]


def test_unknown_field_is_accepted(spark):
    known = learning.patterns(log(spark, 3, False)).filter("field_name = 'other'")
    assert not learning.vetoed(log(spark, 1, True), known).first()["rejected"]


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_equals_batch(spark):
    q = entry.queries()
    sf = "/root/testdata/sf0.001"
    rows = lambda n: sorted(map(tuple, q[n](spark, sf).select("label_type", "field_name", "n", "found_rate").collect()))
    assert rows("m_stream") == rows("m_found_rate")
