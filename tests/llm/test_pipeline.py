"""The pipeline against a plain version of each stage."""

import pytest
import sentencepiece

import corpus_pipeline as C
from pagelattice.llm import pieces as P
from pagelattice.llm import quality_rules as Q
from pagelattice.llm.common import Workspace
from tests.llm.test_near_and_substring import brute_groups, brute_print
from tests.llm.test_rules_and_search import shingles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Rows that go into each stage and the last one's."""
    space = Workspace(spark, "test-pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in C.STAGES:
        out.append(space.keep(stage(spark, out[-1], SF), name))
    return [[r.asDict() for r in df.collect()] for df in out]


def test_quality(stages, spark):
    kept = {r["doc_id"] for r in Q.quality_rules(spark.read.parquet(f"{SF}/documents.parquet")).filter("kept").collect()}
    assert {r["doc_id"] for r in stages[1]} == kept and set(stages[1][0]) == set(stages[0][0])


def test_near_dedup(stages):
    prints = {r["doc_id"]: brute_print(r["text"]) for r in stages[1]}
    groups = brute_groups(set(prints.values()))
    least = {}
    for d, p in prints.items():
        least[groups[p]] = min(d, least.get(groups[p], d))
    assert sorted(r["doc_id"] for r in stages[2]) == sorted(least.values())


def test_substrings(stages):
    starts, split = {}, {r["doc_id"]: r["text"].encode().split() for r in stages[2]}
    for d, w in split.items():
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            starts[k] = min(d, starts.get(k, d))
    want = {}
    for d, w in split.items():
        gone = {i + k for i in range(len(w) - 12) if starts[tuple(w[i : i + 13])] < d for k in range(13)}
        left = [x for i, x in enumerate(w) if i not in gone]
        if left or not gone:
            want[d] = left
    assert {r["doc_id"]: r["text"].encode().split() for r in stages[3]} == want
    assert all(r["n_chars"] == len(r["text"]) for r in stages[3])


def test_decontamination(stages, spark):
    items = [shingles(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [r["doc_id"] for r in stages[3] if not any(q and len(q & shingles(r["text"])) >= 0.8 * len(q) for q in items)]
    assert sorted(r["doc_id"] for r in stages[4]) == sorted(clean)
    assert len(stages[4]) < len(stages[3])


def test_encoding(stages):
    sp = sentencepiece.SentencePieceProcessor(model_file=P.default_path())
    text = {r["doc_id"]: r["text"] for r in stages[4]}
    assert {r["doc_id"]: r["ids"] for r in stages[5]} == {d: sp.encode(t) for d, t in text.items()}
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in stages[5])
