"""Queries do their whole job: all rows, all queries, all candidates."""

from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
from pagelattice.operators import matching
from pagelattice.sources import adapters

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("block", [10_000, 2])
def test_every_hundredth_vector_is_a_query(spark, monkeypatch, block):
    monkeypatch.setattr(matching, "QUERY_BLOCK", block)
    rows = sorted((r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect())
    ids, m = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    want = set()
    for i in np.flatnonzero(ids % 100 == 0):
        s = np.round((m @ m[i] + 1) / 2, 6)
        found = sorted((-s[j], ids[j]) for j in range(len(ids)) if j != i and s[j] >= 0.3)[:5]
        want |= {(int(ids[i]), int(v), round(float(-x), 6), k + 1) for k, (x, v) in enumerate(found)}
    got = {(r["query_id"], r["vec_id"], round(r["score"], 6), r["rank"]) for r in entry.queries()["i_embedding_topk"](spark, SF).collect()}
    assert got == want and len({x[0] for x in got}) == int((ids % 100 == 0).sum()) > 1


def test_equal_and_unusable_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(9)] + [(9, None), (10, [1.0, None]), (None, [1.0, 0.0]), (11, [1.0])]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = matching.embedding_topk(v.repartition(3), v.filter("vec_id in (4, 9, 10)"), 3).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(4, 0, 1.0, 1), (4, 1, 1.0, 2), (4, 2, 1.0, 3)]
    assert matching.embedding_topk(v, v.limit(0)).count() == 0


def test_every_line_of_an_order_has_a_grid_row(spark):
    facts = ("l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")
    orders = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", *facts).collect():
        orders[r["l_orderkey"]].append(tuple(r[c] for c in facts))
    want = Counter()
    for key, rows in orders.items():
        for row, line in enumerate([("Line", "Quantity", "Price", "Flag"), *sorted(rows)]):
            text = line if not row else (str(line[0]), f"{line[1]:.2f}", f"{line[2]:.2f}", line[3])
            want.update((key, row * 4 + k, t, (100 + 40 * row) / 1000) for k, t in enumerate(text))
    got = Counter((r["doc_id"], r["token_id"], r["text"], r["y0"]) for r in adapters.order_grid(spark, SF).collect())
    assert got == want and max(x[1] for x in want) > 27
    n_rows = sum(map(len, orders.values()))
    q = entry.queries()
    assert q["d_lines"](spark, SF).groupBy().max("line").first()[0] == max(map(len, orders.values()))
    forms = spark.read.parquet(f"{SF}/customer.parquet").count()
    assert q["d_east_edges"](spark, SF).count() == 3 * (n_rows + len(orders)) + 5 * forms
    assert q["d_south_edges"](spark, SF).count() == 4 * n_rows


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute_candidates(blocks, fields):
    """(field, block, relation, score, far) of one page, from labels of 0.35 and more."""
    out = []
    for f in fields:
        labels = []
        for b in blocks:
            t = " ".join(b["text"].strip().rstrip(":").lower().split())
            same = len(set(t.split(" ")) & {f}) / len(set(t.split(" ")) | {f})
            score = max(same, 1 - edit_distance(t, f) / max(len(t), len(f), 1)) if t else 0
            labels += [(-score, b["token_id"], b)] if score >= 0.35 else []
        for s, _, label in sorted(labels, key=lambda x: x[:2])[:5]:
            right = [(b["x0"] - label["x1"], b["token_id"]) for b in blocks if min(b["y1"], label["y1"]) > max(b["y0"], label["y0"]) and b["x0"] >= label["x1"]]
            below = [(b["y0"] - label["y1"], b["token_id"]) for b in blocks if min(b["x1"], label["x1"]) > max(b["x0"], label["x0"]) and b["y0"] >= label["y1"]]
            out += [(f, min(x)[1], name, -s, min(x)[0]) for x, name in ((right, "same_line"), (below, "below")) if x]
    return out


def test_labels_above_the_floor_give_candidates(spark):
    pages = defaultdict(list)
    for r in adapters.kv_form(spark, SF).collect():
        pages[r["doc_id"]].append(r)
    fields = [f for f, _ in adapters.KV_FIELDS]
    found, front, taken = set(), set(), set()
    for doc, blocks in pages.items():
        c = brute_candidates(blocks, fields)
        for f in fields:
            own = [x for x in c if x[0] == f]
            best = {}
            for x in sorted(own, key=lambda x: -x[3]):
                best.setdefault((x[1], x[2]), x)
            top = sorted(best.values(), key=lambda x: (-x[3], x[1], x[2]))[:12]
            found |= {(doc, f, x[1], x[2], round(x[4], 6)) for x in top}
            beaten = lambda x: any(y[3] >= x[3] and y[4] <= x[4] and (y[3] > x[3] or y[4] < x[4]) for y in own)
            front |= {(doc, f, x[1], x[2]) for x in own if not beaten(x)}
        used = set()
        for f in sorted(fields, key=lambda f: (f != "balance", f)):
            free = sorted((-min(1.0, x[3] * 0.7 + 0.2 * (x[2] == "same_line")), x[1]) for x in c if x[0] == f and x[1] not in used)
            if free and -free[0][0] >= 0.60:
                used.add(free[0][1])
                taken.add((doc, f, free[0][1], round(-free[0][0], 6)))
    q = entry.queries()
    rows = lambda n, *cols: [tuple(r) for r in q[n](spark, SF).select("doc_id", "field", "block_id", *cols).collect()]
    assert set(rows("o_candidates", "relation", "far")) == found and len(found) > 9 * len(pages)
    assert set(rows("o_pareto", "relation")) == front
    assert set(rows("o_assign", "score")) == taken
