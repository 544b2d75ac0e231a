import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from pagelattice.llm import simhash as S
from pagelattice.llm import substring_dedup as D
from pagelattice.llm.common import Workspace
from pagelattice.llm.graph import components


def brute_print(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints, bits=4):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in root:
        for b in root:
            if (a ^ b).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {p: find(p) for p in root}


def test_fingerprints_and_components(odd_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    prints = [(r["doc_id"], brute_print(r["text"])) for r in rows]
    groups = brute_groups({p for _, p in prints})
    least = defaultdict(list)
    for d, p in prints:
        if d is not None:
            least[groups[p]].append(d)
    want = sorted((d if d is not None else -1, f"{p:016x}", min(least[groups[p]], default=None)) for d, p in prints)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["fingerprint"], r["component_id"]) for r in S.near_duplicates(odd_docs).collect())
    assert got == want


def test_random_clusters_of_prints(spark):
    rng = random.Random(9)
    prints = set()
    for _ in range(40):
        c = rng.getrandbits(64)
        for _ in range(12):
            prints.add(c)
            for _ in range(rng.randint(1, 4)):
                c ^= 1 << rng.randrange(64)
    signed = [(int(np.uint64(p).astype(np.int64)),) for p in prints]
    df = spark.createDataFrame(signed, "fp bigint").repartition(4)
    space = Workspace(spark, "test")
    found = {np.int64(r["node"]).astype(np.uint64).item(): r["root"] for r in components(S.links(df, len(signed)), space).collect()}
    want = brute_groups(prints)
    by_root = defaultdict(set)
    for p in prints:
        by_root[want[p]].add(found.get(p, ("alone", p)))
    assert all(len(x) == 1 for x in by_root.values())
    assert len({next(iter(x)) for x in by_root.values()}) == len(by_root)


def test_large_bucket_gives_a_forest():
    rng = np.random.default_rng(1)
    center = np.uint64(rng.integers(1 << 62))
    fps = np.unique(center ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)))
    u, v = S.bucket_links(np.zeros(len(fps), np.uint64), fps, np.ones(len(fps), bool))
    assert len(u) == len(fps) - 1
    assert (np.bitwise_count(u ^ v) <= 4).all()


def test_radii_must_cover(spark):
    with pytest.raises(ValueError):
        S.links(spark.createDataFrame([(1,)], "fp bigint"), 1, segments=((0, 32, 1), (32, 32, 1)))


def test_one_of_each(odd_docs):
    kept = S.one_of_each(odd_docs)
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert kept.columns == odd_docs.columns
    assert ids.count(7) == 1 and len(ids) == len(set(ids))
    assert set(ids) == {r["component_id"] for r in S.near_duplicates(odd_docs).collect()}


def test_one_of_each_tells_components_apart(spark):
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(7)]
    a, b, c, d, e, f, g = texts
    rows = [(None, a), (None, b), (None, b), (None, c), (1, c), (2, d), (2, e), (2, e), (3, e), (4, f), (5, f), (5, g), (None, g)]

    def kept(rows):
        docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, k int").repartition(3)
        out = S.one_of_each(docs)
        assert out.columns == docs.columns
        return sorted(((r["doc_id"], texts.index(r["text"])) for r in out.collect()), key=str)

    assert kept(rows) == sorted([(None, 0), (None, 1), (1, 2), (2, 3), (2, 4), (4, 5), (5, 6)], key=str)
    # One component of null ids only, beside null ids that are copies of an identified document.
    assert kept([(None, a), (None, b), (None, b), (1, b)]) == sorted([(None, 0), (1, 1)], key=str)
    # Two near texts of one id are one component.
    near = [(1, a), (1, a.upper()), (2, a)]
    docs = spark.createDataFrame(near, "doc_id bigint, text string")
    assert [r["doc_id"] for r in S.one_of_each(docs).collect()] == [1]


def brute_removed(rows):
    starts = defaultdict(set)
    key = lambda d: float("inf") if d is None else d
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - 12):
            starts[tuple(w[i : i + 13])].add(key(d))
    out = []
    for d, w in split:
        gone = {i + k for i in range(len(w) - 12) if min(starts[tuple(w[i : i + 13])]) < key(d) for k in range(13)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((key(d), len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_substrings_against_brute_force(odd_docs):
    want = brute_removed([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert any(x[2] for x in want)
    got = sorted((float("inf") if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in D.substring_dedup(odd_docs).collect())
    assert got == want


def test_rows_without_an_id_keep_their_own_places(spark):
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(10**6)}"
    same, other = [" ".join(word() for _ in range(20)) for _ in range(2)]
    rows = [(1, same), (1, f"{other} {word()}"), (2, f"{word()} {other}")]
    rows += [(None, f"{word()} {same if k % 2 else word()} {' '.join(word() for _ in range(k))}") for k in range(30)]
    got = sorted((float("inf") if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in D.substring_dedup(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect())
    assert got == brute_removed(rows) and sum(x[2] for x in got) == 16 * 20


def test_common_fingerprints_get_their_group(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(6)]
    rows = [(i, texts[0] if i % 3 else texts[i % 6]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for common in (10_000, 2):
        monkeypatch.setattr(S, "COMMON", common)
        least = {}
        for i, t in rows:
            least[t] = min(i, least.get(t, i))
        assert {r["doc_id"]: r["component_id"] for r in S.near_duplicates(df).collect()} == {i: least[t] for i, t in rows}


def test_matches_at_every_alignment(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(10**9)}"
    rows = []
    for shift in range(14):
        for other in range(7):
            same = [word() for _ in range(13)]
            k = len(rows)
            rows.append((k, " ".join([word() for _ in range(shift)] + same + [word() for _ in range(3)])))
            rows.append((k + 1, " ".join([word() for _ in range(other)] + same)))
    got = {r["doc_id"]: r["n_removed"] for r in D.substring_dedup(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()}
    assert all(got[k] == (13 if k % 2 else 0) for k in got)


def test_kept_text_keeps_its_lines(spark):
    a = " ".join(f"a{i}" for i in range(20))
    rows = [(1, a), (2, f"first line\nsecond {a}\nthird  line"), (3, a)]
    docs = spark.createDataFrame([(d, t, len(t)) for d, t in rows], "doc_id bigint, text string, n_chars bigint")
    out = {r["doc_id"]: (r["text"], r["n_chars"]) for r in D.without_repeats(docs).collect()}
    left = "first line\nsecond\nthird  line"
    assert out == {1: (a, len(a)), 2: (left, len(left))}


def test_empty_tables(no_docs):
    assert S.near_duplicates(no_docs).count() == 0
    assert S.one_of_each(no_docs).count() == 0
    assert D.substring_dedup(no_docs).count() == 0
    assert D.without_repeats(no_docs).count() == 0
