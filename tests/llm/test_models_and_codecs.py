import gzip
import hashlib
import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pagelattice.llm import language_id as L
from pagelattice.llm import lm_scoring as M
from pagelattice.llm import pieces as P
from pagelattice.llm import sentencepiece_codec as S
from pagelattice.llm import warc as W

SMALL = L.Sample(texts_per_language=60, sequences=1500, rounds=1)


@pytest.mark.parametrize("bounds", [SMALL, L.Sample()])
def test_language_held_out_accuracy(spark, bounds):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = L.language_id(docs, bounds).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null")
    assert out.filter("lang = lang_pred").count() >= 0.97 * out.count() > 0


def test_language_odd_rows(odd_docs, no_docs):
    got = {r["doc_id"]: r for r in L.language_id(odd_docs, SMALL).collect()}
    assert [got[k]["lang_pred"] for k in (1, 2, 3, 6)] == ["und"] * 4
    assert got[60]["lang_pred"] in ("a", "b") and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in got.items() if k is not None)
    assert L.language_id(odd_docs, SMALL).count() == odd_docs.count()
    assert L.language_id(no_docs, SMALL).count() == 0
    unlabelled = odd_docs.withColumn("lang", odd_docs.source)
    assert {r["lang_pred"] for r in L.language_id(unlabelled, SMALL).collect()} == {"und"}


def test_sample_is_bounded_and_whole(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "concat('t', id, ' a\u00a0b') as text", "if(id % 4 = 0, 'rare', 'often') as lang")
    bounds = L.Sample(texts_per_language=50, languages=2, longest_text=8)
    got = L.labelled_sample(docs.repartition(5), bounds)
    assert got == L.labelled_sample(docs.repartition(2), bounds)
    assert [sum(x[0] == k for x in got) for k in ("often", "rare")] == [50, 50] and all(len(x[2]) <= 8 for x in got)
    assert {x[0] for x in L.labelled_sample(docs, L.Sample(languages=1))} == {"often"}
    assert L.fit([x[2] for x in got], [x[0] for x in got], SMALL).languages == ["often", "rare"]


def test_switched_text_gets_spans(spark):
    texts = ["the of and that was", "le les des une est"] * 30
    model = L.fit(texts, ["en", "fr"] * 30, SMALL)
    df = spark.createDataFrame([(1, "the that was and of the les des une le est des")], "doc_id bigint, text string")
    spans = L.predict(df, model, spans=True).first()["spans"]
    assert [(s["first"], s["words"], s["lang"]) for s in spans] == [(0, 6, "en"), (6, 6, "fr")]


def test_forward_backward_sums_over_all_labellings():
    rng = np.random.default_rng(2)
    model = L.Model(["a", "b", "c"], np.zeros((1, 3)), rng.normal(size=(3, 3)).astype(np.float32))
    e = rng.normal(size=(5, 3)).astype(np.float32)
    counts = np.array([4, 0, 1, 3])
    codes = np.array([0, 1, 2, 3, 4, 0, 0, 2])
    got, at = L.label(model, e, codes, counts), 0
    for n in counts:
        total = np.zeros((n, 3))
        for y in np.ndindex(*[3] * n):
            s = math.exp(sum(e[codes[at + i]][y[i]] for i in range(n)) + sum(model.transitions[y[i], y[i + 1]] for i in range(n - 1)))
            for i in range(n):
                total[i, y[i]] += s
        assert n == 0 or np.allclose(got[at : at + n], total / total.sum(1, keepdims=True), atol=1e-5)
        at += n


def test_lattice_sums_over_all_segmentations():
    texts = ["▁", "a", "b", "ab", "▁a", "ba", "aba"]
    lp = np.log(np.array([0.1, 0.2, 0.1, 0.15, 0.1, 0.1, 0.05] + [0.15 / 256] * 256 + [0.05]))
    lattice = M.Lattice(texts, lp)

    def every(w):
        if not w:
            return 1.0
        t = sum(math.exp(lp[i]) * every(w[len(x) :]) for i, x in enumerate(texts) if w.startswith(x))
        return t + (math.exp(sum(lp[7 + b] for b in w[0].encode())) * every(w[1:]) if w[0] not in texts else 0)

    words = ["aba", "abab", "éa", "b", "baabab", "日本", "a" * 12]
    assert np.allclose(lattice.log_marginals(words), [math.log(every("▁" + w)) for w in words])
    uses = lattice.expected(["aba", "é"], np.array([2.0, 1.0]))
    assert math.isclose(sum(uses[i] * len(t) for i, t in enumerate(texts)) + uses[7:].sum() / 2, 4 * 2 + 1 + 1)


@pytest.mark.parametrize("bound", [300_000, 3])
def test_scores_against_brute_force(odd_docs, monkeypatch, bound):
    monkeypatch.setattr(M, "FREQUENT", bound)
    rows = [(r["doc_id"], (r["text"] or "").encode().lower().split()) for r in odd_docs.collect()]
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    c = Counter(x for d, w in rows if not out(d) for x in [*w, None])
    n, v = sum(c.values()), len(c)
    want = sorted((str(d), out(d), len(w) + 1, sum(c[x] > 0 for x in [*w, None]), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in [*w, None]), 4)) for d, w in rows)
    scored = M.lm_scores(odd_docs).collect()
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in scored)
    assert got == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in scored)


def every_way(word, texts, lp):
    """All segmentations of a word: their pieces and log probabilities."""
    if not word:
        return [((), 0.0)]
    out = [((i, *rest), lp[i] + p) for i, x in enumerate(texts) if word.startswith(x) for rest, p in every_way(word[len(x) :], texts, lp)]
    if word[0] not in texts:
        raw = tuple(len(texts) + b for b in word[0].encode())
        out += [((*raw, *rest), sum(lp[i] for i in raw) + p) for rest, p in every_way(word[1:], texts, lp)]
    return out


@pytest.mark.parametrize("prior_weight,word_weight", [(5.0, 0.4), (5.0, 0.0), (math.inf, 0.0)])
def test_whole_scores_against_all_segmentations(spark, monkeypatch, prior_weight, word_weight):
    monkeypatch.setattr(M, "FREQUENT", 4)
    texts = ["▁", "a", "b", "ab", "▁a", "ba", "aba"]
    p = P.Pieces(["<unk>", *texts], np.array([0, -2.0, -1.5, -1.2, -2.0, -2.1, -0.5, -2.9]), np.arange(1, 8), np.full(256, -1), 0, True, True)
    docs = [(0, "aba ab A"), (1, "ab ab é"), (2, "baab x"), (3, None), (4, "ab aba"), (5, "abab zz"), (6, "a b ab ab")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(2)
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    split = {d: (t or "").lower().split() for d, t in docs}
    train = Counter(w for d, ws in split.items() if not held(d) for w in ws)
    ends = sum(not held(d) for d in split)
    start = M.prior(p)
    total = np.zeros(len(start))
    for w, c in train.items():
        ways = every_way("▁" + w, texts, start)
        z = sum(math.exp(x) for _, x in ways)
        for ids, x in ways:
            np.add.at(total, list(ids), c * math.exp(x) / z)
    total[-1] = ends
    law = total / prior_weight + np.exp(start)
    lp = np.log(law / law.sum())
    n = sum(train.values()) + ends
    chance = lambda w: (1 - word_weight) * sum(math.exp(x) for _, x in every_way("▁" + w, texts, lp)) + word_weight * train[w] / n
    want = {d: sum(math.log10(chance(w)) for w in ws) + lp[-1] / math.log(10) for d, ws in split.items()}
    got = {r["doc_id"]: r["score"] for r in M.lm_scores(df, vocabulary=p, prior_weight=prior_weight, word_weight=word_weight).collect()}
    assert any(map(held, split)) and got == pytest.approx(want, abs=1e-9)


def test_long_words_take_bounded_memory():
    texts = ["▁", "a", "b", "ab", "▁a", "ba", "aba"]
    lattice = M.Lattice(texts, M.prior(P.Pieces(texts, np.zeros(7), np.arange(7), np.full(256, -1), 0, True, True)))
    tracemalloc.start()
    uses = lattice.expected(["ab" * 10_000], np.array([1.0]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert uses.sum() > 5_000 and peak < 4_000_000


def test_scores_of_nothing(no_docs):
    assert M.lm_scores(no_docs).count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    return S.Vocabulary(P.load())


@pytest.mark.parametrize("few", [1, 16, 10_000])
def test_pieces_equal_the_library(vocabulary, monkeypatch, few):
    import sentencepiece

    monkeypatch.setattr(S, "FEW_UNITS", few)
    sp = sentencepiece.SentencePieceProcessor(model_file=P.default_path())
    texts = ["", " ", "  a", "a  b ", "hello world", "naïve café 日本語 🙂\n\n\tx", "a" * 40, "    def f():\n        return 1", "▁x y", "x" * 3000, "123456 7890.12", "a b c\x00d \x00"]
    texts += ["".join(np.random.default_rng(i).choice(list("abcdeèéñ .,\n#|日"), 200)) for i in range(40)]
    ids, counts = S.encode(S.Memory(vocabulary), pa.array(texts))
    ends = np.append(0, np.cumsum(counts))
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == sp.encode(texts)
    back = S.decode(vocabulary, ids, counts)
    assert [b.decode() for b in back] == [t.replace("▁", " ") for t in texts]


def test_memory_forgets_and_stays_right(vocabulary, monkeypatch):
    import sentencepiece

    monkeypatch.setattr(S, "REMEMBERED_UNITS", 40)
    sp = sentencepiece.SentencePieceProcessor(model_file=P.default_path())
    m, rng = S.Memory(vocabulary), np.random.default_rng(5)
    for _ in range(12):
        texts = [" ".join(["the", "of"] + ["".join(rng.choice(list("abcdefg"), 5)) for _ in range(20)]) for _ in range(3)]
        ids, counts = S.encode(m, pa.array(texts))
        ends = np.append(0, np.cumsum(counts))
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == sp.encode(texts)
        assert len(m.number) <= 140 and len(m.number) == len(m.size)


def test_one_pair_at_a_time_agrees(vocabulary):
    rng = np.random.default_rng(3)
    a, b = rng.choice(vocabulary.usable, 4000), rng.choice(vocabulary.usable, 4000)
    fits = vocabulary.scalar_follow()
    assert vocabulary.may_follow(a, b).tolist() == [fits(x, y) for x, y in zip(a.tolist(), b.tolist())]


@pytest.mark.parametrize("letters", ["abrcd", "".join(map(chr, range(0x4E00, 0x4E00 + 3000)))])
def test_suffix_array_orders_and_finds(letters):
    rng = np.random.default_rng(1)
    text = "abracadabra" + "".join(rng.choice(list(letters), 300)) + "abracadabra" * 3
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int32)
    index = S.Index(codes, 16)
    want = sorted(range(len(text)), key=lambda i: text[i:])
    assert [text[i : i + 16] for i in index.order] == [text[i : i + 16] for i in want]
    strings = ["abra", "a", "x", "cad", "abracadabra", "abracadabraabrac", "abracadabraabraz", text[20:34], text[40:56]]
    flat = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32).astype(np.int32)
    size = np.array(list(map(len, strings)))
    low, high = index.ranges(flat, np.cumsum(size) - size, size)
    for s, a, b in zip(strings, low, high):
        assert sorted(index.order[a:b].tolist()) == [i for i in range(len(text)) if text.startswith(s, i)]


def test_unigram_model_takes_the_best_sum(monkeypatch):
    texts = ["<unk>", "▁a", "b", "▁", "a", "ab", "▁ab"]
    p = P.Pieces(texts, np.array([0, -1.5, -1.2, -2.0, -2.1, -0.5, -2.9]), np.arange(1, 7), np.full(256, -1), 0, True, True)
    for few in (1, 16):
        monkeypatch.setattr(S, "FEW_UNITS", few)
        ids, counts = S.encode_units(S.Vocabulary(p), ["ab", "aab", "é"])
        assert ids.tolist() == [3, 5, 1, 5, 3, 0] and counts.tolist() == [2, 2, 2]


def test_encoding_odd_rows(odd_docs, no_docs):
    got = S.encode_documents(odd_docs, digests=True).collect()
    assert len(got) == odd_docs.count() and all(r["round_trip"] for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (1, 2)} == {0}
    text = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    assert all(r["decoded_sha256"] == hashlib.sha256((text[r["doc_id"]] or "").encode()).hexdigest() for r in got)
    assert S.encode_documents(no_docs).count() == 0


def test_chunked_framing():
    data = ("é" * 30 + "\r\n0\r\n\r\n").encode()
    assert W.unchunked(W.chunked(data, 7)) == data
    assert W.unchunked(b"3;x=y\r\nabc\r\n0\r\nT: v\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        W.unchunked(b"3\r\nabcd\r\n0\r\n\r\n")


def test_archives_round_trip(spark):
    long = "é" * 2000 + "\r\n\r\nWARC/1.1\r\n"
    rows = [(1, "http://a", long), (2, None, long), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (None, "u", long), (1, "u", long), (7, "u", "z" * 100), (8, "u", "z" * 99), (9, "u", "z" * 99), (10, "u", "z" * 100)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, digest string").repartition(3)
    out = W.archive_round_trip(pages, segment=300).collect()
    first = {}
    for p, _, h in rows:
        if p is not None and len((h or "").encode()) >= 100:
            first[h] = min(p, first.get(h, p))
    want = []
    for p, _, h in rows:
        raw = (h or "").encode()
        again = h in first and p != first[h]
        want.append((str(p), len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out) == sorted(want, key=lambda x: x[:4])
    assert W.archive_round_trip(pages.limit(0)).count() == 0


def test_archives_of_several_members_and_plain_ones(spark, tmp_path):
    texts = [f"page {i} " * 20 for i in range(5)]
    records = []
    for i, t in enumerate(texts):
        digest = hashlib.sha256(t.encode()).hexdigest()
        records += [r.encode() + b"\r\n\r\n" for r in W.records_of("http://a", i, t.encode(), digest, None, False, i, W.SEGMENT_BYTES)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records[:3]))
    (tmp_path / "b.warc").write_bytes(b"".join(records[3:]))
    responses, _ = W.read_pages(spark, str(tmp_path))
    assert sorted((r["page_id"], r["payload_bytes"]) for r in responses.collect()) == [(i, len(t)) for i, t in enumerate(texts)]
    with pytest.raises(EOFError):
        W.archive_bytes(gzip.compress(records[0]) + gzip.compress(records[1])[:-4])


def test_copies_beyond_the_broadcast_bound(spark, monkeypatch):
    rows = [(i, "u", ("x" * 200 if i % 2 else f"{i % 7}" * 150) if i % 5 else "") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    want = sorted(map(str, W.archive_round_trip(pages).collect()))
    monkeypatch.setattr(W, "BROADCAST_DIGESTS", 3)
    assert sorted(map(str, W.archive_round_trip(pages).collect())) == want


def test_lost_segments_are_noticed(spark):
    rows = [("response", "r1", None, 1, None, 1, "d", None, b"ab"), ("continuation", "r3", "r1", 3, 6, None, None, None, b"ef")]
    with pytest.raises(Exception, match="segments missing"):
        W.reassembled(spark.createDataFrame(rows, W._RECORD_DDL)).collect()
