from collections import Counter

from pagelattice.llm import chat_format as C
from pagelattice.llm import decontaminate as B
from pagelattice.llm import quality_rules as Q
from pagelattice.llm import url_filter as U


def test_counts_against_brute_force(odd_docs):
    for r in Q.quality_rules(odd_docs).collect():
        t = r["text"] or ""
        w = t.encode().split()
        wins = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {i + k for i in range(len(w) - 7) if wins[tuple(w[i : i + 8])] > 1 for k in range(8)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        want = (len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in Q.SYMBOLS), len(lines) - len(set(lines)), len(covered))
        assert want == (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert r["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert not (r["kept"] and r["base_failed"])


def test_overlapping_repeats(spark):
    for text, n in (("a " * 9, 9), ("a " * 8, 0), (" ".join(map(str, range(8))) + " x " + " ".join(map(str, range(8))), 16)):
        got = Q.quality_rules(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
        assert got["n_repeat_words"] == n


def test_rejected_rows_go_and_columns_stay(odd_docs, no_docs):
    kept = Q.rejected_out(odd_docs)
    assert kept.columns == odd_docs.columns
    judged = Q.quality_rules(odd_docs).filter("kept")
    assert kept.count() == judged.count() < odd_docs.count()
    assert Q.rejected_out(no_docs).count() == 0


def test_windows_whose_hashes_meet(spark, monkeypatch):
    import random

    monkeypatch.setattr(Q, "PLACE_BITS", 60)  # leaves four bits of the hash
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(8, 60)))) for i in range(60)]
    for r in Q.quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        w = r["text"].split()
        wins = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        assert r["n_repeat_words"] == len({i + k for i in range(len(w) - 7) if wins[tuple(w[i : i + 8])] > 1 for k in range(8)})


def test_own_columns_stay(spark):
    df = spark.createDataFrame([(1, "the a of", "x", 5, 0.5)], "doc_id bigint, text string, _qr_t string, n_words int, kept double")
    got = Q.quality_rules(df).first().asDict()
    assert got["_qr_t"] == "x" and got["own_n_words"] == 5 and got["own_kept"] == 0.5 and got["n_words"] == 3 and got["kept"] is False
    assert Q.quality_rules(spark.createDataFrame([(1, "The OF cat")], "doc_id bigint, text string")).first()["n_stop_words"] == 2


def test_no_python_in_the_rules(odd_docs):
    plan = Q.quality_rules(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan.replace("RoundRobin", "").split("Project")[0]


def shingles(t):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({" ".join(w)} if w else set())


def test_containment_against_brute_force(spark, odd_docs):
    texts = [r["text"] for r in odd_docs.collect()]
    long = next(t for t in texts if t and len(t.split()) > 5000).split()
    items = [(1, " ".join(long[100:130])), (2, " ".join(long[200:225] + ["zz"] * 1)), (3, " ".join(long[300:320] + long[900:910])), (4, None), (5, "12 !! 34"), (6, "The of"), (7, ""), (None, " ".join(long[5:20])), (8, "no such words here at all")]
    df = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, h int")
    want = []
    for r in odd_docs.collect():
        own = shingles(r["text"])
        for i, t in items:
            q = shingles(t)
            if q and len(q & own) >= 0.8 * len(q) - 1e-9:
                want.append((str(r["doc_id"]), str(i), len(q & own), len(q)))
    got = [(str(r["doc_id"]), str(r["item_id"]), r["n_shared"], r["n_item"]) for r in B.contamination(odd_docs, df).collect()]
    assert sorted(got) == sorted(want) and len(want) >= 5
    clean = B.clean_documents(odd_docs, df)
    assert clean.columns == odd_docs.columns
    assert clean.count() == odd_docs.count() - len({x[0] for x in want}) - 1  # the repeated row goes too


def test_containment_by_shuffle(spark, odd_docs, monkeypatch):
    long = next(t for t in (r["text"] for r in odd_docs.collect()) if t and len(t.split()) > 5000).split()
    items = spark.createDataFrame([(1, " ".join(long[100:130])), (2, "The of"), (3, " ".join(long[:2000])), (4, " ".join(long[9:15]))], "item_id bigint, text string")
    want = sorted(map(str, B.contamination(odd_docs, items).collect()))
    monkeypatch.setattr(B, "BROADCAST_SHINGLES", 0)
    assert sorted(map(str, B.contamination(odd_docs, items).collect())) == want and len(want) >= 4


def test_containment_of_empty_tables(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")
    assert B.contamination(odd_docs, none).count() == 0
    assert B.contamination(no_docs, some).count() == 0
    assert B.clean_documents(odd_docs, none).count() == odd_docs.count()


def test_url_cases(spark):
    urls = [
        (1, None), (2, "no scheme"), (3, "HTTP://A.Example.COM/en/7/x?y#z"), (4, "http://example.com/en/8"), (5, "https://b.example.net/de/81"), (6, "https://b.net/de/1"),
        (7, "http://x.org/es/"), (8, "http://bad.site.io:80/a//b/page.html?q"), (9, "http://site.io/a/b"), (10, "http://site.io/c"), (11, "://"), (12, "http://notexample.com/fr/"), (None, "http://site.io/a/b/c"), (8, "http://bad.site.io:80/a//b/page.html?q"),
    ]
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in urls], "page_id bigint, url string, html string, key int")
    listed = spark.createDataFrame([("http://site.io/a/b/",), (None,), ("broken",)], "url string")
    got = U.url_filter(pages, [U.HostRule(*r) for r in U.DEFAULT_RULES], listed).collect()
    by = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got}
    assert len(got) == len(urls)
    assert by[1] == by[2] == ("", "", None, "allow")
    assert by[3] == ("a.example.com", "/en/7/x", "example.com/en/7", "allow")
    assert by[4][2:] == ("com/en/", "block")
    assert by[5][2:] == ("example.net/de/8", "block")
    assert by[6][2:] == ("net/de/", "allow")
    assert by[7][2:] == ("org/es/", "block")
    assert by[8][2:] == (None, "block")
    assert by[10][2:] == (None, "allow") and by[12][2:] == (None, "allow")
    assert by[None][3] == "block"


def test_deep_listed_urls(spark):
    listed = spark.createDataFrame([("http://h.io/a/b/c/d/e/f/g/",), ("http://2.3.4.5.6.7.8.example.org/",), ("http://a.b/x/y/z",)], "url string")
    urls = {
        "http://h.io/a/b/c/d/e/f/g/page": "block", "http://h.io/a/b/c/d/e/f/g/h/i/j/k": "block", "http://h.io/a/b/c/d/e/f/x/page": "allow", "http://h.io/a/b/c/d/e/f/g": "allow",
        "http://0.1.2.3.4.5.6.7.8.example.org/": "block", "http://3.4.5.6.7.8.example.org/q/r": "allow", "http://c.a.b/x/y/z": "block", "http://a.b/x/y/z/1": "allow",
    }
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = U.url_filter(pages, [], listed).collect()
    assert {r["url"]: r["verdict"] for r in got} == urls


def test_common_urls_are_judged_like_others(spark, monkeypatch):
    urls = ["http://a.io/x"] * 30 + ["http://b.io/y"] * 30 + [f"http://c.io/{i}" for i in range(20)] + [None] * 5
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").repartition(3)
    listed = spark.createDataFrame([("http://a.io/",), ("http://c.io/7",)], "url string")
    want = Counter("block" if u and (u.startswith("http://a.io") or u == "http://c.io/7") else "allow" for u in urls)
    for common in (10_000, 4):
        monkeypatch.setattr(U, "COMMON", common)
        got = U.url_filter(pages, [], listed).collect()
        assert Counter(r["verdict"] for r in got) == want and len(got) == len(urls)


def test_filter_has_no_false_negatives_and_few_positives(spark):
    keys = spark.range(20_000).selectExpr("concat('k', id) as key")
    bloom, blocks = U.build_filter(keys, 20_000)
    assert U.possible(keys, bloom, blocks).count() == 20_000
    others = spark.range(20_000).selectExpr("concat('other', id) as key")
    assert U.possible(others, bloom, blocks).count() < 400


def test_quotes_link_and_go(spark):
    rows = [
        (1, 0, "user", "How do I sort?\nThanks  for help"), (1, 1, "assistant", "> How do I SORT?\n\nUse sorted."), (1, 2, "user", ">> How do I sort?\n> Use sorted.\nAnd reversed?"),
        (1, 3, "assistant", "> nobody said this\nYes."), (2, 0, None, None), (2, 0, None, None), (None, None, "user", "hello"), (3, 5, "user", "> How do I sort?\nhm"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, mid string")
    got = {(r["conv_id"], r["turn"]): r for r in C.chat_messages(df).collect()}
    assert got[1, 1]["reply_to"] == 0 and got[1, 1]["body"] == "Use sorted." and got[1, 1]["n_linked"] >= 1
    assert got[1, 2]["reply_to"] == 1 and got[1, 2]["body"] == "And reversed?"
    assert got[1, 3]["reply_to"] == 2 and got[1, 3]["n_linked"] == 0
    assert got[3, 5]["n_linked"] == 0
    assert got[2, 0]["role"] == "unknown" and got[None, -1]["body"] == "hello"
    chat = {r["conv_id"]: r for r in C.chat_format(df).collect()}
    assert chat[1]["replies"] == "-,0,1,2" and ">" not in chat[1]["chat"].replace("|>", "")
    assert C.chat_format(df.limit(0)).count() == 0


def parse(text):
    """(level, line) of a message, its runs and its lines, normalised."""
    import re

    lines = []
    for x in text.replace("\r\n", "\n").split("\n"):
        m = re.match(r"[ \t]*(>[> \t]*)", x)
        lines.append((m[1].count(">"), x[m.end() :]) if m else (0, x))
    found, last = set(), None
    for level, x in lines:
        if not x.strip(" "):
            last = None
        elif last and last[0] == level:
            last[1].append(x)
        else:
            last = (level, [x])
            found.add(id(last)) or runs_of.append(last)
    out = {(level, x) for level, x in lines} | {(level, " ".join(xs)) for level, xs in runs_of}
    runs_of.clear()
    norm = lambda s: " ".join("".join(c.lower() if "A" <= c <= "Z" else c for c in s).split())
    return {(level, norm(x)) for level, x in out if norm(x)}


runs_of = []


def brute_replies(rows):
    """(conv, turn, role, text) to the turn answered and the number of linked passages."""
    own = {r: parse(r[3]) for r in set(rows)}
    out = {}
    for r, said in own.items():
        votes = {}
        for level, p in said:
            origins = [o[1] for o, theirs in own.items() if o[0] == r[0] and o[1] < r[1] and (0, p) in theirs]
            if level and origins:
                n, size = votes.get((level, max(origins)), (0, 0))
                votes[level, max(origins)] = (n + 1, size + len(p))
        best = min(((level, -size, -n, -origin) for (level, origin), (n, size) in votes.items()), default=None)
        earlier = [o[1] for o in own if o[0] == r[0] and o[1] < r[1]]
        out[r] = (-best[3] if best else max(earlier, default=None), sum(n for n, _ in votes.values()))
    return out


def test_nested_quotes_against_brute_force(spark):
    import random

    rng = random.Random(12)
    words = ["How", "do I", "Sort", "use  sorted", "then", "thanks", ""]
    rows = []
    for conv in range(25):
        said = []
        for turn in sorted(rng.sample(range(60), rng.randint(1, 9))):
            for _ in range(rng.choice([1, 1, 1, 2])):
                lines = []
                for _ in range(rng.randint(1, 6)):
                    if said and rng.random() < 0.6:
                        quoted = rng.choice(said).split("\n")
                        at = rng.randrange(len(quoted))
                        lines += [rng.choice(["> ", ">", " > "]) + x for x in quoted[at : at + rng.randint(1, 3)]]
                    lines.append(" ".join(rng.choice(words) for _ in range(rng.randint(0, 3))))
                text = "\n".join(lines)
                said.append(text)
                rows.append((conv, turn, rng.choice(["user", "assistant"]), text))
    rows += rows[:5]
    want = brute_replies(rows)
    got = C.chat_messages(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)).collect()
    assert {(r["conv_id"], r["turn"], r["role"], r["text"]): (r["reply_to"], r["n_linked"]) for r in got} == want
    assert len(got) == len(want) and sum(n > 0 for _, n in want.values()) > 40


def test_the_message_before_and_long_conversations(spark, monkeypatch):
    rows = [(1, t, "user", f"m{t}") for t in (0, 5, 9)] + [(2, t, "user", f"n{t}") for t in range(130)] + [(None, None, "user", f"x{k}") for k in range(20)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    for block in (C.TURN_BLOCK, 4):
        monkeypatch.setattr(C, "TURN_BLOCK", block)
        got = {r["conv_id"]: r for r in C.chat_format(df).collect()}
        assert got[1]["replies"] == "-,0,5" and got[2]["replies"] == ",".join(["-", *map(str, range(129))]) and len(got) == 3
    parts = C.chat_format(df, part_bytes=500).filter("conv_id = 2").orderBy("part").collect()
    assert len(parts) > 3 and sum(r["n_messages"] for r in parts) == 130 and ",".join(r["replies"] for r in parts) == got[2]["replies"]
    assert sum(r["n_messages"] for r in C.chat_format(df, part_bytes=100).filter("conv_id is null").collect()) == 20


def test_long_messages_take_time_in_proportion(spark):
    import time

    def took(n):
        df = spark.createDataFrame([(1, 0, "user", "\n".join(f"line {i}" for i in range(n))), (1, 1, "user", "\n".join(f"> line {i}" for i in range(n)))], "conv_id bigint, turn bigint, role string, text string")
        began = time.time()
        assert C.chat_messages(df).filter("turn = 1").first()["n_linked"] == n + 1
        return time.time() - began

    took(10)
    assert took(16_000) < 8 * took(4_000) + 2
