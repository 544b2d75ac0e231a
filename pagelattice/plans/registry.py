"""Named queries of the layout engine, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice.functions import expansion as E
from pagelattice.functions import hints as H
from pagelattice.functions import text as X
from pagelattice.operators import candidates, classify, extraction, graph, learning, matching, sessions, style, tables, tokenize
from pagelattice.plans import oracles
from pagelattice.sources import adapters as A
from pagelattice.streaming import learner

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def kv(s: SparkSession, d: str) -> DataFrame:
    return A.kv_form(s, d)


def grid(s: SparkSession, d: str) -> DataFrame:
    return A.order_grid(s, d)


def form(s: SparkSession, d: str) -> DataFrame:
    return A.order_form(s, d)


def pages(s: SparkSession, d: str) -> DataFrame:
    """The forms with their graphs, tables and roles."""
    return classify.pages(form(s, d))


def kv_fields(s: SparkSession) -> DataFrame:
    return A.fields_frame(s, "customer_form", A.KV_FIELDS)


def _files(s, d):
    return A.table(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("/in/"), (F.col("o_orderkey") % 40).cast("string"), F.lit(".pdf")).alias("path"))


def _entries(s, d):
    """Two entries for each nation's file; the first by order counts."""
    n = A.table(s, d, "nation")
    field = F.array(F.struct(F.lower("n_name").alias("key"), F.lit("the nation").alias("value")))
    one = lambda k: n.select((F.col("n_nationkey") * 2 + k).cast("bigint").alias("ord"), F.concat(F.lit(f"label{k}_"), (F.col("n_nationkey") % 4).cast("string")).alias("label"), F.concat(F.col("n_nationkey").cast("string"), F.lit(".pdf")).alias("pdf_path"), field.alias("fields"))
    return one(0).unionByName(one(1))


def _shown(df):
    return df.select("doc_id", "label", F.array_join(F.transform("fields", lambda x: F.concat_ws("=", x["key"], x["value"])), ";").alias("fields"))


@query
def a_schema_lookup(s, d):
    return _shown(A.with_schema(_files(s, d), _entries(s, d)))


@query
def a_label_filter(s, d):
    return _shown(A.with_schema(_files(s, d), _entries(s, d), "label0_2"))


@query
def a_spans(s, d):
    t = A.spans_to_tokens(A.order_spans(s, d))
    return t.select("doc_id", "token_id", "text", "bold", "italic", "color", *[F.round(c, 9).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query
def c_token_predicates(s, d):
    t = kv(s, d).select("doc_id", "token_id", "text").unionByName(A.text_lines(s, d))
    c = F.col("text")
    return t.select(
        "doc_id",
        "token_id",
        X.ends_with_colon(c).alias("ends_colon"),
        X.colon_in_middle(c).alias("colon_inside"),
        X.is_date(c).alias("is_date"),
        X.is_code(c).alias("is_code"),
        X.is_number(c).alias("is_number"),
        X.is_text_only(c).alias("is_text"),
        X.ends_with_separator(c).alias("ends_separator"),
    )


@query
def c_ascii_norm(s, d):
    return A.text_lines(s, d).select("doc_id", "token_id", F.md5(X.ascii_norm(F.col("text"))).alias("norm"))


@query
def c_accent_norm(s, d):
    return A.text_lines(s, d).select("doc_id", "token_id", F.md5(X.accent_norm(F.col("text"))).alias("norm"))


@query
def c_keyword_sets(s, d):
    return A.text_lines(s, d).select("doc_id", "token_id", F.array_join(F.array_sort(X.keywords(F.col("text"))), " ").alias("keywords"))


@query
def c_label_score(s, d):
    a = A.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("a"), F.col("p_type").alias("b"))
    return a.select("id", F.round(X.label_score(F.col("a"), F.col("b"), 0.0), 6).alias("score"))


@query
def c_multi_value(s, d):
    li = A.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws(" - ", A.money(F.col("l_extendedprice")), F.col("l_quantity").cast("decimal(12,2)").cast("string"), F.col("l_discount").cast("decimal(12,2)").cast("string")).alias("t"))
    return li.select("l_orderkey", "l_linenumber", X.multi_value(F.col("t")).alias("multi"), F.size(X.individual_values(F.col("t"))).alias("n_values"))


@query
def c_search_texts(s, d):
    t = A.text_lines(s, d)
    c = F.col("text")
    return t.select("doc_id", "token_id", X.contains_any(c, ["tion", "ÑAND"]).alias("has"), F.md5(X.first_line(F.concat(F.lit(" "), c, F.lit(" \nnext")))).alias("first_line"))


@query
def c_after_label(s, d):
    t = A.table(s, d, "customer").select("c_custkey", F.concat(F.lit("Account Holder : "), F.col("c_name"), F.lit(" of "), F.col("c_mktsegment")).alias("t"))
    return t.select("c_custkey", X.after_label(F.col("t"), ["holder", "account holder", "absent"]).alias("rest"), X.after_label(F.col("t"), ["absent"]).alias("nothing"))


@query
def c_caps_spacing(s, d):
    t = A.text_lines(s, d)
    return t.select("doc_id", "token_id", F.round(X.caps_ratio(F.col("text")), 9).alias("caps"), F.round(X.letter_spacing(F.col("text"), F.lit(0.5)), 9).alias("spacing"))


@query
def c_truncated(s, d):
    return A.text_lines(s, d).select("doc_id", "token_id", F.md5(X.truncated(F.col("text"), 40)).alias("short"))


@query
def c_distance(s, d):
    t = form(s, d)
    center = lambda a, b: (F.col(a) + F.col(b)) / 2
    return t.select("doc_id", "token_id", F.round(X.center_distance(center("x0", "x1"), center("y0", "y1"), F.lit(0.1), F.lit(0.9)), 9).alias("far"))


@query
def c_whitish(s, d):
    color = F.concat(F.lit("#"), F.lower(F.lpad(F.hex(F.lit(16711680) + F.col("c_custkey") * 977 % 65536), 6, "0")))
    c = A.table(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 10 == 0, "white").otherwise(color).alias("color"))
    return c.select("c_custkey", "color", X.is_whitish(F.col("color")).alias("white"))


@query
def c_run_id(s, d):
    o = A.table(s, d, "orders")
    return o.select("o_orderkey", X.run_id(F.col("o_orderdate"), F.concat(F.lit("/in/page."), F.col("o_orderkey").cast("string"), F.lit(".pdf"))).alias("run"))


@query
def b_colon_split(s, d):
    t = A.table(s, d, "customer").select(
        F.col("c_custkey").cast("bigint").alias("doc_id"), F.lit(0).alias("token_id"), F.concat_ws(" ", F.lit("Holder:"), F.col("c_name")).alias("text"),
        F.lit(0.1).alias("x0"), F.lit(0.1).alias("y0"), F.lit(0.5).alias("x1"), F.lit(0.12).alias("y1"),
    )
    return tokenize.colon_split(t).select("doc_id", "part", "text", "role", "separated_pair", F.round("x0", 9).alias("x0"), F.round("x1", 9).alias("x1"))


def _boxed(rows, text):
    """Rows as tokens of one box each."""
    box = [F.lit(v).alias(c) for c, v in (("x0", 0.1), ("y0", 0.1), ("x1", 0.9), ("y1", 0.14))]
    return rows.select(F.col("c_custkey").cast("bigint").alias("doc_id"), F.lit(0).alias("token_id"), F.lit(0).alias("ord"), text.alias("text"), *box)


def _parts(s, d, text):
    cols = [F.round(c, 9).alias(c) for c in ("x0", "y0", "x1", "y1")]
    return tokenize.split_tokens(_boxed(A.table(s, d, "customer"), text)).select("doc_id", "part", "text", "role", "separated_pair", *cols)


@query
def b_multi_colon(s, d):
    return _parts(s, d, F.concat(F.lit("Holder: "), F.col("c_name"), F.lit(" Segment: "), F.col("c_mktsegment"), F.lit(" U.F .: "), F.col("c_nationkey").cast("string")))


@query
def b_newline_split(s, d):
    key = F.col("c_custkey") % 3
    return _parts(s, d, F.when(key == 0, F.concat(F.lit("Holder:\n"), F.col("c_name"))).when(key == 1, F.concat(F.lit("Holder\n"), F.col("c_name"))).otherwise(F.concat(F.lit("Holder: "), F.col("c_name"))))


def _wrapped(s, d):
    """Three spans a customer: one that goes on in the next, or overlaps it, by key, and a third apart."""
    c = A.table(s, d, "customer")
    key = F.col("c_custkey")
    span = lambda k, text, x0, y0, x1, y1: F.struct(
        F.lit(k).alias("token_id"), text.alias("text"), F.lit(x0).alias("x0"), y0.alias("y0"), F.lit(x1).alias("x1"), y1.alias("y1")
    )
    second = F.when(key % 3 == 0, 0.112).when(key % 3 == 1, 0.101).otherwise(0.13)
    first = F.when(key % 2 == 0, F.lit("Telefone da")).otherwise(F.lit("Telefone"))
    spans = [span(0, first, 0.1, F.lit(0.1), 0.3, F.lit(0.12)), span(1, F.col("c_mktsegment"), 0.1, second, 0.3, second + 0.02), span(2, F.col("c_name"), 0.5, F.lit(0.1), 0.7, F.lit(0.12))]
    return c.select(key.cast("bigint").alias("doc_id"), F.inline(F.array(*spans))).withColumn("ord", F.col("token_id"))


@query
def b_merged(s, d):
    return tokenize.merged(_wrapped(s, d)).select("doc_id", "token_id", "ord", "text", *[F.round(c, 9).alias(c) for c in ("y0", "y1")])


@query
def d_lines(s, d):
    return graph.lines(grid(s, d)).select("doc_id", "token_id", "line")


@query
def d_east_edges(s, d):
    return graph.east_edges(graph.lines(kv(s, d))).unionByName(graph.east_edges(graph.lines(grid(s, d))).withColumn("doc_id", -F.col("doc_id")))


@query
def d_spacing(s, d):
    return graph.spacing_limit(graph.lines(grid(s, d))).select("doc_id", F.round("spacing", 9).alias("spacing"))


@query
def d_south_edges(s, d):
    return graph.south_edges(graph.lines(grid(s, d)))


@query
def e_degree(s, d):
    t = kv(s, d)
    return graph.degree(t, graph.edges(graph.lines(t)))


@query
def e_neighbours(s, d):
    return graph.neighbours(graph.edges(graph.lines(kv(s, d)))).groupBy("relation").agg(F.count("*").alias("n"), F.sum(F.col("to_id") - F.col("from_id")).alias("steps"))


@query
def e_label_value(s, d):
    f = classify.part(classify.pages(kv(s, d)), "facts")
    return f.select("doc_id", "token_id", F.coalesce("value_text", "text").alias("value"))


@query
def e_label_of(s, d):
    t = kv(s, d).withColumn("role", F.when(F.col("token_id") % 2 == 0, "LABEL").otherwise("VALUE"))
    f = classify.part(classify.ruled(t, []), "facts").filter("label_id is not null")
    return f.select("doc_id", "token_id", "label_id", F.concat_ws(" ", F.regexp_replace("label_text", r"\s*:$", ""), "text").alias("both"))


@query
def e_removed(s, d):
    t = kv(s, d)
    e = graph.edges(graph.lines(t))
    return graph.removed(e, e.filter("relation = 'south' and from_id % 4 = 0").select("doc_id", "from_id", "to_id", "relation")).select("doc_id", "from_id", "to_id", "relation")


@query
def e_paths(s, d):
    """Everything below each label of a form, from the top: a label leads to its value and the labels under it."""
    ruled = classify.ruled(kv(s, d).withColumn("role", F.when(F.col("token_id") % 2 == 0, "HEADER").otherwise("VALUE")), [])
    f = classify.part(ruled, "facts").filter("role = 'HEADER'")
    return f.select("doc_id", "token_id", F.explode("paths").alias("p")).select("doc_id", "token_id", F.array_join("p", ">").alias("path"))


@query
def e_prefixes(s, d):
    ruled = classify.ruled(kv(s, d).withColumn("role", F.lit("LABEL")), [])
    f = classify.part(ruled, "facts")
    return f.select("doc_id", "token_id", F.explode(graph.prefixes(F.concat(F.array("text"), "below"))).alias("string"))


@query
def f_corners(s, d):
    return graph.oriented_corners(graph.edges(graph.lines(grid(s, d))))


@query
def f_tables(s, d):
    return classify.part(classify.pages(kv(s, d)), "cells")


@query
def f_form_tables(s, d):
    return classify.part(pages(s, d), "cells")


@query
def f_grid_tables(s, d):
    return classify.part(classify.pages(grid(s, d)), "cells").groupBy("doc_id", "orientation").agg(F.countDistinct("table_id").alias("n_tables"), F.count("*").alias("n_cells"), F.max("col").alias("last_col"))


@query
def f_cells(s, d):
    cells = classify.part(pages(s, d), "cells")
    return tables.cell_at(cells, 1, 1).select("doc_id", "token_id").unionByName(tables.row_of(tables.column_of(cells, 2), 0).select("doc_id", F.col("token_id")))


@query
def f_aligned(s, d):
    return tables.aligned_tables(form(s, d))


@query
def f_roles(s, d):
    return classify.part(classify.pages(kv(s, d)), "facts").select("doc_id", "token_id", "role")


def _stacked(s, d):
    """Two columns of labels with their values below: a vertical table whose rows alternate."""
    c = A.table(s, d, "customer").join(A.table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    plain = F.col("c_custkey") % 2 == 0
    cell = lambda k, text: F.struct(
        F.lit(k).alias("token_id"), text.alias("text"), F.lit(0.1 + 0.3 * (k % 2)).alias("x0"), F.lit(0.1 + 0.04 * (k // 2)).alias("y0"), F.lit(0.25 + 0.3 * (k % 2)).alias("x1"), F.lit(0.12 + 0.04 * (k // 2)).alias("y1")
    )
    words = [F.when(plain, "Produto").otherwise("Holder"), F.when(plain, "Sistema").otherwise("Owner:"), F.col("c_mktsegment"), F.col("n_name"), F.lit("Grupo:"), F.lit("Area:"), F.col("c_name"), F.col("n_nationkey").cast("string")]
    return c.select(F.col("c_custkey").cast("bigint").alias("doc_id"), F.inline(F.array(*[cell(k, t) for k, t in enumerate(words)]))).withColumn("ord", F.col("token_id"))


@query
def f_label_columns(s, d):
    return classify.part(classify.pages(_stacked(s, d), rules=[]), "facts").select("doc_id", "token_id", "role")


def _seeded(s, d):
    """The forms with roles that depend on page and token, and nothing else."""
    k = (F.col("token_id") * 7 + F.col("doc_id") * 3) % 4
    return form(s, d).withColumn("role", F.when(k == 0, "LABEL").when(k == 1, "VALUE").when(k == 2, "HEADER"))


def _after(s, d, *rules, tokens=None):
    f = classify.part(classify.ruled(_seeded(s, d) if tokens is None else tokens, list(rules)), "facts")
    return f.select("doc_id", "token_id", "role")


@query
def g_initial_label(s, d):
    return _after(s, d, "initial_label")


@query
def g_initial_value(s, d):
    return _after(s, d, "initial_label", "initial_value", tokens=form(s, d))


@query
def g_initial_header(s, d):
    return _after(s, d, "initial_label", "initial_value", "initial_header", tokens=form(s, d).withColumn("color", F.when(F.col("token_id") == 13, "#fefefe")))


@query
def g_separated_pairs(s, d):
    t = kv(s, d).withColumns({"separated_pair": F.col("token_id") < 4, "role": F.when(F.col("token_id") % 2 == 0, "LABEL").otherwise("VALUE")})
    return classify.part(classify.ruled(t, ["separated_pair_isolation"]), "edges").select("doc_id", "from_id", "to_id", "relation")


@query
def g_label_only(s, d):
    return _after(s, d, "label_only_connections", tokens=form(s, d).withColumn("role", F.when(F.col("token_id").isin(7, 8, 10, 11), "LABEL").when(F.col("token_id") == 12, "VALUE")))


@query
def g_header_preserve(s, d):
    return _after(s, d, "header_preservation", tokens=_seeded(s, d).withColumn("font_size", F.when(F.col("token_id").isin(0, 1), 15.0).when(F.col("token_id") == 2, 11.0).otherwise(10.0)))


@query
def g_value_label(s, d):
    return _after(s, d, "value_label_uniqueness", tokens=form(s, d).withColumn("role", F.when(F.col("token_id").isin(4, 11), "VALUE")))


@query
def g_typographic(s, d):
    return _after(s, d, "typographic_hierarchy", tokens=form(s, d).withColumn("role", F.when(F.col("token_id").isin(1, 7, 13), "LABEL").when(F.col("token_id").isin(5, 10), "VALUE")))


@query
def g_code_label(s, d):
    return _after(s, d, "numeric_code_label", tokens=form(s, d))


@query
def g_date_cleanup(s, d):
    return _after(s, d, "date_label_cleanup", tokens=_seeded(s, d).withColumn("text", F.when(F.col("token_id") == 1, "Date").otherwise(F.col("text"))))


@query
def g_label_no_edges(s, d):
    return _after(s, d, "label_without_edges")


@query
def g_isolated(s, d):
    return _after(s, d, "isolated_short_text_header")


@query
def g_label_guarantee(s, d):
    return _after(s, d, "value_label_guarantee", tokens=form(s, d).withColumn("role", F.when(F.col("token_id") == 11, "VALUE")))


@query
def g_colon_chain(s, d):
    t = kv(s, d).withColumn("text", F.when((F.col("token_id") == 1) & (F.col("doc_id") % 2 == 0), F.concat("text", F.lit(":"))).otherwise(F.col("text")))
    return _after(s, d, "colon_recursive", tokens=t)


@query
def g_header_no_north(s, d):
    return _after(s, d, "header_no_north", tokens=form(s, d).withColumn("role", F.when(F.col("token_id") >= 7, "HEADER")))


@query
def g_value_no_label(s, d):
    return _after(s, d, "value_no_label_connections", tokens=form(s, d).withColumn("role", F.when(F.col("token_id").isin(1, 7), "VALUE").otherwise("LABEL")))


@query
def g_must_have_label(s, d):
    return _after(s, d, "value_must_have_label", tokens=form(s, d).withColumn("role", F.when(F.col("token_id") == 14, "VALUE").when((F.col("token_id") == 7) & (F.col("doc_id") % 2 == 0), "LABEL")))


@query
def g_single_value(s, d):
    role = F.when(F.col("token_id").isin(0, 4), "LABEL").otherwise("VALUE")
    return classify.part(classify.ruled(kv(s, d).withColumn("role", role), ["label_single_value"]), "edges").select("doc_id", "from_id", "to_id", "relation")


@query
def g_adjacent_headers(s, d):
    return _after(s, d, "adjacent_headers", tokens=form(s, d).withColumn("role", F.when(F.col("token_id").isin(7, 10, 13, 15), "HEADER").when(F.col("token_id") == 8, "LABEL")))


@query
def g_header_edges(s, d):
    t = form(s, d).withColumn("role", F.when(F.col("token_id").isin(8, 9, 11, 12), "HEADER").otherwise("VALUE"))
    return classify.part(classify.ruled(t, ["header_no_north_west"]), "edges").select("doc_id", "from_id", "to_id", "relation")


@query
def g_classified(s, d):
    return classify.part(pages(s, d), "facts").select("doc_id", "token_id", "role", "source")


def _hint_query(h: H.Hint):
    def run(s, d):
        t = A.text_lines(s, d).unionByName(kv(s, d).select("doc_id", "token_id", "text")).unionByName(A.typed_texts(s, d))
        return t.filter(h.detect(F.col("text"))).select("doc_id", "token_id", F.md5(F.coalesce(h.extract(F.col("text")), F.lit(""))).alias("extracted"))

    return run


for _h in H.HINTS:
    QUERIES[f"h_{_h.name}"] = _hint_query(_h)


@query
def h_aggregate(s, d):
    li = A.table(s, d, "lineitem")
    price = F.concat(F.lit("R$ "), F.col("l_quantity").cast("decimal(12,2)").cast("string"))
    odd = F.when((F.col("l_orderkey") % 3 == 0) & (F.col("l_linenumber") == 1), F.lit("none")).otherwise(price)
    li = li.orderBy("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice").select("l_orderkey", price.alias("price"), odd.alias("odd"), F.col("l_returnflag").alias("flag"))
    out = li.groupBy("l_orderkey").agg(
        H.aggregated(F.col("price"), "sum").cast("double").alias("total"),
        H.aggregated(F.col("odd"), "sum").alias("mixed"),
        F.length(H.aggregated(F.col("flag"), "list")).alias("listed"),
        F.length(H.aggregated(F.col("flag"), "concatenate")).alias("joined"),
        F.count("flag").alias("n"),
    )
    return out.select("l_orderkey", F.round("total", 2).alias("total"), F.col("mixed").contains("none").alias("mixed"), "listed", "joined", "n")


@query
def i_word_overlap(s, d):
    return matching.word_overlap(kv(s, d), kv_fields(s))


@query
def i_regex_perfect(s, d):
    return matching.regex_perfect(kv(s, d), kv_fields(s))


@query
def i_regex_partial(s, d):
    f = A.fields_frame(s, "x", (("nat", "nation"), ("bal", "balance sheet"), ("holder_ref", "customer")))
    out = matching.regex_partial(kv(s, d), f)
    return out.select("doc_id", "field", "token_id", F.round("score", 6).alias("score"))


@query
def i_pattern(s, d):
    t = kv(s, d).withColumn("role", F.when(F.col("token_id") % 2 == 0, "LABEL").otherwise("VALUE"))
    return matching.pattern_matches(t, "balance", "balance of the account")


@query
def i_embedding_topk(s, d):
    v = A.table(s, d, "embeddings")
    return matching.embedding_topk(v, v.filter("vec_id % 100 = 0"))


@query
def j_type_classifier(s, d):
    v = A.table(s, d, "embeddings")
    parts = v.select(F.concat(F.lit("k"), F.col("label").cast("string")).alias("kind"), F.posexplode("embedding").alias("p", "x"))
    means = parts.groupBy("kind", "p").agg(F.avg(F.col("x").cast("double")).alias("m"))
    vectors = means.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("p", "m"))).alias("a")).select("kind", F.transform("a", lambda z: z["m"]).alias("raw"))
    norm = F.sqrt(F.aggregate(F.transform("raw", lambda x: x * x), F.lit(0.0), lambda a, b: a + b))
    protos = vectors.withColumn("norm", norm).select("kind", F.expr("transform(raw, x -> x / norm)").alias("prototype"))
    return matching.type_classifier(v, protos).select("vec_id", "kind", F.round("similarity", 5).alias("similarity"))


@query
def i_label_pattern(s, d):
    f = classify.part(classify.pages(kv(s, d)), "facts").select("doc_id", "token_id", "role", "text", F.col("label_text").alias("label"))
    return matching.label_pattern_matches(f, "balance", "balance of the account")


@query
def i_names(s, d):
    t = A.text_lines(s, d).unionByName(A.typed_texts(s, d))
    return matching.names(t).select("doc_id", "token_id", extraction.name_points(F.col("text")).alias("points"))


def _described(s, d):
    """Descriptions of fields made of the tables' words."""
    p = A.table(s, d, "part")
    ends = F.element_at(F.array(*[F.lit(x) for x in ("vencimento", "emissão", "telefone de contato", "valor da parcela", "refinanciamento mensal")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return p.select(F.col("p_partkey").alias("id"), F.concat_ws("_", F.lit("data"), F.lower("p_type")).alias("name"), F.concat_ws(" ", F.lit("Data de"), ends, F.col("p_name")).alias("description"))


@query
def j_keywords(s, d):
    return _described(s, d).select("id", F.array_join(E.keywords(F.col("description")), " ").alias("words"))


@query
def j_synonyms(s, d):
    return _described(s, d).select("id", F.array_join(E.synonyms(E.keywords(F.col("description"))), " ").alias("words"))


@query
def j_expanded_query(s, d):
    return _described(s, d).select("id", E.expanded_query(F.col("name"), F.col("description")).alias("query"))


@query
def j_boost(s, d):
    label = F.element_at(F.array(*[F.lit(x) for x in ("Dt. vcto", "Tel", "Valor base", "Data de emissão", "other")]), (F.col("id") % 5 + 1).cast("int"))
    return _described(s, d).select("id", F.round(E.boost(label, E.boost_words(F.col("description"))), 6).alias("boost"))


@query
def k_heuristic(s, d):
    f = classify.part(classify.pages(kv(s, d)), "facts")
    center = lambda a, b: (F.col(a) + F.col(b)) / 2
    score = matching.heuristic_score(F.col("role"), F.col("header_alone"), center("x0", "x1"), center("y0", "y1"), F.length("text"), F.col("label_far"))
    return f.select("doc_id", "token_id", F.round(score, 6).alias("score"))


@query
def k_tied(s, d):
    m = matching.regex_partial(form(s, d), A.fields_frame(s, "x", (("x", "status nation priority notes total"),)))
    return matching.tied(m, 0.05).select("doc_id", "token_id", F.round("score", 6).alias("score"))


@query
def l_quality_gate(s, d):
    f = classify.part(classify.ruled(form(s, d), []), "facts")
    return f.select("doc_id", "token_id", matching.quality_gate(F.col("text"), F.col("degree")).alias("good"))


@query
def l_type_gate(s, d):
    t = kv(s, d).select("doc_id", "token_id", "text").unionByName(A.typed_texts(s, d))
    kinds = ("date", "money", "phone", "email", "cpf_cnpj", "number")
    return t.select("doc_id", "token_id", *[matching.type_gate(F.col("text"), F.lit(k)).alias(k) for k in kinds])


@query
def l_extract(s, d):
    return extraction.extract(kv(s, d), list(A.KV_FIELDS)).select("doc_id", "field", "value", "strategy")


@query
def l_extract_orders(s, d):
    return extraction.extract(form(s, d), list(A.ORDER_FIELDS)).select("doc_id", "field", "value", "strategy", "used")


#: Fields that only later stages of the cascade can fill.
LATER_FIELDS = (("nome_cliente", "nome completo"), ("valor", "valor a pagar"), ("vencimento", "data limite"), ("telefone", "telefone de contato"))


@query
def l_extract_later(s, d):
    return extraction.extract(form(s, d), list(LATER_FIELDS)).select("doc_id", "field", "value", "strategy")


@query
def l_extract_vectors(s, d):
    from pagelattice.functions.vectors import trigram_vectors

    return extraction.extract(form(s, d), [("situation", "statuses"), ("rank", "prioritys of it")], embed=trigram_vectors()).select("doc_id", "field", "value", "strategy", F.round("score", 6).alias("score"))


@query
def l_metadata(s, d):
    out = extraction.results(extraction.extract(kv(s, d), list(A.KV_FIELDS)))
    return out.select("doc_id", "total_fields", "extracted_fields", F.round("success_rate", 6).alias("success_rate"), F.array_join("nodes_used", ",").alias("nodes"), F.array_join("rules_used", ",").alias("rules"))


@query
def l_occurrences(s, d):
    log = extraction.occurrences(extraction.extract(form(s, d), list(A.ORDER_FIELDS)), "order")
    return learning.found_rate(log).withColumn("found_rate", F.round("found_rate", 6))


@query
def m_found_rate(s, d):
    return learning.found_rate(A.occurrences(s, d)).withColumn("found_rate", F.round("found_rate", 6))


@query
def m_position(s, d):
    p = learning.positions(A.occurrences(s, d))
    return p.select("label_type", "field_name", "n_placed", *[F.round(c, 6).alias(c) for c in ("mean_x", "mean_y", "std_x", "std_y")])


@query
def m_distributions(s, d):
    return learning.distribution(A.occurrences(s, d), "role").select("label_type", "field_name", "item", "n", F.round("share", 6).alias("share"))


@query
def m_rigidity(s, d):
    return learning.patterns(A.occurrences(s, d)).select("label_type", "field_name", F.round("rigidity", 6).alias("rigidity"))


@query
def m_report(s, d):
    r = learning.report(learning.patterns(A.occurrences(s, d)))
    return r.select("label_type", "field_name", "occurrence_count", F.round("found_rate", 6).alias("found_rate"), F.round("mean_x", 6).alias("mean_x"), "top_role", F.round("role_share", 6).alias("role_share"), "top_data_type", F.round("mean_c", 6).alias("mean_c"))


@query
def m_veto(s, d):
    log = A.occurrences(s, d)
    known = learning.patterns(log)
    return learning.vetoed(log, known).select("seq", "rejected")


@query
def m_stream(s, d):
    return learner.stream_rates(s, f"{d}/events.parquet").withColumn("found_rate", F.round("found_rate", 6))


@query
def n_style(s, d):
    font = F.when(F.col("token_id") % 3 == 0, "Arial").when(F.col("token_id") % 3 == 1, "Courier")
    t = form(s, d).withColumns({"font": font, "color": F.when(F.col("token_id") % 2 == 0, "#000000").when(F.col("token_id") % 7 == 0, "#202020"), "font_size": F.when(F.col("token_id") == 5, 0.0).otherwise(F.col("font_size"))})
    return style.signature(t)


@query
def n_line_index(s, d):
    return style.line_index(grid(s, d))


@query
def n_enriched(s, d):
    t = form(s, d)
    return style.enriched(t, classify.part(classify.ruled(t, []), "facts")).select("doc_id", "token_id", "degree", "line_index", "caps_bin")


@query
def n_counts(s, d):
    return style.page_counts(classify.pages(kv(s, d)))


def _blocks(s, d):
    return A.kv_form(s, d, spread=True).withColumnRenamed("token_id", "block_id")


def _labels(s, d):
    return candidates.label_blocks(_blocks(s, d), kv_fields(s))


@query
def o_label_blocks(s, d):
    return _labels(s, d).select("doc_id", "block_id", "field", F.round("score", 6).alias("score"))


@query
def o_label_priority(s, d):
    b = _blocks(s, d).withColumn("font_size", F.col("block_id") + 8.0)
    return candidates.label_priority(b, kv_fields(s)).select("doc_id", "block_id", "field", F.round("priority", 6).alias("priority"), "rank")


@query
def o_positions(s, d):
    hints = s.createDataFrame([("a", "Top-Left"), ("b", "bottom right"), ("c", "top right")], "field string, hint string")
    out = candidates.position_candidates(form(s, d).withColumnRenamed("token_id", "block_id"), hints)
    return out.select("doc_id", "field", "block_id", F.round("score", 6).alias("score"))


@query
def o_table_row(s, d):
    fields = A.fields_frame(s, "x", (("status", ""), ("priority", "")))
    t = form(s, d)
    labels = candidates.label_blocks(t.withColumnRenamed("token_id", "block_id"), fields, 0.9)
    return candidates.table_candidates(labels, classify.part(classify.pages(t), "cells")).select("doc_id", "field", "block_id", "relation")


@query
def o_same_block(s, d):
    b = A.table(s, d, "customer").select(F.col("c_custkey").cast("bigint").alias("doc_id"), F.lit(0).alias("block_id"), F.concat(F.lit("Holder\n"), F.col("c_name")).alias("text"))
    fields = A.fields_frame(s, "x", (("holder", ""),))
    return candidates.same_block_candidates(b, candidates.label_blocks(b, fields), fields).select("doc_id", "field", "block_id", "text")


@query
def o_forms(s, d):
    kinds = s.createDataFrame([("when", "date"), ("amount", "money"), ("id", "cpf"), ("state", "uf"), ("note", "text")], "field string, kind string")
    b = A.typed_texts(s, d).withColumnRenamed("token_id", "block_id")
    return candidates.form_candidates(b, kinds).select("doc_id", "field", "block_id")


@query
def o_enums(s, d):
    options = s.createDataFrame([("segment", "Automobíle"), ("segment", "building site"), ("region", "ásia"), ("region", "EUROPE")], "field string, option string")
    return candidates.enum_candidates(_blocks(s, d), options).select("doc_id", "field", "block_id")


@query
def o_footers(s, d):
    b = form(s, d).withColumnRenamed("token_id", "block_id")
    return candidates.repeated_blocks(b, 0.7).groupBy("block_id").agg(F.count("*").alias("n"))


@query
def o_text_window(s, d):
    li = A.table(s, d, "customer").select("c_custkey", F.concat(F.lit(" "), F.col("c_name"), F.lit(" \n"), F.col("c_mktsegment")).alias("t"))
    rel = F.element_at(F.array(*[F.lit(x) for x in ("same_block", "same_line", "table_row", "south_of", "semantic")]), (F.col("c_custkey") % 5 + 1).cast("int"))
    return li.select("c_custkey", candidates.text_window(F.col("t"), rel).alias("window"))


@query
def o_score_tuple(s, d):
    c = A.table(s, d, "customer").join(A.table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    pick = lambda n, *x: F.element_at(F.array(*[F.lit(v) for v in x]), (k % n + 1).cast("int"))
    parts = {
        "text": F.when(k % 2 == 0, A.money(F.col("c_acctbal"))).otherwise(F.col("c_mktsegment")),
        "kind": pick(3, "money", "text", "int"),
        "relation": pick(5, "semantic", "south_of", "same_block", "same_line", "table_row"),
        "label_font_z": F.lit(0.0),
        "font_z": (k % 4) / 4.0,
        "label_component": F.lit(1),
        "component": (k % 2).cast("int"),
        "memory": F.when(k % 3 == 0, "auto").when(k % 3 == 1, "hints"),
        "cosine": (k % 10) / 10.0,
    }
    return c.withColumn("t", candidates.score_tuple(parts)).select("c_custkey", "t.*")


@query
def o_candidates(s, d):
    found = candidates.spatial_candidates(_blocks(s, d), _labels(s, d))
    return candidates.distinct_candidates(found).select("doc_id", "field", "block_id", "relation", F.round("score", 6).alias("score"), F.round("far", 6).alias("far"))


@query
def o_pareto(s, d):
    found = candidates.spatial_candidates(_blocks(s, d), _labels(s, d))
    return candidates.pareto(found, ("score",), ("far",)).select("doc_id", "field", "block_id", "relation").distinct()


@query
def o_assign(s, d):
    found = candidates.spatial_candidates(_blocks(s, d), _labels(s, d))
    no = F.lit(False)
    score = candidates.adjusted_score(F.col("score") * 0.7, F.lit(True), no, no, F.col("relation") == "same_line", no)
    kind = F.when(F.col("field") == "balance", "money").otherwise("text")
    return candidates.assign(found.withColumns({"score": score, "kind": kind})).withColumn("score", F.round("score", 6))


@query
def o_match_fields(s, d):
    kinds = s.createDataFrame([(n, "money" if n == "balance" else "text") for n, _ in A.KV_FIELDS], "field string, kind string")
    return candidates.match_fields(_blocks(s, d), kv_fields(s), kinds).withColumn("score", F.round("score", 6))


@query
def p_search(s, d):
    m = A.table(s, d, "conversations").withColumn("title", F.concat(F.lit("Session "), F.col("conv_id").cast("string")))
    return sessions.search(m, "Thing").unionByName(sessions.search(m, "session 1"))


@query
def p_by_label(s, d):
    return sessions.by_label(A.table(s, d, "conversations"))


@query
def p_label_sessions(s, d):
    return sessions.label_sessions(A.table(s, d, "conversations"))


@query
def p_dedupe(s, d):
    return sessions.first_of_each(A.table(s, d, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role")


@query
def p_latest(s, d):
    return sessions.latest(A.table(s, d, "conversations"), "assistant").select("conv_id", "turn", F.md5("text").alias("text_md5"))


@query
def p_upsert(s, d):
    rows = A.table(s, d, "customer").select("c_custkey", "c_mktsegment")
    changes = A.table(s, d, "supplier").select((F.col("s_suppkey") * 3).alias("c_custkey"), F.lit("CHANGED").alias("c_mktsegment"), (F.col("s_suppkey") % 2 == 0).alias("deleted"))
    return sessions.upserted(rows, changes, "c_custkey")


@query
def p_store(s, d):
    e = A.table(s, d, "events").select("event_id", "user_id", "value", (F.col("event_type") == "error").alias("deleted"))
    return sessions.replayed(e, "user_id", "event_id")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five fields of every customer form."""
    return l_extract(spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return oracles.sql()
