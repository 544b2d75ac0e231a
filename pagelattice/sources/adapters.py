"""Token tables made of relational rows, and readers of token inputs.

Coordinates are whole thousandths over 1000.0, so that any engine gets the same
doubles. Each adapter is a scan with a generator: no shuffle but for the joins
that its source needs, or where asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelattice.functions import text as X

KV_LABELS = ("Holder:", "Segment:", "Nation:", "Region:", "Balance:")
KV_FIELDS = (
    ("holder", "holder"),
    ("segment", "segment"),
    ("nation", "nation"),
    ("region", "region"),
    ("balance", "balance"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _token(token_id: int, text: Column, x0: int, x1: int, y0: int) -> Column:
    at = lambda n: F.lit(n) / F.lit(1000.0)
    return F.struct(
        F.lit(token_id).alias("token_id"), text.alias("text"), at(x0).alias("x0"), at(y0).alias("y0"), at(x1).alias("x1"), at(y0 + 20).alias("y1")
    )


def money(amount: Column) -> Column:
    return F.concat(F.lit("$ "), amount.cast("decimal(12,2)").cast("string"))


def kv_form(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """A form page of five labelled values for each customer.

    spread: customers are dealt out by page before their tokens are made, so that
    work on tokens does not hang on how the file is cut, and pages need no later shuffle.
    """
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    values = [F.col("c_name"), F.col("c_mktsegment"), F.col("n_name"), F.col("r_name"), money(F.col("c_acctbal"))]
    tokens = []
    for i, (label, value) in enumerate(zip(KV_LABELS, values, strict=True)):
        tokens += [_token(2 * i, F.lit(label), 50, 200, 100 + 50 * i), _token(2 * i + 1, value, 250, 600, 100 + 50 * i)]
    rows = rows.withColumn("doc_id", F.col("c_custkey").cast("bigint"))
    rows = rows.repartition("doc_id") if spread else rows
    return rows.select("doc_id", F.inline(F.array(*tokens))).withColumn("ord", F.col("token_id"))


def order_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid page for each order: a header row, then a row for each of its lines, by number and values."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag"))
    li = table(spark, sf_dir, "lineitem").withColumn("place", place)
    cells = [
        F.col("l_linenumber").cast("string"),
        F.col("l_quantity").cast("decimal(12,2)").cast("string"),
        F.col("l_extendedprice").cast("decimal(12,2)").cast("string"),
        F.col("l_returnflag"),
    ]
    line = F.col("place")
    at = lambda x: (x / F.lit(1000.0))

    def cell(k: int, text: Column, row: Column) -> Column:
        y = row * 40 + 100
        return F.struct(
            (row * 4 + k).alias("token_id"), text.alias("text"), at(F.lit(50 + 200 * k)).alias("x0"), at(y).alias("y0"), at(F.lit(150 + 200 * k)).alias("x1"), at(y + 20).alias("y1")
        )

    body = li.select(F.col("l_orderkey").cast("bigint").alias("doc_id"), F.inline(F.array(*[cell(k, c, line) for k, c in enumerate(cells)])))
    heads = li.select(F.col("l_orderkey").cast("bigint").alias("doc_id")).distinct()
    names = [F.lit(x) for x in ("Line", "Quantity", "Price", "Flag")]
    head = heads.select("doc_id", F.inline(F.array(*[cell(k, c, F.lit(0)) for k, c in enumerate(names)])))
    return head.unionByName(body).withColumn("ord", F.col("token_id"))


#: Tokens of an order's form: text, x0, x1, y0 in thousandths, and the orders that have it, by key modulo 12.
FORM_ROWS = (
    ("title", 50, 400, 20),
    ("Date:", 50, 150, 100),
    ("date", 200, 320, 100),
    ("Total", 500, 620, 100),
    ("total", 500, 640, 135),
    ("Holder:", 50, 150, 160),
    ("holder", 200, 420, 160),
    ("Status", 50, 150, 240),
    ("Priority", 250, 370, 240),
    ("Nation", 450, 550, 240),
    ("status", 50, 150, 270),
    ("priority", 250, 370, 270),
    ("nation", 450, 550, 270),
    ("Ref", 50, 110, 400),
    ("code", 130, 260, 400),
    ("Notes", 50, 150, 600),
)
#: Tokens that orders lack whose key modulo the first number is the second.
FORM_GAPS = {"holder": (4, 0), "Nation": (3, 0), "nation": (3, 0), "Notes": (2, 1), "Total": (6, 5), "Date:": (5, 4)}
#: Orders of these keys modulo SHIFT have all tokens below the title lower by their rest.
SHIFT = 7


def form_texts(c) -> dict[str, Column]:
    """Texts of a form's cells that vary."""
    return {
        "title": F.concat(F.lit("Order "), c("o_orderkey").cast("string")),
        "date": F.date_format(c("o_orderdate"), "dd/MM/yyyy"),
        "total": money(c("o_totalprice")),
        "holder": c("c_name"),
        "status": c("o_orderstatus"),
        "priority": c("o_orderpriority"),
        "nation": c("n_name"),
        "code": F.concat(F.lit("45-"), c("o_orderkey").cast("string")),
    }


def order_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A form page for each order; what it holds and where depends on its key."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    key, texts = F.col("o_orderkey"), form_texts(F.col)
    at = lambda x: x / F.lit(1000.0)
    cells = []
    for i, (text, x0, x1, y0) in enumerate(FORM_ROWS):
        y = F.lit(y0) + (F.lit(0) if text == "title" else key % SHIFT)
        gap = F.lit(True) if text not in FORM_GAPS else key % FORM_GAPS[text][0] != FORM_GAPS[text][1]
        cell = F.struct(
            F.lit(i).alias("token_id"), texts.get(text, F.lit(text)).alias("text"), at(F.lit(x0)).alias("x0"), at(y).alias("y0"), at(F.lit(x1)).alias("x1"), at(y + 20).alias("y1"),
            F.lit(16.0 if text == "title" else 10.0).alias("font_size"), F.lit(text == "title").alias("bold"),
        )
        cells.append(F.when(gap, cell))
    return rows.select(key.cast("bigint").alias("doc_id"), F.inline(F.array_compact(F.array(*cells)))).withColumn("ord", F.col("token_id"))


ORDER_FIELDS = (
    ("date", "date of the order"),
    ("holder", "holder"),
    ("total_value", "total value"),
    ("priority", "priority"),
    ("nation", "nation"),
    ("ref", "ref"),
    ("remarks", "remarks of the order"),
)


def typed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, token_id, text: dates of orders in three spellings, phones, tax numbers and postal addresses made of customers' keys."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    digits = lambda n: F.lpad((key * 7919 + 13).cast("string"), n, "4")
    day = F.col("o_orderdate")
    dates = o.select(
        F.col("o_orderkey").cast("bigint").alias("doc_id"),
        F.posexplode(F.array(F.date_format(day, "dd/MM/yyyy"), F.concat(F.lit("on "), F.date_format(day, "yyyy-MM-dd")), F.date_format(day, "d 'jan' yyyy"))).alias("token_id", "text"),
    )
    d11, d14, d8 = digits(11), digits(14), digits(8)
    part = lambda d, a, n: F.substring(d, a, n)
    made = F.array(
        F.concat(F.lit("("), part(d11, 1, 2), F.lit(") "), part(d11, 3, 5), F.lit("-"), part(d11, 8, 4)),
        F.concat(part(d11, 1, 3), F.lit("."), part(d11, 4, 3), F.lit("."), part(d11, 7, 3), F.lit("-"), part(d11, 10, 2)),
        d14,
        F.concat(F.lit("Rua "), F.col("c_name"), F.lit(", "), part(d8, 1, 5), F.lit("-"), part(d8, 6, 3)),
        F.concat(F.lit("R$ "), F.col("c_acctbal").cast("decimal(12,2)").cast("string")),
        F.concat(F.lit("Maria "), F.initcap("c_mktsegment"), F.lit(".")),
    )
    others = c.select((-key - 1).cast("bigint").alias("doc_id"), F.posexplode(made).alias("token_id", "text"))
    return dates.unionByName(others)


def order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forms as spans of a page file: boxes in points, style as flags, and a blank span on each page."""
    t = order_form(spark, sf_dir)
    wide, high = 612.0, 792.0
    k = F.col("token_id")
    spans = t.select(
        "doc_id",
        "ord",
        F.when(k == 13, "  ").otherwise(F.concat(F.lit(" "), F.col("text"))).alias("text"),
        (F.col("x0") * wide - F.when(k == 1, 40.0).otherwise(0.0)).alias("bx0"),
        (F.col("y0") * high).alias("by0"),
        (F.col("x1") * wide + F.when(k == 9, 300.0).otherwise(0.0)).alias("bx1"),
        (F.col("y1") * high).alias("by1"),
        F.lit(wide).alias("page_width"),
        F.lit(high).alias("page_height"),
        F.col("font_size").alias("size"),
        (k % 4 * 6).cast("int").alias("flags"),
        F.when(k % 5 == 0, "Arial-Bold").otherwise("Arial").alias("font"),
        (F.col("doc_id") % 70000 * 3 + k).cast("int").alias("color"),
    )
    return spans


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A token for each line of a document."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("token_id", "text"))


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A learner's occurrence log: events as extracted fields."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select(
        F.col("event_type").alias("label_type"),
        F.concat(F.lit("f"), (F.col("user_id") % 3).cast("string")).alias("field_name"),
        F.col("event_id").alias("seq"),
        F.col("value").alias("x"),
        k.alias("y"),
        F.when(F.col("user_id") % 5 == 0, F.lit("LABEL")).otherwise("VALUE").alias("role"),
        F.when(F.col("event_id") % 4 == 0, F.lit("date")).otherwise("text").alias("data_type"),
        F.lit("regex_perfect").alias("strategy"),
        (F.col("user_id") % 4).cast("int").alias("connections"),
        (F.col("value") > 5.0).alias("found"),
    )


#: Label and schema of pages that no entry names.
NO_LABEL, NO_FIELDS = "unknown", (("texto", "Extrair todo o texto do documento"),)


def with_schema(files: DataFrame, entries: DataFrame, label: str | None = None) -> DataFrame:
    """files (path) with the label and fields of the first entry for their name; with a label, only its files.

    entries: ord, label, pdf_path, fields (as of dataset_entries). Files without
    an entry get NO_LABEL and NO_FIELDS, or go if a label is asked for.
    """
    name = F.element_at(F.split("path", "/"), -1)
    first = entries.groupBy("pdf_path").agg(F.min(F.struct("ord", "label", "fields")).alias("e"))
    if label is not None:
        first = first.filter(F.col("e.label") == label)
    joined = files.withColumn("_name", name).join(first, F.col("_name") == F.col("pdf_path"), "left" if label is None else "inner")
    none = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in NO_FIELDS])
    return joined.select(*files.columns, F.coalesce("e.label", F.lit(NO_LABEL)).alias("label"), F.coalesce("e.fields", none).alias("fields"))


def fields_frame(spark: SparkSession, doc_type: str, fields) -> DataFrame:
    """The ordered fields of an extraction schema."""
    rows = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("name"), F.lit(d).alias("description")) for i, (n, d) in enumerate(fields)])
    return spark.range(1).select(F.lit(doc_type).alias("doc_type"), F.inline(rows))


def dataset_entries(spark: SparkSession, path: str) -> DataFrame:
    """label, pdf_path and fields of a dataset file; broken entries are left out, a broken file is empty."""
    schema = "label string, extraction_schema map<string,string>, pdf_path string"
    try:
        df = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    except Exception as e:  # a missing file reads as no entries
        if "PATH_NOT_FOUND" not in str(e):
            raise
        df = spark.createDataFrame([], schema)
    place = F.monotonically_increasing_id()
    return df.withColumn("ord", place).filter("label is not null and extraction_schema is not null").select(
        "ord", "label", "pdf_path", F.map_entries("extraction_schema").alias("fields")
    )


def pdf_folder(spark: SparkSession, path: str) -> DataFrame:
    """Paths of a folder's page files, in order."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "length").orderBy("path")


def spans_to_tokens(spans: DataFrame) -> DataFrame:
    """Tokens of positioned spans: blank ones skipped, boxes normalised, style decoded.

    spans: doc_id, ord, text, bx0, by0, bx1, by1, page_width, page_height, size, flags, font, color.
    """
    keep = spans.filter(~F.col("text").rlike(r"(?U)^\s*$"))
    num = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1
    return keep.select(
        "doc_id",
        num.alias("token_id"),
        "ord",
        X.strip(F.col("text")).alias("text"),
        F.greatest(F.lit(0.0), F.col("bx0") / F.col("page_width")).alias("x0"),
        F.greatest(F.lit(0.0), F.col("by0") / F.col("page_height")).alias("y0"),
        F.least(F.lit(1.0), F.col("bx1") / F.col("page_width")).alias("x1"),
        F.least(F.lit(1.0), F.col("by1") / F.col("page_height")).alias("y1"),
        F.col("size").alias("font_size"),
        ((F.col("flags").bitwiseAND(16) != 0) | F.lower("font").contains("bold")).alias("bold"),
        (F.col("flags").bitwiseAND(2) != 0).alias("italic"),
        F.concat(F.lit("#"), F.lower(F.lpad(F.hex("color"), 6, "0"))).alias("color"),
    )
