"""Benchmark items inside documents, by MinHash containment.

A text's shingles are the distinct runs of SHINGLE words, A to Z lower-cased. An
item of n shingles is contained in a document at threshold t if at least
ceil(t n) of its shingles occur there, so of any n - ceil(t n) + 1 of them one
must. An item's sketch is that many of its smallest shingle hashes (a bottom-k
MinHash).

Items are partitioned by size, in powers of two. A partition's limit is the
largest hash of its sketches, and its need the fewest shingles that contain one
of its items. A document, however long, probes the partitions whose need it has
places for, with those of its hashes that are within the loosest limit of these
(beyond a partition's own limit there is nothing of it to meet). No pair at the
threshold is missed; the pairs that meet are then verified on the shingles
themselves.

All of it is built-in expressions. Items go to every task only if they have few
shingles in all (checked); otherwise the look-up is a shuffled join on the hash,
salted by document, so that a hash of many documents has SALTS tasks.

Defined cases: null texts and items have no shingles; a text of fewer than
SHINGLE words has one, the whole of it, so such an item is found in equal texts
only; repeated rows give a pair each; repeated items of one id are one item's
alternatives by text; null ids are kept; clashing column names do not matter,
since only ids and texts are read; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.common import NO_ID, Workspace, ascii_lower, let, words

SHINGLE = 5
THRESHOLD = 0.8
#: Shingles of all items, and documents with hits, up to which a side is broadcast.
BROADCAST_SHINGLES = 500_000
BROADCAST_ROWS = 1_000_000
SALTS = 16


def _worded(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("_w", words(ascii_lower(F.col(text))))


def shingle_texts(w: str) -> Column:
    """Distinct shingles of an array of words, as strings."""
    runs = let(w, "a", f"transform(sequence(1, size(a) - {SHINGLE - 1}), i -> array_join(slice(a, i, {SHINGLE}), ' '))")
    return F.expr(
        f"""case when size({w}) >= {SHINGLE} then array_distinct({runs})
            when size({w}) > 0 then array(array_join({w}, ' ')) else cast(array() as array<string>) end"""
    )


def _hashed(df: DataFrame) -> DataFrame:
    """Adds _h: hashes of the shingles of _w, one for each place."""
    df = df.withColumn("_1", F.transform("_w", lambda x: F.xxhash64(x)))
    df = df.withColumn("_2", F.expr(let("_1", "a", "transform(a, (h, i) -> xxhash64(h, get(a, i + 1)))")))
    df = df.withColumn("_4", F.expr(let("_2", "a", "transform(a, (h, i) -> xxhash64(h, get(a, i + 2)))")))
    df = df.withColumn("_5", F.expr(let("_1", "a", "transform(_4, (h, i) -> xxhash64(h, get(a, i + 4)))")))
    n = f"case when size(_w) = 0 then 0 else greatest(size(_w) - {SHINGLE - 1}, 1) end"
    return df.withColumn("_h", F.expr(f"slice(_5, 1, {n})")).drop("_1", "_2", "_4", "_5")


def item_sketches(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """item, n_item, size_class, shingles, sketch of each distinct item with shingles."""
    rows = items.select(F.col("item_id").alias("item"), F.col("text").cast("string").alias("text")).distinct()
    rows = _hashed(_worded(rows, "text").filter(F.size("_w") > 0)).withColumn("shingles", shingle_texts("_w"))
    rows = rows.withColumn("n_item", F.size("shingles"))
    k = F.col("n_item") - F.ceil(F.col("n_item") * F.lit(threshold) - F.lit(1e-9)).cast("int") + 1
    sketch = F.slice(F.array_sort(F.array_distinct("_h")), F.lit(1), k)
    return rows.select(
        "item", F.xxhash64("text").alias("version"), "n_item", F.floor(F.log2(F.col("n_item"))).cast("int").alias("size_class"), "shingles", sketch.alias("sketch")
    )


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """did, th, item, n_shared, n_item, containment of all pairs at the threshold.

    did is the document's id (NO_ID for null) and th the hash of its text.
    """
    space = Workspace(docs.sparkSession, "decontaminate")
    source = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("did"), source.alias("text"))
    sketches = space.keep(item_sketches(items, threshold), "items")
    need = F.ceil(F.col("n_item") * F.lit(threshold) - F.lit(1e-9))
    parts = sketches.groupBy("size_class").agg(F.max(F.array_max("sketch")).alias("limit"), F.min(need).alias("need"), F.sum("n_item").alias("n"))
    parts = sorted((r["size_class"], r["limit"], r["need"], r["n"]) for r in parts.collect())  # a row for each power of two
    few = sum(p[3] for p in parts) <= BROADCAST_SHINGLES
    side = lambda df: F.broadcast(df) if few else df
    index = sketches.select(F.explode("sketch").alias("h"), "item", "version")
    # A document's own limit is the loosest of the partitions whose need it meets.
    own = "greatest(null, null" + "".join(f", case when size(g) >= {need} then {limit}L end" for _, limit, need, _ in parts) + ")"
    kept = let(own, "l", "filter(g, h -> h <= l)")
    probes = _hashed(_worded(rows, "text")).select("did", F.expr(let("_h", "g", kept)).alias("_p"))
    # An inner explode would infer a filter on the hashes and push it, with their lambdas, below them.
    probes = probes.select("did", F.explode_outer("_p").alias("h")).filter("h is not null")
    keys = ["h"]
    if not few:
        keys.append("salt")
        probes = probes.withColumn("salt", F.pmod(F.xxhash64("did"), F.lit(SALTS)))
        index = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    met = probes.join(side(index), keys).select("did", "item", "version").distinct()
    met = space.keep(met, "met")
    wanted = met.groupBy("did").agg(F.collect_set(F.struct("item", "version")).alias("found"))
    if met.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    close = _worded(rows.join(wanted, "did"), "text")
    close = close.select("did", F.xxhash64("text").alias("th"), shingle_texts("_w").alias("own"), "found")
    pairs = close.select("did", "th", "own", F.explode("found").alias("f")).select("did", "th", "own", "f.item", "f.version")
    facts = sketches.select(F.col("item").alias("_item"), F.col("version").alias("_version"), "shingles", "n_item")
    pairs = pairs.join(side(facts), F.col("item").eqNullSafe(F.col("_item")) & (F.col("version") == F.col("_version")))
    counted = pairs.select("did", "th", "item", F.size(F.array_intersect("shingles", "own")).alias("n_shared"), "n_item")
    kept = counted.withColumn("containment", F.col("n_shared") / F.col("n_item")).filter(F.col("n_shared") >= F.col("n_item") * F.lit(threshold) - F.lit(1e-9))
    return space.keep(kept, "pairs")


def contamination(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment."""
    return contained_items(docs, items, threshold).select(
        F.nullif(F.col("did"), F.lit(NO_ID)).alias("doc_id"),
        F.col("item").alias("item_id"),
        F.col("n_shared").cast("bigint").alias("n_shared"),
        F.col("n_item").cast("bigint").alias("n_item"),
        "containment",
    )


def clean_documents(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that contain no item, with their own columns."""
    found = contained_items(docs, items, threshold).select(F.col("did").alias("_dc_did"), F.col("th").alias("_dc_th")).distinct()
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    did = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))
    th = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.join(found, (did == F.col("_dc_did")) & (th == F.col("_dc_th")), "left_anti")
