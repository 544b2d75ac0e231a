"""Fields against tokens: exact, partial, typed and vector matches, and tie-breaks.

Fields are few, and their number is checked: they reach the tokens as a literal
of the projection, or by a join on words. Tokens are never gathered, and each
match is a row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelattice.functions import hints as H
from pagelattice.functions import text as X
from pagelattice.functions import vectors as V
from pagelattice.operators.graph import materialized

# Words that a field's pattern leaves out.
FIELD_STOP = "o a de do da em no na para com por e ou"
PERFECT = 0.95
PARTIAL = 0.8
FLOOR = 0.3
OVERLAP = 0.3
MAX_FIELDS = 10_000
#: Queries of a vector search that go to every task at once, scores computed at once, and steps of a score.
QUERY_BLOCK = 10_000
SCORES_AT_ONCE = 2_000_000
SCALE = 1_000_000


def literal(rows: DataFrame) -> Column:
    """The rows of a schema side as an array for explode; at most MAX_FIELDS."""
    found = rows.limit(MAX_FIELDS + 1).collect()
    if len(found) > MAX_FIELDS:
        raise ValueError(f"more than {MAX_FIELDS} rows of a schema")
    kind = T.ArrayType(rows.schema)
    return F.from_json(F.lit(json.dumps([r.asDict(recursive=True) for r in found])), kind)


def small(fields: DataFrame) -> DataFrame:
    """The schema side, broadcast when it is as small as a schema should be."""
    return F.broadcast(fields) if fields.limit(MAX_FIELDS + 1).count() <= MAX_FIELDS else fields


def prepared(fields: DataFrame) -> DataFrame:
    """Fields with normalised name and description, and the words of their pattern."""
    both = F.concat_ws(" ", F.replace("name", F.lit("_"), F.lit(" ")), "description")
    df = fields.withColumns({"f_name": X.ascii_norm(F.col("name")), "f_text": X.ascii_norm(F.col("description")), "f_words": X.keywords(both, FIELD_STOP)})
    return df.withColumn("f_overlap", X.keywords(both))


def word_overlap(tokens: DataFrame, fields: DataFrame, least: float = OVERLAP) -> DataFrame:
    """doc_id, field, token_id, overlap: share of a field's words that a token has.

    Words join words, so a token meets only the fields that share one with it.
    """
    p = prepared(fields).select(F.col("name").alias("field"), F.explode("f_overlap").alias("word"), F.size("f_overlap").alias("n"))
    t = tokens.select("doc_id", "token_id", F.explode(X.keywords(F.col("text"))).alias("word"))
    met = t.join(small(p), "word").groupBy("doc_id", "field", "token_id").agg((F.count("*") / F.first("n")).alias("overlap"))
    return met.filter(F.col("overlap") >= least)


def regex_perfect(tokens: DataFrame, fields: DataFrame) -> DataFrame:
    """doc_id, field, token_id, score: texts that are a field's name, description or one of its words."""
    p = prepared(fields)
    keys = F.array_distinct(F.concat(F.array("f_name", "f_text"), "f_words"))
    wanted = p.select(F.col("name").alias("field"), F.explode(keys).alias("t")).filter("t <> ''").distinct()
    t = tokens.select("doc_id", "token_id", X.ascii_norm(F.col("text")).alias("t"))
    return t.join(small(wanted), "t").select("doc_id", "field", "token_id", F.lit(PERFECT).alias("score"))


def regex_partial(tokens: DataFrame, fields: DataFrame) -> DataFrame:
    """doc_id, field, token_id, score: texts that contain a field's name or words, by the share matched.

    Of several words inside, the one that comes first counts.
    """
    own_words = X.keywords(F.col("description"), FIELD_STOP)
    f = literal(prepared(fields).select(F.col("name").alias("field"), "f_name", "f_text", "f_words", own_words.alias("d_words")))
    t = tokens.select("doc_id", "token_id", X.ascii_norm(F.col("text")).alias("t")).filter("t <> ''")
    t = t.withColumn("f", F.explode(f)).select("doc_id", "token_id", "t", "f.*")
    inside = lambda c: F.when((c != "") & F.col("t").contains(c), F.length(c)).otherwise(0)
    words = F.greatest(leftmost(F.col("t"), F.col("f_words")), leftmost(F.col("t"), F.col("d_words")))
    score = F.greatest(inside(F.col("f_name")), inside(F.col("f_text")), words) / F.length("t") * PARTIAL
    own = (F.col("t") == F.col("f_name")) | (F.col("t") == F.col("f_text")) | F.array_contains("f_words", F.col("t"))
    return t.filter(~own).withColumn("score", score).filter(F.col("score") >= FLOOR).select("doc_id", "field", "token_id", "score")


def leftmost(text: Column, words: Column) -> Column:
    """Length of the word that occurs first in a text, of those at one place the first listed; 0 without any."""
    at = F.filter(F.transform(words, lambda w, i: F.struct(F.instr(text, w).alias("at"), i.alias("i"), F.length(w).alias("n"))), lambda x: x["at"] > 0)
    return F.coalesce(F.array_min(at)["n"], F.lit(0))


def pattern_score(role: Column, priority: Column) -> Column:
    by_role = F.when(role == "VALUE", 0.3).when(role == "HEADER", 0.2).when(role == "LABEL", 0.1).otherwise(0.0)
    return F.lit(0.5) + by_role + F.greatest(F.lit(0.0), (11 - priority) / 10.0) * 0.1


def pattern_matches(tokens: DataFrame, name: str, description: str, registry: H.Registry | None = None) -> DataFrame:
    """token rows with hint, extracted value and score for one field's detectors.

    The first specific detector that accepts a text wins; a text that all
    specific detectors reject is out; the general one counts only without any.
    """
    r = registry or H.Registry()
    out = tokens.withColumn("m", accepted(F.col("text"), r.specific(name, description) or r.relevant(name, description))).filter("m is not null")
    return out.select("doc_id", "token_id", F.col("m.hint").alias("hint"), F.col("m.value").alias("value"), F.round(pattern_score(F.col("role"), F.col("m.priority")), 6).alias("score"))


def accepted(text: Column, hints: list[H.Hint], value: Column | None = None) -> Column:
    """hint, priority and value of the first detector that takes a text; the value is taken from another text if one is given."""
    source = text if value is None else value
    hint = F.lit(None).cast("struct<hint: string, priority: int, value: string>")
    for h in reversed(hints):
        found = F.struct(F.lit(h.name).alias("hint"), F.lit(h.priority).alias("priority"), F.coalesce(h.extract(source), source).alias("value"))
        hint = F.when(h.detect(text), found).otherwise(hint)
    return hint


def label_pattern_matches(pairs: DataFrame, name: str, description: str, registry: H.Registry | None = None) -> DataFrame:
    """As pattern_matches, for values with their labels: a value that none takes counts, a tenth higher, if one takes it with its label and its own text.

    pairs: doc_id, token_id, role, text, label (null without one).
    """
    r = registry or H.Registry()
    use = r.specific(name, description) or r.relevant(name, description)
    both = F.concat_ws(" ", F.regexp_replace("label", r"\s*:\s*$", ""), "text")
    alone, joint = accepted(F.col("text"), use), accepted(both, use, F.col("text"))
    own = F.lit(False)
    for h in use:
        own = own | ((joint["hint"] == h.name) & h.detect(F.col("text")))
    m = pairs.withColumn("m", F.coalesce(alone, F.when(F.col("label").isNotNull() & own, joint))).withColumn("raised", alone.isNull())
    score = F.least(F.lit(1.0), pattern_score(F.col("role"), F.col("m.priority")) + F.when(F.col("raised"), 0.1).otherwise(0.0))
    return m.filter("m is not null").select("doc_id", "token_id", F.col("m.hint").alias("hint"), F.col("m.value").alias("value"), F.round(score, 6).alias("score"))


def names(tokens: DataFrame, column: str = "text") -> DataFrame:
    """Tokens whose text looks like a name and not like an address."""
    c = F.col(column)
    return tokens.filter(H.BY_NAME["name"].detect(c) & ~H.BY_NAME["address"].detect(c))


def _block_topk(vectors: DataFrame, block: pa.Table, k: int, least: float) -> DataFrame:
    """query_id, vec_id, score: each task's k nearest vectors of a block of queries; ties go to the smaller vec_id."""
    block = block.combine_chunks()
    ids = block.column(0).to_numpy().astype(np.int64)
    rows = block.column(1).to_pylist()
    sizes = np.array([len(x) for x in rows])
    sides = {int(n): (np.flatnonzero(sizes == n), np.array([x for x in rows if len(x) == n], np.float64)) for n in np.unique(sizes)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, near = np.full((len(ids), k), -1, np.int64), np.zeros((len(ids), k), np.int64)
        for b in batches:
            v_ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            lists = b.column(1)
            n_values = lists.value_lengths().to_numpy(zero_copy_only=False)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            start = np.cumsum(n_values) - n_values
            for n, (who, q) in sides.items():
                own = np.flatnonzero(n_values == n)
                own = own[np.argsort(v_ids[own], kind="stable")]
                if not len(own):
                    continue
                v, v_id = values[start[own][:, None] + np.arange(n)], v_ids[own]
                step = max(1, SCORES_AT_ONCE // len(own))
                for at in range(0, len(who), step):
                    w = who[at : at + step]
                    score = np.floor((q[at : at + step] @ v.T + 1) / 2 * SCALE + 0.5)
                    score[(score / SCALE < least) | (ids[w][:, None] == v_id)] = -1
                    # Scores and places in one number, so that the k largest are unique.
                    key = score.astype(np.int64) * len(own) + np.arange(len(own) - 1, -1, -1)
                    top = np.argpartition(key, max(0, len(own) - k), axis=1)[:, -k:]
                    s = np.concatenate([best[w], np.take_along_axis(score.astype(np.int64), top, axis=1)], axis=1)
                    i = np.concatenate([near[w], v_id[top]], axis=1)
                    order = np.lexsort((i, -s), axis=1)[:, :k]
                    best[w], near[w] = np.take_along_axis(s, order, axis=1), np.take_along_axis(i, order, axis=1)
        at, place = np.nonzero(best >= 0)
        yield pa.record_batch([pa.array(ids[at]), pa.array(near[at, place]), pa.array(best[at, place] / SCALE)], ["query_id", "vec_id", "score"])

    return vectors.mapInArrow(run, "query_id bigint, vec_id bigint, score double")


def embedding_topk(vectors: DataFrame, queries: DataFrame, k: int = 5, least: float = 0.3) -> DataFrame:
    """query_id, vec_id, score, rank: each query's nearest vectors by (cos + 1) / 2.

    Every vector meets every query. Queries go to the tasks in blocks of about
    QUERY_BLOCK; of a block only k rows of a task and query are shuffled, and
    with more than one block each one's rows are written before the next.
    Rows without an id, or whose vector is null or holds a null, match nothing.
    """
    usable = "vec_id is not null and embedding is not null and forall(embedding, x -> x is not null)"
    side = lambda df: df.filter(usable).select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    v, q = side(vectors), side(queries)
    n_blocks = max(1, -(-q.count() // QUERY_BLOCK))
    scored = None
    for i in range(n_blocks):
        block = q.filter(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == i).toArrow()
        part = _block_topk(v, block, k, least)
        part = part if n_blocks == 1 else materialized(part)
        scored = part if scored is None else scored.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


#: Types of a lower priority need a similarity of CLEAR.
LEAST, CLEAR, HIGH_PRIORITY = 0.45, 0.55, 5


def type_classifier(vectors: DataFrame, prototypes: DataFrame, least: float = LEAST) -> DataFrame:
    """vec_id, kind, similarity: the most similar prototype of each vector, if similar enough.

    prototypes: kind, prototype, and priority if kinds of low priority have to be clearer than others.
    """
    p = literal(prototypes.orderBy("kind"))
    weight = lambda x: x["priority"] if "priority" in prototypes.columns else F.lit(HIGH_PRIORITY)
    scored = F.transform(p, lambda x: F.struct((-F.round(V.dot(F.col("embedding"), x["prototype"]), 6)).alias("s"), x["kind"].alias("kind"), weight(x).alias("w")))
    out = vectors.select("vec_id", F.array_min(scored).alias("b")).select("vec_id", F.col("b.kind").alias("kind"), (-F.col("b.s")).alias("similarity"), "b.w")
    return out.filter((F.col("similarity") >= least) & ((F.col("w") >= HIGH_PRIORITY) | (F.col("similarity") >= CLEAR))).drop("w")


def tied(matches: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Matches within the threshold of their field's best on the page."""
    top = F.max("score").over(Window.partitionBy("doc_id", "field"))
    return matches.withColumn("_top", top).filter(F.col("score") > F.col("_top") - threshold).drop("_top")


def heuristic_score(role: Column, alone: Column, x: Column, y: Column, length: Column, label_far: Column) -> Column:
    """Weighted sum of role, isolation, position of the centre, length and distance of the label.

    alone: whether a header leads to no value; label_far: a value's distance from its label, null without one.
    """
    by_role = F.when(role == "VALUE", 1.0).when(role == "HEADER", 0.7).when(role == "LABEL", 0.3).otherwise(0.0)
    isolated = F.when(role == "HEADER", F.when(alone, 1.0).otherwise(0.3)).otherwise(0.0)
    place = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - (y + x) / 2.0))
    size = F.when(length.between(3, 50), 1.0).when(length < 3, 0.7).when(length <= 100, 0.8).otherwise(0.5)
    by_distance = F.when(label_far < 0.1, 1.0).when(label_far < 0.3, 0.9).when(label_far < 0.5, 0.7).when(label_far.isNotNull(), 0.5).otherwise(0.4)
    near = F.when(role == "VALUE", by_distance).otherwise(0.5)
    return by_role * 0.4 + isolated * 0.2 + place * 0.2 + size * 0.1 + near * 0.1


# Texts of controls, which are no values.
CONTROLS = (
    "esconder filtros|mostrar filtros|ocultar filtros|atualizar|buscar|pesquisar|filtrar|limpar|resetar|voltar|avançar|"
    "próximo|anterior|cancelar|confirmar|salvar|<<|>>|<|>|..."
)


def quality_gate(text: Column, degree: Column) -> Column:
    """Not empty, no control text inside, two edges or more, and no list number before capitals."""
    low = F.lower(text)
    control = F.lit(False)
    for c in CONTROLS.split("|"):
        control = control | low.contains(c)
    return (X.strip(text) != "") & ~control & (degree >= 2) & ~X.strip(text).rlike(r"^\d+\s+[A-Z]")


def type_gate(text: Column, kind: Column) -> Column:
    """Whether a text can be of an expected type; types without a form, and none, accept all."""
    digits = F.length(F.regexp_replace(text, "[^0-9]", ""))
    return (
        F.when(kind == "date", text.rlike(X.DATE))
        .when(kind == "money", text.rlike(r"\d"))
        .when(kind == "phone", text.rlike(r"[\d\s()\-+]{8,}") & (digits >= 8))
        .when(kind == "email", X.strip(text).rlike(r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"))
        .when(kind == "cpf_cnpj", text.rlike(r"\d{11}|\d{14}|\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}|\d{3}\.\d{3}\.\d{3}-\d{2}"))
        .when(kind == "number", X.strip(text).rlike(r"^\d+(?:[.,]\d+)?$"))
        .otherwise(True)
    )
