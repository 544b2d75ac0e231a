"""SimHash near-duplicates by multi-index hashing.

A fingerprint has SEGMENTS. By the pigeonhole principle two fingerprints that
differ in at most MAX_BITS bits differ, in some segment, in at most that
segment's radius, where the radii add up to MAX_BITS - len(SEGMENTS) + 1. Each
fingerprint therefore goes to the table entries of all values in a small Hamming
ball around its own value of a segment; entries that meet are verified on all
64 bits. Copies share a fingerprint and are searched once.

Entries travel as arrays, one row for each batch and bucket of segment values.
Inside a bucket the entries of one value are linked to a spanning forest, never
to all pairs: a breadth-first search compares each entry with those not reached
yet, so a cluster of near copies costs its size and not its square.

Defined cases: null and word-free texts have fingerprint zero and are linked
like any other; texts shorter than a shingle use their whole word sequence;
repeated rows keep their rows; null ids are never a component's smallest unless
all are null; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.common import Workspace, as_bytes, buckets_of, give_back, partitions, text_parts, tidy
from pagelattice.llm.graph import components

SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: (lowest bit, bits, radius) of each segment.
SEGMENTS = ((0, 21, 1), (21, 21, 1), (42, 22, 0))
#: Entries of one bucket that a task aims to hold.
BUCKET_ENTRIES = 400_000


def fingerprint(text: bytes, n: int = SHINGLE) -> int:
    """Unsigned fingerprint of a UTF-8 text."""
    w = text.lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*[w[i:] for i in range(n)])) if len(w) >= n else [b" ".join(w)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 65_536):
        part = h[at : at + 65_536].view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(h), bitorder="little").view(np.uint64)[0])


def text_hash(text: str = "text") -> Column:
    """Tells the texts of one id apart."""
    return F.xxhash64(F.col(text).cast("string"))


def fingerprints(docs: DataFrame, text: str = "text", hashed: bool = False) -> DataFrame:
    """(doc_id, fp) with fp the fingerprint's bits as a long, and th, the text's hash, if asked for."""
    names = ["doc_id", "fp"] + ["th"] * hashed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in text_parts(whole, 1)):
            fps = np.fromiter((fingerprint(x.as_py()) for x in as_bytes(b.column(1))), np.uint64, len(b))
            yield pa.record_batch([b.column(0), pa.array(fps.view(np.int64)), *b.columns[2:]], names)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"), *[text_hash(text).alias("th")] * hashed)
    return rows.mapInArrow(lambda batches: tidy(run(batches)), ", ".join(f"{n} bigint" for n in names))


def _balls(segments) -> list[tuple[int, int]]:
    """(segment number, bits to flip) of every entry of a fingerprint."""
    out = []
    for s, (low, width, radius) in enumerate(segments):
        layer = {0}
        seen = {0}
        for _ in range(radius):
            layer = {x ^ (1 << (low + b)) for x in layer for b in range(width)} - seen
            seen |= layer
        out += [(s, x) for x in sorted(seen)]
    return out


def _keys(fps: np.ndarray, flips: np.ndarray, segment: np.ndarray, segments) -> np.ndarray:
    """Table key of each entry: segment number and flipped segment value, mixed."""
    out = np.empty(len(fps), np.uint64)
    moved = fps ^ flips
    for s, (low, width, _) in enumerate(segments):
        m = segment == s
        value = (moved[m] >> np.uint64(low)) & np.uint64((1 << width) - 1)
        out[m] = value * np.uint64(len(segments)) + np.uint64(s)
    return out


def _mixed(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (keys + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        return x * np.uint64(0xBF58476D1CE4E5B9)


def forest(fps: np.ndarray, bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the graph of fingerprints within bits."""
    left = np.unique(fps)
    us, vs = [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= bits
            if near.any():
                found = left[near]
                us.append(np.full(len(found), x))
                vs.append(found)
                queue.extend(found)
                left = left[~near]
    if not us:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(us), np.concatenate(vs)


def bucket_links(key: np.ndarray, fp: np.ndarray, own: np.ndarray, bits: int = MAX_BITS, small: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Verified links among the entries of one bucket, a forest for each table value.

    Table values of few entries are compared at all distances in the sorted
    order at once; the others go through the search.
    """
    order = np.argsort(key, kind="stable")
    key, fp, own = key[order], fp[order], own[order]
    _, start, size = np.unique(key, return_index=True, return_counts=True)
    met = np.repeat((size > 1) & (np.add.reduceat(own.astype(np.int64), start) > 0), size) if len(key) else np.empty(0, bool)
    wide = np.repeat(size, size)
    us, vs = [], []
    few = np.flatnonzero(met & (wide <= small))
    k, f = key[few], fp[few]
    for d in range(1, small):
        i = np.flatnonzero(k[:-d] == k[d:])
        if not len(i):
            break
        i = i[(f[i] != f[i + d]) & (np.bitwise_count(f[i] ^ f[i + d]) <= bits)]
        us.append(f[i])
        vs.append(f[i + d])
    for at, n in zip(start[size > small], size[size > small], strict=True):
        if own[at : at + n].any():
            a, b = forest(fp[at : at + n], bits)
            us.append(a)
            vs.append(b)
    if not us:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    u, v = np.concatenate(us), np.concatenate(vs)
    pairs = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)], axis=1), axis=0) if len(u) else np.empty((0, 2), np.uint64)
    return pairs[:, 0], pairs[:, 1]


def links(fps: DataFrame, n_fps: int, bits: int = MAX_BITS, segments=SEGMENTS) -> DataFrame:
    """(u, v) links that connect all distinct fingerprints (column fp) within bits."""
    if sum(r + 1 for _, _, r in segments) != bits + 1:
        raise ValueError("the radii do not cover the distance")
    balls = _balls(segments)
    seg_of = np.array([s for s, _ in balls], np.int8)
    flip_of = np.array([x for _, x in balls], np.uint64)
    n_buckets = max(partitions(fps.sparkSession), -(-n_fps * len(balls) // BUCKET_ENTRIES))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            if not len(own):
                continue
            fp, which = np.repeat(own, len(balls)), np.tile(np.arange(len(balls), dtype=np.int16), len(own))
            bucket = buckets_of(_mixed(_keys(fp, flip_of[which], seg_of[which], segments)), n_buckets).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket, fp, which = bucket[order], fp[order], which[order]
            ids, start = np.unique(bucket, return_index=True)
            offsets = pa.array(np.append(start, len(bucket)).astype(np.int32))
            yield pa.record_batch(
                [pa.array(ids), pa.ListArray.from_arrays(offsets, pa.array(fp.view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(which))],
                ["bucket", "fps", "entries"],
            )

    def meet(t: pa.Table) -> pa.Table:
        fp = t["fps"].combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        which = t["entries"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        key = _keys(fp, flip_of[which], seg_of[which], segments)
        u, v = bucket_links(key, fp, flip_of[which] == 0, bits)
        give_back()
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    dealt = fps.select("fp").mapInArrow(deal, "bucket int, fps array<bigint>, entries array<smallint>")
    return dealt.groupBy("bucket").applyInArrow(meet, "u bigint, v bigint")


#: A fingerprint that this share of all rows or more has is common; fewer than COMMON can be.
COMMON = 10_000


def _grouped(docs: DataFrame, space: Workspace, bits: int, text: str, hashed: bool) -> DataFrame:
    """Each row's fingerprints(), with its component's root (a fingerprint) and smallest id.

    Rows meet their fingerprint's group by a shuffle on the fingerprint; the at
    most COMMON fingerprints that have a COMMON-th of all rows are broadcast, so
    that no task gets all copies of one.
    """
    rows = space.keep(fingerprints(docs, text, hashed), "rows")
    fps = space.keep(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "fps")
    sums = fps.agg(F.count("*").alias("fps"), F.sum("n").alias("rows")).first()
    groups = components(links(fps, sums["fps"], bits), space)
    named = fps.join(groups, fps.fp == groups.node, "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = space.keep(named.join(smallest, "root").select("fp", "root", "component_id", "n"), "named")
    common = F.col("n") * COMMON >= (sums["rows"] or 0)
    hot, cold = named.filter(common).drop("n"), named.filter(~common).drop("n")
    rest = rows.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(cold, "fp")
    return rows.join(F.broadcast(hot), "fp").unionByName(rest)


def near_duplicates(docs: DataFrame, bits: int = MAX_BITS, text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row."""
    grouped = _grouped(docs, Workspace(docs.sparkSession, "simhash"), bits, text, False)
    return grouped.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Ids up to which the kept ones are broadcast to the documents.
BROADCAST_IDS = 1_000_000


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component, with its own columns: the smallest id's, of its texts that of the smallest hash.

    Components are told apart by root, documents by id and text, so null ids and
    ids of several texts keep one document for each component of theirs. Of rows
    that repeat both one stays; only those rows are shuffled.
    """
    space = Workspace(docs.sparkSession, "simhash-kept")
    judged = _grouped(docs.select("doc_id", "text"), space, MAX_BITS, "text", True)
    first = judged.filter("doc_id <=> component_id").groupBy("root", "doc_id", "th").agg(F.count("*").alias("n"))
    keep = first.groupBy("root").agg(F.min("doc_id").alias("_keep"), F.min("th").alias("_th"), F.min_by("n", "th").alias("n"))
    keep = space.keep(keep.select("_keep", "_th", "n"), "keep")
    sizes = keep.agg(F.count("*").alias("ids"), F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("again")).first()
    side = lambda df: F.broadcast(df) if sizes["ids"] <= BROADCAST_IDS else df
    same = F.col("doc_id").eqNullSafe(F.col("_keep")) & (text_hash() == F.col("_th"))
    once = docs.join(side(keep.filter("n = 1").select("_keep", "_th")), same, "left_semi")
    if not sizes["again"]:
        return once
    again = docs.join(side(keep.filter("n > 1").select("_keep", "_th")), same, "left_semi")
    again = again.withColumn("_text", text_hash()).dropDuplicates(["doc_id", "_text"]).drop("_text")
    return once.unionByName(again)
