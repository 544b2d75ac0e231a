"""Removal of repeated passages by difference-cover anchors.

A window is WINDOW consecutive words. Places of a text modulo PERIOD that lie in
COVER are anchors. COVER is a difference cover: for two windows anywhere in two
texts some shift below PERIOD brings both onto anchors, so equal windows share
an aligned anchor of WINDOW - PERIOD + 1 words.

1. Anchor hashes are dealt to buckets; anchors that two ids share are hits.
2. Hits extend: the windows around them, in all documents that have hits, are
   dealt by a 128-bit hash; each occurrence whose smallest id is smaller than
   its own document's is repeated.
3. The words that repeated windows cover are removed.

Windows are equal if two independent 64-bit hashes of their words are: among
10^12 different windows two agree by chance with a probability below 10^-14,
which is accepted in place of comparing the words again.

Before it is dealt, a batch decides what it can: of anchors or windows that
several of its documents share only the smallest id's goes out, and the rest go
on as decided, spread by document, so a passage in a third of all documents
puts a row for each batch, not for each document, into its bucket.

Defined cases: null text has no words; a null id comes after all others; rows
of one id never remove each other's words, and each keeps its own result;
texts shorter than a window stay as they are; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.common import NO_ID, Workspace, as_bytes, give_back, partitions, text_parts, tidy
from pagelattice.llm.exchange import buckets_of, mix, pack, places, runs, unpack, window_hashes, word_hashes

WINDOW = 13
PERIOD = 7
COVER = (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
BUCKET_ROWS = 1_000_000
SEEDS = (11, 12)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _decided(keys: list[np.ndarray], did: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key and id; in that order, which group each row is in, and the smallest id of each group."""
    order = np.lexsort((did, *reversed(keys)))
    sorted_keys = [k[order] for k in keys]
    start = runs(*sorted_keys)
    size = np.diff(np.append(start, len(order)))
    return order, np.repeat(np.arange(len(start)), size), did[order][start] if len(start) else did[:0]


def _by_document(ids: list[np.ndarray], place: np.ndarray) -> list[pa.Array]:
    """Sorted id columns, and the places of each combination as an array."""
    order = np.lexsort((place, *reversed(ids)))
    ids = [x[order] for x in ids]
    start = runs(*ids)
    offsets = pa.array(np.append(start, len(order)).astype(np.int32))
    return [pa.array(x[start]) for x in ids] + [pa.ListArray.from_arrays(offsets, pa.array(place[order].astype(np.int32)))]


def _row_bucket(did: np.ndarray, th: np.ndarray, n_buckets: int) -> np.ndarray:
    """Bucket of each row, told by its id and its text, so rows without an id spread too."""
    return buckets_of(mix(did.view(np.uint64) ^ mix(th.view(np.uint64))), n_buckets).astype(np.int32)


def _onward(n_buckets: int, did: np.ndarray, th: np.ndarray, place: np.ndarray) -> pa.Table:
    """Deals found places by row."""
    give_back()
    return pa.Table.from_batches([pack(_row_bucket(did, th, n_buckets), {"did": did, "th": th, "place": place})])


def _collect(t: pa.Table) -> pa.Table:
    """Puts each row's places together."""
    out = pa.table(_by_document(*(lambda did, th, place: ([did, th], place))(*unpack(t, ["did", "th", "place"]))), ["did", "th", "places"])
    give_back()
    return out


FOUND = "bucket int, did array<bigint>, th array<bigint>, place array<int>"


def _met(dealt: DataFrame, meet, n_buckets: int) -> DataFrame:
    """Groups of a bucket each through meet, then each row's found places: did, th, places. A bucket is a task of its own."""
    alone = lambda df: df.repartitionById(n_buckets, F.col("bucket")).groupBy("bucket")
    return alone(alone(dealt).applyInArrow(meet, FOUND)).applyInArrow(_collect, "did bigint, th bigint, places array<int>")


def anchor_hits(rows: DataFrame, n_buckets: int) -> DataFrame:
    """(did, th, places) of anchors that occur under two ids or more."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in text_parts(whole, 2)):
            (words,), counts = word_hashes(b.column(2), SEEDS[:1])
            owner, place = places(counts)
            h = window_hashes(words, ANCHOR)
            owner, place = owner[: len(h)], place[: len(h)]
            use = np.isin(place % PERIOD, COVER) & (place + ANCHOR <= counts[owner]) & (counts[owner] >= WINDOW)
            h, place, owner = h[use], place[use], owner[use]
            did, th = (b.column(i).to_numpy(zero_copy_only=False)[owner] for i in (0, 1))
            if not len(h):
                continue
            order, group, least = _decided([h], did)
            h, did, th, place = h[order], did[order], th[order], place[order].astype(np.int32)
            n = len(least)
            shared = np.zeros(n, bool)
            np.logical_or.at(shared, group[did > least[group]], True)
            first = np.zeros(len(h), bool)
            first[np.unique(group, return_index=True)[1]] = True
            hit = shared[group]
            out = ~hit | first
            bucket = np.concatenate([buckets_of(h[out], n_buckets).astype(np.int32), _row_bucket(did[hit], th[hit], n_buckets)])
            #: state 0: open, 1: stands for a decided group, 2: a decided hit
            state = np.concatenate([np.where(hit[out], 1, 0), np.full(hit.sum(), 2)]).astype(np.int8)
            both = lambda x: np.concatenate([x[out], x[hit]])
            yield pack(bucket, {"h": both(h).view(np.int64), "did": both(did), "th": both(th), "place": both(place), "state": state})

    def meet(t: pa.Table) -> pa.Table:
        h, did, th, place, state = unpack(t, ["h", "did", "th", "place", "state"])
        done = state == 2
        order, group, least = _decided([h[~done]], did[~done])
        d, x, p, s = did[~done][order], th[~done][order], place[~done][order], state[~done][order]
        shared = np.zeros(len(least), bool)
        if len(d):
            shared[group[d > least[group]]] = True
        new = shared[group] & (s == 0) if len(d) else np.zeros(0, bool)
        return _onward(n_buckets, np.concatenate([did[done], d[new]]), np.concatenate([th[done], x[new]]), np.concatenate([place[done], p[new]]))

    dealt = rows.select("did", "th", "text").mapInArrow(
        lambda batches: tidy(deal(batches)), "bucket int, h array<bigint>, did array<bigint>, th array<bigint>, place array<int>, state array<tinyint>"
    )
    return _met(dealt, meet, n_buckets)


def repeated_windows(hit_rows: DataFrame, n_buckets: int) -> DataFrame:
    """(did, th, places) of windows that start under a smaller id too; rows have did, th, text, places."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in text_parts(whole, 2)):
            (one, two), counts = word_hashes(b.column(2), SEEDS)
            first = np.cumsum(counts) - counts
            at = b.column(3)
            lens = np.diff(at.offsets.to_numpy())
            owner = np.repeat(np.arange(len(counts)), lens)
            spread = (at.flatten().to_numpy()[:, None] - np.arange(PERIOD)[None, :]).ravel()
            owner = np.repeat(owner, PERIOD)
            ok = (spread >= 0) & (spread + WINDOW <= counts[owner])
            starts = np.unique(first[owner[ok]] + spread[ok])
            if not len(starts):
                continue
            owner = np.searchsorted(np.cumsum(counts), starts, side="right")
            place = (starts - first[owner]).astype(np.int32)
            h1, h2 = window_hashes(one, WINDOW)[starts], window_hashes(two, WINDOW)[starts]
            did = b.column(0).to_numpy(zero_copy_only=False)[owner]
            th = b.column(1).to_numpy(zero_copy_only=False)[owner]
            order, group, least = _decided([h1, h2], did)
            h1, h2, did, th, place = (x[order] for x in (h1, h2, did, th, place))
            hit = did > least[group]
            out = ~hit
            bucket = np.concatenate([buckets_of(h1[out], n_buckets).astype(np.int32), _row_bucket(did[hit], th[hit], n_buckets)])
            both = lambda x: np.concatenate([x[out], x[hit]])
            state = np.concatenate([np.zeros(out.sum()), np.full(hit.sum(), 2)]).astype(np.int8)
            yield pack(bucket, {"h1": both(h1).view(np.int64), "h2": both(h2).view(np.int64), "did": both(did), "th": both(th), "place": both(place), "state": state})

    def meet(t: pa.Table) -> pa.Table:
        h1, h2, did, th, place, state = unpack(t, ["h1", "h2", "did", "th", "place", "state"])
        done = state == 2
        order, group, least = _decided([h1[~done], h2[~done]], did[~done])
        d, x, p = did[~done][order], th[~done][order], place[~done][order]
        new = d > least[group] if len(d) else np.zeros(0, bool)
        return _onward(n_buckets, np.concatenate([did[done], d[new]]), np.concatenate([th[done], x[new]]), np.concatenate([place[done], p[new]]))

    dealt = hit_rows.select("did", "th", "text", "places").mapInArrow(
        lambda batches: tidy(deal(batches)), "bucket int, h1 array<bigint>, h2 array<bigint>, did array<bigint>, th array<bigint>, place array<int>, state array<tinyint>"
    )
    return _met(dealt, meet, n_buckets)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (part for whole in batches for part in text_parts(whole, 2)):
        n_words, n_removed, kept = [], [], []
        for i, text in enumerate(as_bytes(b.column(2))):
            w = text.as_py().split()
            at = b.column(3)[i].as_py()
            gone = 0
            if at:
                keep = np.zeros(len(w) + 1, np.int64)
                starts = np.array(at)
                np.add.at(keep, starts, 1)
                np.add.at(keep, starts + WINDOW, -1)
                left = np.cumsum(keep)[:-1] == 0
                gone = int(len(w) - left.sum())
                w_kept = [x for x, k in zip(w, left.tolist(), strict=True) if k]
            else:
                w_kept = w
            n_words.append(len(w))
            n_removed.append(gone)
            kept.append(b" ".join(w_kept))
        yield pa.record_batch(
            [b.column(0), b.column(1), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
            ["did", "th", "n_words", "n_removed", "kept_text"],
        )


def repeats(docs: DataFrame, space: Workspace, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows (did, th, text) of the documents, and the places of their repeated windows."""
    source = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("did"), F.xxhash64(source).alias("th"), source.alias("text"))
    size = docs.select(F.sum(F.length(F.col(text))).alias("n")).first()["n"] or 0
    n = max(partitions(docs.sparkSession), -(-size // 14 // BUCKET_ROWS))
    hits = space.keep(anchor_hits(rows, n), "hits")
    found = repeated_windows(rows.join(hits, ["did", "th"]), n)
    return rows, space.keep(found, "windows")


def substring_dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one space)."""
    space = Workspace(docs.sparkSession, "substrings")
    rows, windows = repeats(docs, space, text)
    cut = rows.join(windows, ["did", "th"], "left").select("did", "th", "text", "places")
    out = cut.mapInArrow(lambda batches: tidy(_cut(batches)), "did bigint, th bigint, n_words bigint, n_removed bigint, kept_text string")
    return out.select(F.nullif(F.col("did"), F.lit(NO_ID)).alias("doc_id"), "n_words", "n_removed", "kept_text")


def _kept_runs(text: bytes, gone: np.ndarray) -> bytes:
    """A text without the marked words; what stays keeps its own white space."""
    spans = [m.span() for m in _WORD.finditer(text)]
    edges = np.flatnonzero(np.diff(np.concatenate([[1], gone.astype(np.int8), [1]])))
    out, before = b"", 0
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        gap = text[before : spans[a][0]]
        out += (b"\n" if b"\n" in gap else b" " if out else b"") if a else gap
        out += text[spans[a][0] : spans[b - 1][1]]
        before = spans[b - 1][1]
    return out.strip()


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents' own columns, texts without repeated words; those left empty go."""
    space = Workspace(docs.sparkSession, "substrings")
    _, windows = repeats(docs, space)
    own = docs.columns
    keyed = docs.withColumns(
        {
            "_did": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)),
            "_th": F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))),
        }
    )
    side = windows.select(F.col("did").alias("_did"), F.col("th").alias("_th"), "places")
    joined = keyed.join(side, ["_did", "_th"], "left").select(*own, F.col("places").alias("_places"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {n: i for i, n in enumerate(own)}
        for b in (part for whole in batches for part in text_parts(whole, at["text"])):
            texts, keep = b.column(at["text"]).cast(pa.binary()).to_pylist(), []
            for i, places in enumerate(b.column(len(own)).to_pylist()):
                if places:
                    gone = np.zeros(len(texts[i].split()) + 1, np.int64)
                    np.add.at(gone, np.array(places), 1)
                    np.add.at(gone, np.array(places) + WINDOW, -1)
                    texts[i] = _kept_runs(texts[i], np.cumsum(gone)[:-1] > 0)
                keep.append(not places or bool(texts[i]))
            cols = [b.column(i) for i in range(len(own))]
            cols[at["text"]] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.record_batch(cols, own).filter(pa.array(keep))

    out = joined.mapInArrow(lambda batches: tidy(cut(batches)), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in own else out
