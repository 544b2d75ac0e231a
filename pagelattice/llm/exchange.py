"""Bucketed exchange of numpy columns, and hashes of word windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from pagelattice.llm.common import buckets_of, split_batch

_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def pack(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row for each bucket: its number, and each column's values as an array.

    Values of a bucket go by did and place, if there are such columns, so that
    what repeats lies together and compresses.
    """
    by = [columns[k] for k in ("place", "did") if k in columns]
    order = np.lexsort((*by, bucket))
    bucket = bucket[order]
    ids, start = np.unique(bucket, return_index=True)
    offsets = pa.array(np.append(start, len(bucket)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(c[order])) for c in columns.values()]
    return pa.record_batch([pa.array(ids.astype(np.int32)), *lists], ["bucket", *columns])


def unpack(t: pa.Table, names: list[str]) -> list[np.ndarray]:
    """The values of array columns, end to end."""
    return [pa.chunked_array([c.flatten() for c in t[n].chunks]).to_numpy() if t.num_rows else np.empty(0, np.int64) for n in names]


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def word_hashes(column: pa.Array, seeds: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """A 64-bit hash of each word of a batch for each seed, and words for each text."""
    flat, counts = split_batch(column)
    coded = flat.dictionary_encode()
    uniques = coded.dictionary.cast(pa.binary()).to_pylist()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    tables = [np.fromiter((xxhash.xxh3_64_intdigest(w, s) for w in uniques), np.uint64, len(uniques)) for s in seeds]
    return [t[codes] if len(t) else np.empty(0, np.uint64) for t in tables], counts


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on; the last n - 1 places are left off."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = mix(h * np.uint64(_ODD[0]) + words[k : k + m] * np.uint64(_ODD[1])) if k % 4 == 3 else h * np.uint64(_ODD[0]) + words[k : k + m]
    return mix(h)


def places(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number of each word of a batch, and its place in the text."""
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return owner, np.arange(len(owner)) - np.repeat(first, counts)


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of sorted keys begins."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


__all__ = ["buckets_of", "mix", "pack", "places", "runs", "unpack", "window_hashes", "word_hashes"]
