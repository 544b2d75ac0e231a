"""Language of each word and text by a linear-chain conditional random field.

A word's features are its prefixes and suffixes, its character n-grams and the
word itself (the lexicon), hashed into one table of weights for each language;
transitions between the languages of neighbouring words are learned with them.
Training sequences are joined from pieces of texts of different languages, so
that switches occur. Labels of a whole text come from forward-backward: each
word has a probability for each language, and the text takes the language with
the largest mean over its words that have letters.

The classifier is fitted on a bounded sample of labelled rows (Sample): of each
of the most frequent languages the rows whose ids and texts hash lowest, found
by a hash limit from the languages' counts, so no task gathers a language. The
sampled texts are used whole, and a text above the bound of characters is not
sampled. Every word of every text is labelled.

Defined cases: null text, and text without letters, is `und` with score 0; words
without letters follow their neighbours and have no say; ties go to the first
language by name; repeated rows are labelled alike; null ids may be learned
from; without any labelled row every text is `und`; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.common import WORD_PATTERN, split_batch, text_parts, tidy
from pagelattice.llm.exchange import mix

UNKNOWN = "und"
TABLE = 1 << 16


@dataclass(frozen=True)
class Sample:
    """Bounds of what the classifier is fitted on."""

    texts_per_language: int = 400
    languages: int = 200
    longest_text: int = 100_000
    sequences: int = 12_000
    words_per_sequence: int = 32
    rounds: int = 2
    step: float = 0.5


def _slots(kind: int, *codes: np.ndarray) -> np.ndarray:
    h = np.full(len(codes[0]), kind * 2 + 1, np.uint64)
    with np.errstate(over="ignore"):
        for c in codes:
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + c)
    return (h % np.uint64(TABLE)).astype(np.int64)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table slots, the word of each slot, and which words have letters (others have no slots).

    Slots are affixes of one to three characters, bigrams and trigrams with the
    word's ends as characters, and the word itself, all of lower-cased words.
    """
    codes = np.frombuffer(("\n" + "\n".join(words).lower() + "\n").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    edge = codes == 10
    if not words or edge.sum() != len(words) + 1:
        raise ValueError("words hold no line ends")
    word = np.cumsum(edge) - 1
    kinds, back = np.unique(codes, return_inverse=True)
    letter = np.array([chr(c).isalpha() for c in kinds.tolist()])[back]
    lettered = np.bincount(word, letter, len(words) + 1)[: len(words)] > 0
    start, end = np.flatnonzero(edge)[:-1] + 1, np.flatnonzero(edge)[1:]
    size, every = end - start, np.arange(len(words))
    found, owner = [], []
    for k in (1, 2, 3):
        long = size >= k
        found.append(_slots(k, *[codes[start[long] + j] for j in range(k)]))
        found.append(_slots(3 + k, *[codes[end[long] - k + j] for j in range(k)]))
        owner += [every[long]] * 2
    found.append(_slots(7, codes[:-1], codes[1:]))
    owner.append(word[:-1])
    inner = ~edge[1:-1]
    found.append(_slots(8, codes[:-2][inner], codes[1:-1][inner], codes[2:][inner]))
    owner.append(word[:-2][inner])
    place = np.arange(len(codes)) - np.flatnonzero(edge)[word]
    with np.errstate(over="ignore"):
        whole = np.add.reduceat(mix(codes + place.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), np.flatnonzero(edge)[:-1])
    found.append(_slots(9, whole))
    owner.append(every)
    slot, owner = np.concatenate(found), np.concatenate(owner)
    use = lettered[np.minimum(owner, len(words) - 1)]
    return slot[use], owner[use], lettered


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray

    def emissions(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of each word for each language, zero without letters; which words have letters."""
        if not words:
            return np.zeros((0, len(self.languages)), np.float32), np.zeros(0, bool)
        slot, owner, lettered = features(words)
        return _summed(self.weights, slot, owner, len(words)), lettered


def _summed(weights: np.ndarray, slot: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    scale = 1 / np.sqrt(np.maximum(np.bincount(owner, minlength=n), 1))
    return np.stack([np.bincount(owner, weights[slot, k], n) * scale for k in range(weights.shape[1])], 1).astype(np.float32)


def fit(texts: list[str], langs: list[str], bounds: Sample = Sample()) -> Model:
    """Maximises the conditional likelihood of joined sequences by adaptive gradient steps."""
    names = sorted(set(langs))
    K, T = len(names), bounds.words_per_sequence
    model = Model(names, np.zeros((TABLE, K), np.float32), np.zeros((K, K), np.float32))
    rng = np.random.default_rng(7)
    vocab: dict[str, int] = {}
    pools: list[list[np.ndarray]] = [[] for _ in names]
    for text, lang in zip(texts, langs, strict=True):
        ids = [vocab.setdefault(x, len(vocab)) for x in split_batch(pa.array([text]))[0].to_pylist()]
        if ids:
            pools[names.index(lang)].append(np.array(ids))
    ready = [k for k in range(K) if pools[k]]
    if not ready:
        return model
    streams = [np.concatenate(p) if p else np.empty(0, np.int64) for p in pools]
    slot, owner, _ = features(list(vocab))
    order = np.argsort(owner, kind="stable")
    slot, begin = slot[order], np.searchsorted(owner[order], np.arange(len(vocab) + 1))
    X, Y = np.empty((bounds.sequences, T), np.int64), np.empty((bounds.sequences, T), np.int64)
    for r in range(bounds.sequences):
        at, k = 0, ready[int(rng.integers(len(ready)))]
        while at < T:
            n = min(T - at, int(rng.integers(4, 2 * T)))
            s = int(rng.integers(0, max(1, len(streams[k]) - n + 1)))
            piece = np.resize(streams[k][s : s + n], n)
            X[r, at : at + n], Y[r, at : at + n] = piece, k
            at, k = at + n, ready[int(rng.integers(len(ready)))]
    seen_w, seen_t = np.full((TABLE, K), 1e-3, np.float32), np.full((K, K), 1e-3, np.float32)
    B = 64
    for _ in range(bounds.rounds):
        for at in range(0, bounds.sequences, B):
            x, y = X[at : at + B], Y[at : at + B]
            uniques, back = np.unique(x, return_inverse=True)
            back = back.reshape(x.shape)
            size = begin[uniques + 1] - begin[uniques]
            word = np.repeat(np.arange(len(uniques)), size)
            flat = slot[np.repeat(begin[uniques] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            scale = 1 / np.sqrt(np.maximum(size, 1))
            e = _summed(model.weights, flat, word, len(uniques))
            gamma, pair = _marginals(e[back], model.transitions)
            grad = gamma.copy()
            np.put_along_axis(grad, y[..., None], np.take_along_axis(grad, y[..., None], 2) - 1, 2)
            by_word = np.stack([np.bincount(back.ravel(), grad[..., k].ravel(), len(uniques)) for k in range(K)], 1)
            moved, at_slot = np.unique(flat, return_inverse=True)
            part = (by_word * scale[:, None])[word]
            g = np.stack([np.bincount(at_slot, part[:, k], len(moved)) for k in range(K)], 1).astype(np.float32) / B
            gold = np.zeros((K, K), np.float32)
            np.add.at(gold, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
            gt = (pair - gold) / B
            seen_w[moved] += g * g
            seen_t += gt * gt
            model.weights[moved] -= bounds.step * g / np.sqrt(seen_w[moved])
            model.transitions -= bounds.step * gt / np.sqrt(seen_t)
    return model


def _marginals(e: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label and summed transition probabilities of equally long sequences (B, T, K)."""
    B, T, K = e.shape
    p, A = np.exp(e - e.max(2, keepdims=True)), np.exp(transitions - transitions.max())
    alpha, beta = np.empty_like(p), np.empty_like(p)
    alpha[:, 0] = p[:, 0] / p[:, 0].sum(1, keepdims=True)
    for t in range(1, T):
        a = (alpha[:, t - 1] @ A) * p[:, t]
        alpha[:, t] = a / a.sum(1, keepdims=True)
    beta[:, -1] = 1
    for t in range(T - 2, -1, -1):
        b = (beta[:, t + 1] * p[:, t + 1]) @ A.T
        beta[:, t] = b / b.sum(1, keepdims=True)
    gamma = alpha * beta
    gamma /= gamma.sum(2, keepdims=True)
    x = alpha[:, :-1, :, None] * A[None, None] * (beta[:, 1:] * p[:, 1:])[:, :, None, :]
    x /= x.sum((2, 3), keepdims=True)
    return gamma, x.sum((0, 1))


def label(model: Model, emissions: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Label probabilities of every word: emissions by word code, codes of texts end to end.

    Words are dealt by place, longest text first, so one step of the recursion
    moves all texts that still have words.
    """
    K = emissions.shape[1]
    order = np.argsort(-counts, kind="stable")
    lens = counts[order]
    total, width = int(counts.sum()), int(lens[0]) if len(lens) else 0
    active = np.searchsorted(-lens, -np.arange(width), side="left")
    at = np.concatenate([[0], np.cumsum(active)])
    first = (np.cumsum(counts) - counts)[order]
    rank = np.repeat(np.arange(len(order)), lens)
    place = np.arange(total) - np.repeat(np.cumsum(lens) - lens, lens)
    source = np.repeat(first, lens) + place
    target = at[place] + rank
    e = np.empty((total, K), np.float32)
    e[target] = emissions[codes[source]]
    p = np.exp(e - e.max(1, keepdims=True))
    A = np.exp(model.transitions - model.transitions.max()).astype(np.float32)
    alpha = np.empty_like(p)
    for t in range(width):
        a = p[at[t] : at[t + 1]]
        if t:
            a = (alpha[at[t - 1] : at[t - 1] + active[t]] @ A) * a
        alpha[at[t] : at[t + 1]] = a / a.sum(1, keepdims=True)
    beta = np.ones((int(active[0]) if width else 0, K), np.float32)
    for t in range(width - 2, -1, -1):
        n = active[t + 1]
        b = (beta[:n] * p[at[t + 1] : at[t + 2]]) @ A.T
        beta[:n] = b / b.sum(1, keepdims=True)
        beta[n : active[t]] = 1
        alpha[at[t] : at[t + 1]] *= beta[: active[t]]
    alpha /= alpha.sum(1, keepdims=True)
    out = np.empty_like(alpha)
    out[source] = alpha[target]
    return out


def label_batch(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, which words have letters, and the words' label probabilities."""
    flat, counts = split_batch(column)
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    emissions, lettered = model.emissions(coded.dictionary.to_pylist())
    own = lettered[codes] if len(codes) else np.empty(0, bool)
    return counts, own, label(model, emissions, codes, counts)


#: Times as many rows as asked for are expected below a language's hash limit.
SURPLUS = 1.5


def labelled_sample(docs: DataFrame, bounds: Sample, text: str = "text", lang: str = "lang") -> list[tuple[str, int, str]]:
    """(lang, hash, text) in order: of each language the texts that hash lowest, the same for every run."""
    rows = docs.select(F.xxhash64(F.col("doc_id").cast("bigint"), F.col(text).cast("string")).alias("h"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").rlike(WORD_PATTERN) & (F.length("text") <= bounds.longest_text))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(bounds.languages).collect()
    if not counts:
        return []
    share = {r["lang"]: min(1.0, SURPLUS * bounds.texts_per_language / r["n"]) for r in counts}
    limits = F.create_map(*[F.lit(x) for k, p in share.items() for x in (k, int(-(2**63) + p * (2**64 - 1)) if p < 1 else 2**63 - 1)])
    found = rows.filter(F.col("h") <= F.element_at(limits, F.col("lang"))).distinct().collect()  # about SURPLUS times the sample
    out: list[tuple[str, int, str]] = []
    for name in sorted(share):
        out += sorted((r["lang"], r["h"], r["text"]) for r in found if r["lang"] == name)[: bounds.texts_per_language]
    return out


def train(docs: DataFrame, bounds: Sample = Sample(), text: str = "text", lang: str = "lang") -> Model:
    rows = labelled_sample(docs, bounds, text, lang)
    return fit([r[2] for r in rows], [r[0] for r in rows], bounds)


def predict(docs: DataFrame, model: Model, text: str = "text", spans: bool = False) -> DataFrame:
    """doc_id, lang_pred, score; with spans also runs of words of one language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "lang_pred", "score"] + ["spans"] * spans
    kind = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in (part for whole in batches for part in text_parts(whole, 1)):
            langs, scores, marks = [], [], []
            for counts, lettered, prob in [label_batch(m, b.column(1))] if m.languages else []:
                owner = np.repeat(np.arange(len(counts)), counts)
                says = np.bincount(owner[lettered], minlength=len(counts))
                mean = np.stack([np.bincount(owner[lettered], prob[lettered, k], len(counts)) for k in range(prob.shape[1])], 1).astype(float)
                mean /= np.maximum(says, 1)[:, None]
                best = mean.argmax(1)
                langs += [m.languages[k] if n else UNKNOWN for k, n in zip(best.tolist(), says.tolist(), strict=True)]
                scores.append(np.where(says > 0, np.clip(mean.max(1), 0, 1), 0.0))
                if spans:
                    which = prob.argmax(1)
                    for part in np.split(which, np.cumsum(counts)[:-1]):
                        new = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
                        marks.append([{"first": int(i), "words": int(j - i), "lang": m.languages[part[i]]} for i, j in zip(new, new[1:], strict=False)])
            if not m.languages:
                langs, scores, marks = [UNKNOWN] * len(b), [np.zeros(len(b))], [[]] * len(b)
            cols = [b.column(0), pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else np.empty(0))]
            yield pa.record_batch(cols + [pa.array(marks, kind)] * spans, names)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    ddl = "doc_id bigint, lang_pred string, score double" + ", spans array<struct<first: int, words: int, lang: string>>" * spans
    return rows.mapInArrow(lambda batches: tidy(run(batches)), ddl)


def held_out(folds: int = 3, held: int = 1):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held, F.lit(False))


def language_id(docs: DataFrame, bounds: Sample = Sample()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, learned from the rows that are not held out."""
    model = train(docs.filter(~held_out()), bounds)
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
