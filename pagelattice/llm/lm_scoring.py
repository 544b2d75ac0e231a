"""Language-model scores of whole texts by a subword lattice.

A word's probability is the sum over all its segmentations into pieces of an
existing vocabulary, by a forward recursion in log space. Pieces follow a
unigram law: the vocabulary's own scores are its prior, worth PRIOR_WEIGHT
pieces (the merge vocabulary that is here has ranks and no probabilities; a
piece of rank r then weighs 1/(1+r)), and the training texts add the counts that
one forward-backward pass over their distinct words expects under the prior. A
word of the training texts is an edge of its own from its begin to its end,
with its share of all training tokens, so what the model knows grows with them;
such edges have WORD_WEIGHT of the probability and the pieces have the rest. A
text's probability is that of its words and one end.

Words seen at least once in every N / FREQUENT training tokens are at most
FREQUENT many; those go to every task. The other words of a text travel with
their counts to the word table by a shuffle on the word, in which no word can be
frequent, and come back as sums.

Defined cases: a null text is empty and has one token, its end; a null id is not
held out; repeated rows count and are scored each; words of any length are
scored whole; characters outside the vocabulary are scored by their bytes; with
no training text all counts are zero; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.common import Workspace, split_batch, text_parts, tidy
from pagelattice.llm.pieces import SPACE, Pieces, load

#: Bound of the words that every task gets.
FREQUENT = 300_000
#: Weight of the vocabulary's own scores, in pieces.
PRIOR_WEIGHT = 1_000.0
#: Share of whole training words, beside pieces, in the law of words.
WORD_WEIGHT = 0.5
GATHER = 60_000
CHARS_AT_ONCE = 200_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
LOG10 = np.log(10.0)


def prior(p: Pieces) -> np.ndarray:
    """Log probabilities of ordinary pieces, then 256 bytes, then the end, from the scores alone."""
    s = p.scores[p.normal]
    weight = np.exp(s - s.max()) if p.unigram else 1.0 / (1.0 + s.max() - s)
    weight = weight / weight.sum()
    tail = np.concatenate([np.full(256, 0.01 / 256), [0.01]])
    return np.log(np.concatenate([weight * 0.98, tail]))


class Lattice:
    """Forward and backward recursions over many words at once."""

    def __init__(self, texts: list[str], logp: np.ndarray):
        """texts: ordinary pieces; logp: theirs, then those of 256 bytes and of the end."""
        self.logp = logp
        self.n = len(texts)
        by_length: dict[int, list[int]] = {}
        for i, t in enumerate(texts):
            by_length.setdefault(len(t), []).append(i)
        self.longest = max(by_length, default=1)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.longest, _BASE)]).astype(np.uint64))
            for length, ids in by_length.items():
                codes = np.frombuffer("".join(texts[i] for i in ids).encode("utf-32-le"), np.uint32).reshape(len(ids), length)
                h = np.zeros(len(ids), np.uint64)
                for k in range(length):
                    h = h * _BASE + codes[:, k].astype(np.uint64) + np.uint64(1)
                order = np.argsort(h)
                self.tables[length] = (h[order], np.array(ids)[order])

    def _groups(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Word numbers and code points (with the space mark first) of each word length."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
            if not len(part):
                continue
            n = int(lengths[part[0]]) + 1
            for at in range(0, len(part), max(1, CHARS_AT_ONCE // n)):
                some = part[at : at + max(1, CHARS_AT_ONCE // n)]
                text = SPACE + SPACE.join(words[i] for i in some)
                yield some, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(some), n)

    def _bytes(self, code: int) -> np.ndarray:
        return self.n + np.frombuffer(chr(code).encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64)

    def _bytes_logp(self, codes: np.ndarray) -> np.ndarray:
        uniques, back = np.unique(codes, return_inverse=True)
        table = np.array([self.logp[self._bytes(c)].sum() for c in uniques.tolist()])
        return table[back.reshape(codes.shape)]

    def _edges(self, codes: np.ndarray, spell: np.ndarray, backward: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, piece numbers or -1, log probabilities) for all spans, by end, the first or the last end first."""
        n, width = codes.shape
        with np.errstate(over="ignore"):
            h = np.zeros((width + 1, n), np.uint64)
            for k in range(width):
                h[k + 1] = h[k] * _BASE + codes[:, k].astype(np.uint64) + np.uint64(1)
            for end in range(width, 0, -1) if backward else range(1, width + 1):
                for length in range(1, min(end, self.longest) + 1):
                    if length not in self.tables and length > 1:
                        continue
                    keys, ids = self.tables.get(length, (np.empty(0, np.uint64), np.empty(0, np.int64)))
                    want = h[end] - h[end - length] * self.power[length]
                    at = np.searchsorted(keys, want)
                    at[at == len(keys)] = 0
                    hit = keys[at] == want if len(keys) else np.zeros(n, bool)
                    if length > 1 and not hit.any():
                        continue
                    piece = np.where(hit, ids[at], -1) if len(keys) else np.full(n, -1)
                    missing = spell[:, end - 1] if length == 1 else -np.inf
                    yield end - length, end, piece, np.where(hit, self.logp[piece], missing)

    def log_marginals(self, words: list[str]) -> np.ndarray:
        """Natural log of each word's probability over all segmentations."""
        out = np.empty(len(words))
        for some, codes in self._groups(words):
            alpha = np.full((codes.shape[1] + 1, len(some)), -np.inf)
            alpha[0] = 0
            for start, end, _, lp in self._edges(codes, self._bytes_logp(codes)):
                alpha[end] = np.logaddexp(alpha[end], alpha[start] + lp)
            out[some] = alpha[-1]
        return out

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected uses of pieces and bytes in the words, each as often as counted."""
        total = np.zeros(self.n + 256)
        for some, codes in self._groups(words):
            spell = self._bytes_logp(codes)
            alpha = np.full((codes.shape[1] + 1, len(some)), -np.inf)
            beta = alpha.copy()
            alpha[0], beta[-1] = 0, 0
            for start, end, _, lp in self._edges(codes, spell):
                alpha[end] = np.logaddexp(alpha[end], alpha[start] + lp)
            # The edges again rather than kept: beta is whole at an end once all later ends are done.
            for start, end, piece, lp in self._edges(codes, spell, backward=True):
                beta[start] = np.logaddexp(beta[start], beta[end] + lp)
                weight = np.exp(alpha[start] + lp + beta[end] - alpha[-1]) * counts[some]
                known = piece >= 0
                total[: self.n] += np.bincount(piece[known], weight[known], self.n)
                if end - start == 1 and not known.all():
                    for c, w in zip(codes[~known, start].tolist(), weight[~known].tolist(), strict=True):
                        np.add.at(total, self._bytes(c), w)
        return total


def _lower(column: pa.Array) -> pa.Array:
    """A to Z in lower case, other letters as they are; null as empty."""
    raw = pc.fill_null(column.cast(pa.binary()), b"")
    if not len(raw) or raw.buffers()[2] is None:
        return raw.cast(pa.string())
    at = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]
    data = bytes(memoryview(raw.buffers()[2])[at[0] : at[-1]]).lower()
    return pa.StringArray.from_buffers(len(raw), pa.py_buffer((at - at[0]).astype(np.int32).tobytes()), pa.py_buffer(data))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (part for whole in batches for part in text_parts(whole, 0)):
        flat, _ = split_batch(_lower(b.column(0)))
        found = flat.value_counts()
        yield pa.record_batch([found.field(0), found.field(1).cast(pa.int64())], ["word", "n"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together until they have enough rows for wide recursions."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= GATHER:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def lm_scores(
    docs: DataFrame,
    folds: int = 5,
    held: int = 1,
    vocabulary: Pieces | None = None,
    text: str = "text",
    prior_weight: float = PRIOR_WEIGHT,
    word_weight: float = WORD_WEIGHT,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    An infinite prior_weight leaves the pieces their prior; a word_weight of 0
    leaves whole words out.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    space = Workspace(spark, "lm")
    p = vocabulary or load()
    texts = [p.texts[i] for i in p.normal]
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(crc == held, F.lit(False)).alias("held_out"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    train = rows.filter(~F.col("held_out"))
    counted = train.select("text").mapInArrow(lambda batches: tidy(_word_counts(batches)), "word string, n bigint")
    vocab = space.keep(counted.groupBy("word").agg(F.sum("n").alias("c")), "vocab")
    sums = vocab.agg(F.count("*").alias("v"), F.sum("c").alias("n")).first()
    n_train = train.count()
    n_tokens, n_types = (sums["n"] or 0) + n_train, sums["v"] + (n_train > 0)
    base_total = np.log10(n_tokens + 0.5 * (n_types + 1))

    start = prior(p)
    first = sc.broadcast((texts, start))

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*first.value)
        total = np.zeros(lattice.n + 256)
        for t in _gathered(batches):
            total += lattice.expected(t["word"].to_pylist(), t["c"].to_numpy().astype(float))
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(total[used])], ["piece", "uses"])

    uses = vocab.mapInArrow(lambda batches: tidy(expect(batches)), "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toArrow()  # a row a piece
    total = np.zeros(len(start))
    total[uses["piece"].to_numpy()] = uses["uses"].to_numpy()
    total[-1] = n_train
    weight = total / prior_weight + np.exp(start)
    logp = np.log(weight / weight.sum())
    model = sc.broadcast((texts, logp))
    # Without training words the pieces have all of the probability.
    whole = word_weight if n_tokens > n_train else 0.0
    base_of = lambda c: np.log10(c + 0.5) - base_total
    end_base, end_score = float(base_of(n_train)), float(logp[-1] / LOG10)

    def marginal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*model.value)
        for t in _gathered(batches):
            c = t["c"].to_numpy()
            with np.errstate(divide="ignore"):
                lp = np.logaddexp(lattice.log_marginals(t["word"].to_pylist()) + np.log(1 - whole), np.log(whole * c / max(1, n_tokens))) / LOG10
            out = pa.table([t["word"], pa.array(c > 0), pa.array(base_of(c)), pa.array(lp)], ["word", "known", "base", "score"])
            yield from out.combine_chunks().to_batches()

    scored_words = lambda df: df.mapInArrow(lambda batches: tidy(marginal(batches)), "word string, known boolean, base double, score double")
    top = scored_words(vocab.filter(F.col("c") >= max(1, -(-n_tokens // FREQUENT)))).toArrow()  # at most FREQUENT rows
    top_model = sc.broadcast((top["word"].combine_chunks(), top["base"].to_numpy(), top["score"].to_numpy()))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_words, known_base, known_score = top_model.value
        row = TaskContext.get().partitionId() << 33
        for b in (part for batch in batches for part in text_parts(batch, 2)):
            flat, counts = split_batch(_lower(b.column(2)))
            coded = flat.dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(counts)), counts)
            at = pc.fill_null(pc.index_in(coded.dictionary, value_set=known_words), -1).to_numpy(zero_copy_only=False)
            place = at[code] if len(code) else np.empty(0, np.int64)
            common = place >= 0
            add = lambda w: np.bincount(owner[common], w, len(counts)).astype(float)
            base, scored = add(known_base[place[common]]), add(known_score[place[common]])
            pairs, times = np.unique(owner[~common] * max(1, len(coded.dictionary)) + code[~common], return_counts=True)
            doc, word = np.divmod(pairs, max(1, len(coded.dictionary)))
            offsets = np.append(0, np.cumsum(np.bincount(doc, minlength=len(counts)))).astype(np.int32)
            rare = pa.ListArray.from_arrays(pa.array(offsets), coded.dictionary.take(pa.array(word)))
            rare_n = pa.ListArray.from_arrays(pa.array(offsets), pa.array(times.astype(np.int32)))
            yield pa.record_batch(
                [pa.array(row + np.arange(len(counts))), b.column(0), b.column(1), pa.array(counts + 1), pa.array(np.bincount(owner[common], minlength=len(counts)).astype(np.int64)),
                 pa.array(base), pa.array(scored), rare, rare_n],
                ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "words", "times"],
            )
            row += len(counts)

    ddl = "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, words array<string>, times array<int>"
    scored = space.keep(rows.mapInArrow(lambda batches: tidy(score(batches)), ddl), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("n"))

    types = rare.select("word").distinct().join(vocab, "word", "left").select("word", F.coalesce("c", F.lit(0)).alias("c"))
    types = space.keep(scored_words(types), "types")
    part = rare.join(types, "word").groupBy("row").agg(
        F.sum(F.expr("if(known, n, 0)")).alias("rare_known"), F.sum(F.expr("n * base")).alias("rare_base"), F.sum(F.expr("n * score")).alias("rare_score")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return scored.drop("words", "times").join(part, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + zero("rare_known") + F.lit(int(n_train > 0))).cast("bigint").alias("n_known"),
        F.lit(n_tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + zero("rare_base") + F.lit(end_base)).alias("base_score"),
        (F.col("score") + zero("rare_score") + F.lit(end_score)).alias("score"),
    )
