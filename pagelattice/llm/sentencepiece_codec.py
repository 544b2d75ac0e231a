"""SentencePiece encoding and decoding by suffix-array matching.

The distinct units of a batch (a run of space marks with what follows it; no
piece crosses from another character to a space mark) are joined into one text.
Its suffix array, sorted by as many characters as fit a machine word and then
by doubling up to the longest piece, gives every piece its range of occurrences
by binary search. The occurrences are the edges of a lattice; sorted by where
they end, they are relaxed one end place after the other, for all units at once
(where few units are left, unit by unit). With unigram scores the best sum
wins. With merge ranks the one edge wins whose piece may follow the piece
before it: no merge of a lower rank could have joined them. Characters without
a piece are spelled in bytes. Decoding joins the bytes of the pieces.

The vocabulary is read and indexed on the driver and sent to the tasks; nothing
is trained.

Defined cases: null text is empty and has no ids; repeated rows are encoded
each; texts of any length are encoded whole; null ids stay null; extra columns
are ignored; an empty table gives an empty result. The space mark itself in a
text decodes to a space, as the format has it. A unit that the lattice does not
reach raises an error; every character is a piece or is spelled, so none can.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.common import text_parts, tidy
from pagelattice.llm.pieces import SPACE, Pieces, load

#: Stands between units; no character has this code.
BREAK = 0x110000
NONE, SPELLED = -1, -2
CHARS_AT_ONCE = 500_000
#: Units below which the lattices are relaxed one unit after the other.
FEW_UNITS = 16
#: Bounds of what a worker process remembers between batches.
REMEMBERED_UNITS = 300_000
REMEMBERED_IDS = 3_000_000
_UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def _merges(text: str, rank: dict[str, float]) -> list[tuple[str, tuple[str, str] | None]]:
    """Symbols of a text after all merges, best rank and leftmost first, with their last parts."""
    symbol: list[str | None] = list(text)
    parts: list[tuple[str, str] | None] = [None] * len(symbol)
    after, before = list(range(1, len(symbol) + 1)), list(range(-1, len(symbol) - 1))
    heap: list[tuple[float, int, str]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < len(symbol) and (t := symbol[i] + symbol[j]) in rank:
            heapq.heappush(heap, (rank[t], i, t))

    for i in range(len(symbol) - 1):
        offer(i)
    while heap:
        _, i, t = heapq.heappop(heap)
        if symbol[i] is None or after[i] >= len(symbol) or symbol[i] + symbol[after[i]] != t:
            continue
        j = after[i]
        parts[i] = (symbol[i], symbol[j])
        symbol[i], symbol[j] = t, None
        after[i] = after[j]
        if after[i] < len(symbol):
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [(s, parts[i]) for i, s in enumerate(symbol) if s is not None]


class PairTable:
    """Numbers of pairs of pieces, in a hash table with open addresses."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, np.inf, np.float32)
        slot, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            at = slot[left]
            free = np.flatnonzero(self.keys[at] < 0)
            at, first = np.unique(at[free], return_index=True)
            placed = left[free[first]]
            self.keys[at], self.values[at] = keys[placed], values[placed]
            left = np.setdiff1d(left, placed, assume_unique=True)
            slot[left] = (slot[left] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The pairs' numbers, infinite for a pair that is not there."""
        slot = self._slots(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], np.float32(np.inf))
        left = np.flatnonzero((found >= 0) & (found != keys))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            found = self.keys[slot[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[(found >= 0) & ~hit]
        return out


class Vocabulary:
    """Pieces as arrays, the last merge of each, and which piece may follow which."""

    def __init__(self, p: Pieces):
        self.unigram, self.unknown, self.bytes_at, self.has_bytes = p.unigram, p.unknown, p.bytes_at, p.has_bytes
        number = {p.texts[i]: int(i) for i in p.normal}
        if any(re.search(f"[^{SPACE}]{SPACE}", t) for t in number):
            raise ValueError("a piece spans words")
        if not p.dummy_prefix:
            raise ValueError("the model has no leading space mark")
        self.scores = p.scores.astype(np.float64)
        self.spelled_score = float(p.scores[p.normal].min()) - 10 if len(p.normal) else 0.0
        self.n = len(p.texts)
        self.plain = None
        #: rank of the merge that makes a piece, -1 for one character; its parts, -1 for a character without a piece
        self.birth = np.full(self.n, -1, np.float32)
        self.first, self.second = np.full(self.n, NONE, np.int32), np.full(self.n, NONE, np.int32)
        usable = []
        rank = {t: -float(p.scores[i]) for t, i in number.items()}
        for t, i in number.items():
            if p.unigram or len(t) == 1:
                usable.append(i)
                continue
            out = _merges(t, rank)
            if len(out) == 1:
                usable.append(i)
                self.birth[i] = rank[t]
                self.first[i], self.second[i] = (number.get(x, NONE) for x in out[0][1])
        pairs = [] if p.unigram else [
            (a * self.n + b, rank[t]) for t in number for k in range(1, len(t)) if (a := number.get(t[:k])) is not None and (b := number.get(t[k:])) is not None
        ]
        self.joins = PairTable(np.array([k for k, _ in pairs], np.int64), np.array([r for _, r in pairs], np.float32))
        usable.sort(key=lambda i: p.texts[i])
        self.usable = np.array(usable, np.int32)
        self.size = np.array([len(p.texts[i]) for i in usable], np.int32)
        self.codes = np.frombuffer("".join(p.texts[i] for i in usable).encode("utf-32-le"), np.uint32).astype(np.int32)
        self.begin = np.cumsum(self.size, dtype=np.int64) - self.size
        self.longest = int(self.size.max(initial=1))
        spelled = {int(i): bytes([b]) for b, i in enumerate(p.bytes_at) if i >= 0}
        raw = [spelled.get(i, t.replace(SPACE, " ").encode() if t in number and number[t] == i else b"") for i, t in enumerate(p.texts)]
        self.bytes_len = np.array([len(x) for x in raw])
        self.bytes_begin = np.cumsum(self.bytes_len) - self.bytes_len
        self.bytes_flat = np.frombuffer(b"".join(raw), np.uint8)

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging a's and b's text gives just a and b.

        Undoes the two pieces' merges, the latest first (of equal ones the right
        piece's, as the leftmost is merged first). At each moment the symbols that
        meet must not be joined by a merge that comes before their own next one.
        """
        ok = np.ones(len(a), bool)
        live = np.flatnonzero((a >= 0) & (b >= 0))
        x, y = a[live], b[live]
        x_till = np.full(len(live), np.inf, np.float32)
        y_till = x_till.copy()
        while len(live):
            rank = self.joins.get(x.astype(np.int64) * self.n + y)
            bad = (rank < x_till) & (rank <= y_till)
            ok[live[bad]] = False
            born_x, born_y = self.birth[x], self.birth[y]
            left = born_x > born_y
            nx, ny = np.where(left, self.second[x], x), np.where(left, y, self.first[y])
            go = np.flatnonzero(~bad & (nx >= 0) & (ny >= 0) & (left | (born_y >= 0)))
            x_till, y_till = np.where(left, born_x, x_till)[go], np.where(left, y_till, born_y)[go]
            live, x, y = live[go], nx[go], ny[go]
        return ok


    def scalar_follow(self):
        """may_follow for one pair, for loops over few units."""
        if self.plain is None:
            there = np.flatnonzero(self.joins.keys >= 0)
            joins = dict(zip(self.joins.keys[there].tolist(), self.joins.values[there].tolist(), strict=True))
            self.plain = (joins, self.birth.tolist(), self.first.tolist(), self.second.tolist(), {})
        joins, birth, first, second, known = self.plain
        never = float("inf")

        def undone(x: int, y: int) -> bool:
            x_till = y_till = never
            while x >= 0 and y >= 0:
                rank = joins.get(x * self.n + y, never)
                if rank < x_till and rank <= y_till:
                    return False
                if birth[x] > birth[y]:
                    x_till, x = birth[x], second[x]
                elif birth[y] >= 0:
                    y_till, y = birth[y], first[y]
                else:
                    return True
            return True

        def fits(x: int, y: int) -> bool:
            found = known.get((x, y))
            if found is None:
                if len(known) >= REMEMBERED_UNITS:
                    known.clear()
                found = known[x, y] = undone(x, y)
            return found

        return fits


class Index:
    """Suffix array of a text, to a depth of characters, and ranges of strings in it."""

    def __init__(self, codes: np.ndarray, depth: int):
        """codes: characters of a text; what lies behind its end is smaller than any."""
        self.table = np.zeros(int(codes.max(initial=0)) + 2, np.uint64)
        self.table[codes] = 1
        alphabet = np.flatnonzero(self.table)
        self.table[alphabet] = np.arange(1, len(alphabet) + 1, dtype=np.uint64)
        self.bits = max(1, int(len(alphabet)).bit_length())
        self.step = max(1, min(64 // self.bits, depth))
        small = np.append(self.table[codes], np.zeros(self.step, np.uint64))
        key = np.zeros(len(codes), np.uint64)
        for k in range(self.step):
            key = (key << np.uint64(self.bits)) | small[k : k + len(codes)]
        self.order = np.argsort(key)
        #: for each depth: sorted keys, and the number of each place's group of equal keys
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        reach, key = self.step, key[self.order]
        while True:
            group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            self.levels.append((reach, key, group))
            if reach >= depth:
                return
            rank = np.zeros(len(codes) + reach, np.uint64)
            rank[self.order] = group + 1
            key = (rank[: len(codes)] << np.uint64(32)) | rank[reach : reach + len(codes)]
            self.order = np.argsort(key)
            key = key[self.order]
            reach *= 2

    def ranges(self, flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the suffix array has the suffixes that start with each string."""
        known = np.where(flat < len(self.table), self.table[np.minimum(flat, len(self.table) - 1)], 0)
        gone = np.append(0, np.cumsum(known == 0))
        here = gone[begin + size] == gone[begin]
        low, high = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        use = np.flatnonzero(here)
        low[use], high[use] = self._within(known, begin[use], size[use].astype(np.int64), len(self.levels) - 1)
        return low, high

    def _within(self, known: np.ndarray, begin: np.ndarray, size: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        reach, keys, _ = self.levels[level]
        if level == 0:
            want, rest = np.zeros(len(begin), np.uint64), np.zeros(len(begin), np.uint64)
            padded = np.append(known, np.zeros(reach, np.uint64))
            for k in range(reach):
                inside = size > k
                want = (want << np.uint64(self.bits)) | np.where(inside, padded[begin + k], 0)
                rest = (rest << np.uint64(self.bits)) | np.where(inside, np.uint64(0), np.uint64((1 << self.bits) - 1))
            return np.searchsorted(keys, want), np.searchsorted(keys, want | rest, side="right")
        before, _, group = self.levels[level - 1]
        low, high = self._within(known, begin, np.minimum(size, before), level - 1)
        more = np.flatnonzero((size > before) & (low < high))
        a, b = self._within(known, begin[more] + before, size[more] - before, level - 1)
        ends = np.append(group, group[-1] + 1 if len(group) else 0).astype(np.uint64) + np.uint64(1)
        top = ends[low[more]] << np.uint64(32)
        first, last = ends[a], np.where(b > a, ends[np.maximum(b, 1) - 1], 0)
        low[more] = np.searchsorted(keys, top | first)
        high[more] = np.where(b > a, np.searchsorted(keys, top | last, side="right"), low[more])
        return low, high


def _edges(v: Vocabulary, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, piece and length of every edge by the place in its unit where it ends, and where each place's edges begin."""
    index = Index(codes, v.longest)
    low, high = index.ranges(v.codes, v.begin, v.size)
    count = high - low
    which = np.repeat(np.arange(len(count), dtype=np.int32), count)
    at = index.order[np.arange(count.sum()) + np.repeat(low - np.cumsum(count) + count, count)].astype(np.int32)
    single = np.zeros(len(codes), bool)
    single[at[v.size[which] == 1]] = True
    bare = np.flatnonzero(~single & (codes != BREAK)).astype(np.int32)
    at = np.concatenate([at, bare])
    piece = np.concatenate([v.usable[which], np.full(len(bare), SPELLED, np.int32)])
    length = np.concatenate([v.size[which], np.ones(len(bare), np.int32)])
    place = np.arange(len(codes), dtype=np.int32) - np.repeat(start, size + 1).astype(np.int32)
    end = place[at] + length
    by = np.argsort(end.astype(np.uint16) if int(size.max()) < 1 << 16 else end, kind="stable")
    cut = np.append(0, np.cumsum(np.bincount(end, minlength=int(size.max()) + 1)))
    return at[by], piece[by], length[by], cut


def encode_units(v: Vocabulary, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all units, given without their first space mark, end to end, and how many each unit has."""
    if not units:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    size = np.fromiter(map(len, units), np.int64, len(units)) + 1
    start = np.cumsum(size + 1) - size - 1
    codes = np.full(int(size.sum()) + len(units), BREAK, np.int32)
    codes[start] = ord(SPACE)
    plain = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes[np.arange(len(plain)) + np.repeat(2 * np.arange(len(units)) + 1, size - 1)] = plain
    at, piece, length, cut = _edges(v, codes, start, size)
    into = np.full(len(codes) + 1, NONE, np.int32)  # the piece that ends before a place
    width = np.zeros(len(codes) + 1, np.int32)
    best = np.full(len(codes) + 1, -np.inf)
    reached = np.zeros(len(codes) + 1, bool)
    reached[start], best[start] = True, 0
    ordered = np.sort(size)
    together = int(ordered[-FEW_UNITS]) if len(ordered) >= FEW_UNITS else 0
    for k in range(1, together + 1):
        s, p, n = at[cut[k] : cut[k + 1]], piece[cut[k] : cut[k + 1]], length[cut[k] : cut[k + 1]]
        if v.unigram:
            ok = np.flatnonzero(reached[s])
            s, p, n = s[ok], p[ok], n[ok]
            score = best[s] + np.where(p >= 0, v.scores[p], v.spelled_score)
            pick = np.lexsort((score, s + n))
            s, p, n, score = s[pick], p[pick], n[pick], score[pick]
            best[s + n] = score  # the last of equal ends is the best
        else:
            ok = np.flatnonzero(reached[s] & v.may_follow(into[s], p))
            s, p, n = s[ok], p[ok], n[ok]
        e = s + n
        into[e], width[e], reached[e] = p, n, True
    if together < int(size.max()):
        late = slice(int(cut[together + 1]), None)
        unit = np.searchsorted(start, at[late], side="right") - 1
        for i in np.flatnonzero(size > together).tolist():
            own = np.flatnonzero(unit == i)
            here = slice(int(start[i]), int(start[i] + size[i]) + 1)
            edges = (at[late][own] - start[i], piece[late][own], length[late][own])
            into[here], width[here], best[here], reached[here] = _alone(v, *edges, into[here], width[here], best[here], reached[here])
    if not reached[start + size].all():
        raise RuntimeError("the lattice of a unit has no way to its end")
    last = np.zeros(len(codes) + 1, bool)
    place = (start + size)[size > 0]
    begin = start[size > 0]
    while len(place):
        last[place] = True
        place = place - width[place]
        more = place > begin
        place, begin = place[more], begin[more]
    ends = np.flatnonzero(last)
    ids = into[ends]
    unit = np.searchsorted(start, ends - 1, side="right") - 1
    spelled = ids == SPELLED
    if spelled.any():
        odd = codes[ends[spelled] - 1]
        if v.has_bytes:
            raw = odd.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
            n = np.where(odd < 0x80, 1, np.where(odd < 0x800, 2, np.where(odd < 0x10000, 3, 4)))
        else:
            raw, n = b"", np.ones(len(odd), np.int64)
        times = np.ones(len(ids), np.int64)
        times[spelled] = n
        ids, unit, spelled = np.repeat(ids, times), np.repeat(unit, times), np.repeat(spelled, times)
        ids[spelled] = v.bytes_at[np.frombuffer(raw, np.uint8)] if v.has_bytes else v.unknown
    return ids.astype(np.int32), np.bincount(unit, minlength=len(units)).astype(np.int64)


def _alone(v: Vocabulary, at: np.ndarray, piece: np.ndarray, length: np.ndarray, into: np.ndarray, width: np.ndarray, best: np.ndarray, reached: np.ndarray):
    """Relaxes one unit's edges, in order of where they end, in a plain loop."""
    ins, wide, top, there = into.tolist(), width.tolist(), best.tolist(), reached.tolist()
    fits = v.scalar_follow()
    for s, p, n in zip(at.tolist(), piece.tolist(), length.tolist(), strict=True):
        if not there[s]:
            continue
        e = s + n
        if v.unigram:
            total = top[s] + (v.scores[p] if p >= 0 else v.spelled_score)
            if there[e] and total < top[e]:
                continue
            top[e] = total
        elif not fits(ins[s], p):
            continue
        ins[e], wide[e], there[e] = p, n, True
    return ins, wide, top, there


class Memory:
    """Ids of units of earlier batches, the least lately used forgotten first."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.number: dict[str, int] = {}
        self.begin, self.size, self.used = (np.empty(0, np.int64) for _ in range(3))
        self.ids = np.empty(0, np.int32)
        self.clock = 0

    def get(self, units: list[str]) -> np.ndarray:
        """Numbers of the units in begin and size."""
        self.clock += 1
        if len(self.number) > REMEMBERED_UNITS or len(self.ids) > REMEMBERED_IDS:
            self._forget()
        numbers = np.fromiter(map(self.number.get, units, repeat(-1)), np.int64, len(units))
        new = np.flatnonzero(numbers < 0)
        if len(new):
            fresh = [units[i] for i in new.tolist()]
            room = np.cumsum(np.fromiter(map(len, fresh), np.int64, len(fresh))) // CHARS_AT_ONCE
            bounds = np.append(np.unique(room, return_index=True)[1], len(fresh)).tolist()
            parts = [encode_units(self.v, fresh[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
            size = np.concatenate([c for _, c in parts])
            numbers[new] = len(self.size) + np.arange(len(new))
            self.number.update(zip(fresh, numbers[new].tolist(), strict=True))
            self.begin = np.append(self.begin, len(self.ids) + np.cumsum(size) - size)
            self.size = np.append(self.size, size)
            self.ids = np.concatenate([self.ids, *[i for i, _ in parts]])
            self.used = np.append(self.used, np.zeros(len(new), np.int64))
        self.used[numbers] = self.clock
        return numbers

    def _forget(self) -> None:
        keep = np.flatnonzero((self.used >= np.median(self.used)) & (self.size <= 64))
        if len(keep) > REMEMBERED_UNITS // 2:
            keep = np.sort(keep[np.argsort(-self.used[keep], kind="stable")[: REMEMBERED_UNITS // 2]])
        place = np.full(len(self.size), -1)
        place[keep] = np.arange(len(keep))
        self.number = {u: k for u, i in self.number.items() if (k := int(place[i])) >= 0}
        n = self.size[keep]
        self.ids = self.ids[np.repeat(self.begin[keep] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        self.begin, self.size, self.used = np.cumsum(n) - n, n, self.used[keep]


def _units(text: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct units without their first space mark, the unit at each place, and units for each text."""
    odd = pc.or_(pc.match_substring_regex(text, f"^ | $|  |{SPACE}"), pc.equal(text, "")).to_numpy(zero_copy_only=False)
    parts = pc.split_pattern(text, " ")
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = parts.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    whole = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
    units = pc.binary_join(whole, " ")[0].as_py().split(" ") if len(coded.dictionary) else []
    if not odd.any():
        return units, codes, counts
    number = {u: i for i, u in enumerate(units)}  # texts with runs of spaces have other units
    owner = np.split(codes, np.cumsum(counts)[:-1])
    for i in np.flatnonzero(odd).tolist():
        one = text[i].as_py()
        own = [u[1:] for u in _UNIT.findall(SPACE + one.replace(" ", SPACE))] if one else []
        owner[i] = np.array([number.setdefault(u, len(number)) for u in own], np.int64)
        counts[i] = len(own)
    used, codes = np.unique(np.concatenate(owner), return_inverse=True)
    units = list(number)
    return [units[i] for i in used.astype(np.int64).tolist()], codes, counts


def encode(m: Memory, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a batch, end to end, and how many each text has."""
    units, codes, counts = _units(pc.fill_null(column.cast(pa.string()), ""))
    numbers = m.get(units)
    begin, size = m.begin[numbers][codes], m.size[numbers][codes]
    end = np.cumsum(size)
    at = np.repeat(begin - end + size, size)
    at += np.arange(len(at))
    edge = np.append(0, end)[np.append(0, np.cumsum(counts))]
    return m.ids[at], np.diff(edge)


def decode(v: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """UTF-8 texts of runs of ids: pieces' bytes joined, without the leading space."""
    n = v.bytes_len[ids]
    data = v.bytes_flat[np.repeat(v.bytes_begin[ids] - np.cumsum(n) + n, n) + np.arange(n.sum())].tobytes()
    ends = np.append(0, np.cumsum(n))[np.append(0, np.cumsum(counts))].tolist()
    out = (data[a:b] for a, b in zip(ends, ends[1:], strict=False))
    return [x[1:] if x.startswith(b" ") else x for x in out]


#: On the driver, vocabularies by path; in a worker process, the memory of the one in use.
_INDEXED: dict[str, Vocabulary] = {}
_HELD: dict[str, Memory] = {}


def _memory(shared) -> Memory:
    name, vocabulary = shared.value
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = Memory(vocabulary)
    return _HELD[name]


def _indexed(model: str | None) -> Vocabulary:
    if (model or "") not in _INDEXED:
        _INDEXED[model or ""] = Vocabulary(load(model))
    return _INDEXED[model or ""]


def encode_documents(docs: DataFrame, model: str | None = None, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip; with digests, ids_sha256 and decoded_sha256 in place of the ids.

    ids_sha256 is that of the ids as little-endian 32-bit integers; round_trip
    says whether the decoded text is the text.
    """
    import uuid

    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, _indexed(model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _memory(shared)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for whole in batches:
            for b in text_parts(whole, 1):
                ids, counts = encode(m, b.column(1))
                ends = np.append(0, np.cumsum(counts))
                texts = decode(m.v, ids, counts)
                same = [x == (y.as_py() or b"") for x, y in zip(texts, b.column(1).cast(pa.binary()), strict=True)]
                if not digests:
                    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                    yield pa.record_batch([b.column(0), pa.array(counts), lists, pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids", "round_trip"])
                    continue
                words = [sha(ids[i:j].astype("<i4").tobytes()) for i, j in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
                yield pa.record_batch(
                    [b.column(0), pa.array(counts), pa.array(words), pa.array(list(map(sha, texts))), pa.array(same, pa.bool_())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"],
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    tail = "ids_sha256 string, decoded_sha256 string, round_trip boolean" if digests else "ids array<int>, round_trip boolean"
    return rows.mapInArrow(lambda batches: tidy(run(batches)), f"doc_id bigint, n_tokens bigint, {tail}")
