"""Periodic runs of words: difference-cover LCE queries over a harmonic grid.

The texts of a chunk are one array of word numbers, each text followed by a mark of its own, so that no
match crosses texts. Suffixes are sorted only at places whose remainder modulo 31 lies in the difference
cover {0, 1, 3, 8, 12, 18}: for any two places some step below 31 leads both onto the cover. An LCE query
compares the few words up to there and answers the rest by a range minimum over the common prefixes of the
sorted sample. Steps backwards are the same queries on the array turned round.

A run of period ``q`` and at least four periods repeats itself over ``3 q`` words or more, so one of the grid
places ``0, 3 q, 6 q, ...`` lies in it. All grids together have ``n / 3 * (1 + 1/2 + 1/3 + ...)`` places; where the
words at a place and ``q`` later agree, LCE queries both ways give the whole run.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import windows

COVER = (0, 1, 3, 8, 12, 18)  # a perfect difference cover modulo 31
MODULUS = 31
LEAST = 6  # words of a run
PERIODS = 4
CHUNK = 1 << 18  # words that are searched at once; a longer text is a chunk of its own
WINDOW = 1 << 20

_MEMBER = np.zeros(MODULUS, dtype=bool)
_MEMBER[list(COVER)] = True
# The step that leads places with remainders a and b onto the cover.
_STEP = np.array([[next(s for s in range(MODULUS) if _MEMBER[(a + s) % MODULUS] and _MEMBER[(b + s) % MODULUS]) for b in range(MODULUS)] for a in range(MODULUS)])
_PLACE = np.cumsum(_MEMBER) - 1


class CommonExtensions:
    """How far the words from two places agree. Word numbers are not negative; the last word is unique."""

    def __init__(self, array: np.ndarray):
        self.n = len(array)
        self.array = np.concatenate([array.astype(np.int64), -1 - np.arange(2 * MODULUS)])  # no two places agree beyond the end
        blocks = -(-self.n // MODULUS) + 1
        sample = (np.arange(blocks)[:, None] * MODULUS + np.array(COVER)).ravel()
        self.sample = sample[sample < self.n]
        self._sort()

    def index(self, places: np.ndarray) -> np.ndarray:
        """The number of each place of the cover in the sample."""
        return places // MODULUS * len(COVER) + _PLACE[places % MODULUS]

    def _sort(self) -> None:
        """Order the sampled suffixes: three words at a time up to 31, then by ranks 31, 62, 124 words on."""
        size, base = len(self.sample), int(self.array[: self.n].max(initial=0)) + 2
        per = 3 if base < 1 << 21 else 1
        rank, levels = np.zeros(size, dtype=np.int64), []

        def refine(key) -> bool:
            """Split classes of equal ranks by a further key; ranks are the places where classes begin."""
            nonlocal rank
            order = np.argsort(rank, kind="stable")
            sorted_rank = rank[order]
            same = np.concatenate((sorted_rank[1:] == sorted_rank[:-1], [False]))
            tied = same | np.concatenate(([False], same[:-1]))
            members = order[tied]
            if not len(members):
                return False
            keys, classes = key(members), rank[members]
            inner = np.lexsort((keys, classes))
            members, keys, classes = members[inner], keys[inner], classes[inner]
            new_class = np.concatenate(([True], classes[1:] != classes[:-1]))
            new = new_class | np.concatenate(([True], keys[1:] != keys[:-1]))
            at = np.arange(len(members))
            starts = np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(new_class, at, 0))
            rank = rank.copy()
            rank[members] = classes + starts
            return True

        for first in range(0, MODULUS, per):
            take = min(per, MODULUS - first)

            def words(members, first=first, take=take):
                key = np.zeros(len(members), dtype=np.int64)
                for k in range(take):
                    key = key * base + np.maximum(self.array[self.sample[members] + first + k], -1) + 1
                return key

            if not refine(words):
                break
        levels.append(rank)
        span = MODULUS
        while span < self.n:

            def later(members, span=span):
                at = self.sample[members] + span
                return np.where(at < self.n, rank[np.minimum(self.index(np.minimum(at, self.n - 1 - (self.n - 1 - at) % MODULUS)), size - 1)], -1)

            if not refine(later):
                break
            levels.append(rank)
            span *= 2
        order = np.argsort(rank, kind="stable")
        self.rank = np.empty(size, dtype=np.int64)
        self.rank[order] = np.arange(size)
        self.table = [self._neighbours(self.sample[order[:-1]], self.sample[order[1:]], levels)]
        width = 1
        while 2 * width <= len(self.table[0]):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def _neighbours(self, one: np.ndarray, other: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Common prefixes of neighbours in the order: whole blocks by their ranks, then word by word."""
        one, other, total = one.copy(), other.copy(), np.zeros(len(one), dtype=np.int64)
        for level in range(len(levels) - 1, -1, -1):
            span, ranks = MODULUS << level, levels[level]
            inside = (one < self.n) & (other < self.n)
            at, to = self.index(np.where(inside, one, 0)), self.index(np.where(inside, other, 0))
            step = np.where(inside & (ranks[at] == ranks[to]), span, 0)
            one, other, total = one + step, other + step, total + step
        return total + self._words(np.minimum(one, self.n), np.minimum(other, self.n), np.full(len(one), MODULUS))

    def _words(self, one: np.ndarray, other: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from two places, ``most`` at most, compared one by one."""
        found, open_ = np.zeros(len(one), dtype=np.int64), np.arange(len(one))
        step = 0
        while len(open_):
            open_ = open_[(most[open_] > step) & (self.array[np.minimum(one[open_] + step, self.n + step)] == self.array[np.minimum(other[open_] + step, self.n + MODULUS)])]
            found[open_] += 1
            step += 1
        return found

    def common(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Length of the longest common extension of each pair of different places."""
        step = _STEP[one % MODULUS, other % MODULUS]
        total = self._words(one, other, step)
        on = np.flatnonzero((total == step) & (one + step < self.n) & (other + step < self.n))
        if len(on):
            a, b = self.rank[self.index(one[on] + step[on])], self.rank[self.index(other[on] + step[on])]
            low, high = np.minimum(a, b), np.maximum(a, b)
            level = np.frexp((high - low).astype(np.float64))[1] - 1
            lengths = np.zeros(len(on), dtype=np.int64)
            for k in np.unique(level):
                here = level == k
                lengths[here] = np.minimum(self.table[k][low[here]], self.table[k][high[here] - (1 << int(k))])
            total[on] += lengths
        return total


def runs_of(texts: list[np.ndarray]) -> list[np.ndarray]:
    """The runs of every text (word numbers from 0): rows ``start, length, period``, by start, then period."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in order], dtype=np.int64)
    marks = max((int(t.max(initial=0)) for t in texts), default=0) + 1
    starts = np.cumsum(sizes + 1) - sizes - 1
    array = np.concatenate([np.concatenate((texts[i], [marks + k])) for k, i in enumerate(order)] or [np.zeros(0, dtype=np.int64)])
    owner = np.repeat(np.arange(len(order)), sizes + 1)
    found_at, found_period = [], []
    longest = int(sizes[0]) if len(sizes) else 0
    for period in range(1, longest // PERIODS + 1):
        if longest < LEAST:
            break
        fits = int(np.searchsorted(-sizes, -max(LEAST, PERIODS * period), side="right"))
        end = int(starts[fits - 1] + sizes[fits - 1]) if fits else 0
        left, right = array[: max(0, end - period) : 3 * period], array[period : end : 3 * period]
        hits = np.flatnonzero(left == right) * (3 * period)
        if len(hits):
            found_at.append(hits)
            found_period.append(np.full(len(hits), period))
    out = [np.zeros((0, 3), dtype=np.int64)] * len(texts)
    if not found_at:
        return out
    at, period = np.concatenate(found_at), np.concatenate(found_period)
    # Five places at least repeat there, so two on one side do; only texts with such places are searched.
    padded = np.concatenate(([-1, -2], array, [-3, -4]))
    same = lambda step: padded[at + step + 2] == padded[np.minimum(at + period + step, len(array) + 1) + 2]
    likely = same(1) & same(2) | same(-1) & same(-2)
    at, period = at[likely], period[likely]
    busy = np.zeros(len(order), dtype=bool)
    busy[owner[at]] = True
    if len(at) and not busy.all():
        chosen = [order[k] for k in np.flatnonzero(busy)]
        for i, rows in zip(chosen, runs_of([texts[i] for i in chosen]), strict=True):
            out[i] = rows
        return out
    if not len(at):
        return out
    n = len(array)
    # Back steps: the words before two places are the words after them in the array turned round.
    ahead, back = CommonExtensions(array), CommonExtensions(array[::-1].copy())
    after = ahead.common(at, at + period)
    before = back.common(n - 1 - at, n - 1 - at - period) - 1
    length = before + after + period
    keep = length >= np.maximum(LEAST, PERIODS * period)
    start, length, period = (at - before)[keep], length[keep], period[keep]
    # A stretch is found by multiples of its period as well, and at several places: the smallest period counts.
    sort = np.lexsort((period, length, start))
    start, length, period = start[sort], length[sort], period[sort]
    new = np.concatenate(([True], (start[1:] != start[:-1]) | (length[1:] != length[:-1]))) if len(start) else np.zeros(0, dtype=bool)
    start, length, period = start[new], length[new], period[new]
    of = owner[start]
    rows = np.stack([start - starts[of], length, period], axis=1)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0], of))]
    bounds = np.searchsorted(np.sort(of), np.arange(len(order) + 1))
    for k, i in enumerate(order):
        out[i] = rows[bounds[k] : bounds[k + 1]]
    return out


def dropped(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words lie in a run after its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) > 0


def _words(text: str | None) -> Iterator[list[bytes]]:
    for part in windows((text or "").encode(), WINDOW):
        yield part.split()


def _numbered(text: str | None, known: dict[bytes, int]) -> np.ndarray:
    parts = [np.fromiter(map(known.__getitem__, found), dtype=np.int64, count=len(found)) for found in _words(text)]
    return np.concatenate(parts)


def _kept(text: str | None, drop: np.ndarray) -> bytes:
    out, at = [], 0
    for found in _words(text):
        here = drop[at : at + len(found)]
        out += [w for w, d in zip(found, here, strict=True) if not d] if here.any() else found
        at += len(found)
    return b" ".join(out)


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_words, runs, collapsed``.

    Words are what white space parts. ``runs`` has ``start, length, period`` (words) of every stretch with a smallest
    period, of six words and four periods at least, that neither neighbouring word extends; by start, then
    period. ``collapsed`` is the text without words that a run repeats, joined by single blanks. Null and empty
    texts have no words, no runs and an empty ``collapsed``. Texts may be of any length: one text is searched
    by one task. Repeated rows and rows without an id stay as they are; an empty table gives an empty result; other
    columns do not matter, whatever their names.
    """
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def made(ids: list, texts: list) -> pa.RecordBatch:
        known: dict[bytes, int] = defaultdict(lambda: len(known))
        numbers = [_numbered(t, known) for t in texts]
        found = runs_of(numbers)
        flat = np.concatenate([*found, np.zeros((0, 3), dtype=np.int64)])
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
        items = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(run_type.value_type))
        kept = [_kept(t, dropped(len(n), r)).decode() for t, n, r in zip(texts, numbers, found, strict=True)]
        columns = [pa.array(ids, type=pa.int64()), pa.array([len(n) for n in numbers], type=pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), items), pa.array(kept, type=pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, size = [], [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids.append(doc_id.as_py())
                texts.append(text.as_py())
                size += len(texts[-1] or "") // 6
                if size >= CHUNK:
                    yield made(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield made(ids, texts)

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
