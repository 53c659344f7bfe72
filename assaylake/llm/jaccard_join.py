"""Sets of word n-grams that overlap, by set-relation skipping.

*Index.* Every set lists its n-grams in one order, those that many documents hold last (by a count of hash buckets),
and enters the lists of the first ones only: linked sets share one of those. A list is sorted by size, and
a row skips all rows before it once neither their largest size nor their longest rest can reach the
threshold; lists of many rows are cut into blocks, pairs of which are units of work.

*Answers.* Sets that share a smallest hash (eight hash orders) with others are first compared with one of them,
the leader. A set linked with a leader differs from it in a known number of n-grams, so what the leader's comparison
with any other set has found bounds the set's own: ``|x ^ y| >= |r ^ y| - |r ^ x|``. Leaders stand for their clusters in
the lists; clusters that links connect already are not compared, and members meet in the same lists only where the bound
leaves it open. Bitmaps are compared inside the lists, and of the pairs between two components only the nearest one leaves
the lists at first, so that a large group does not give all its pairs. No link between sets of different components is lost.

*Comparisons.* The n-grams of two sets meet only where wide bitmaps, a few bits for each n-gram, leave a link open; all
other pairs keep the bound that these bitmaps give.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .components import components
from .shared import cut, tidy, windows

WORDS = 4
PERCENT = 85
BUCKETS = 1 << 21  # of n-gram hashes whose counts order them
KEYS = 8
BITS = 512
BLOCK = 4096  # rows of a list in a block
LOOKUP = 300_000  # rows whose texts are asked for by broadcast; beyond that they are joined by a shuffle
WINDOW = 1 << 20
TOGETHER = 1 << 18  # bytes of texts that are hashed together
GATHERED = 1 << 16
KNOWN = 1 << 17  # sets that a task remembers
LONG = 64  # bytes of a word beyond which it is hashed alone
LEADERS = 2  # that a set is compared with first

_rng = np.random.default_rng(12)
_FACTORS = _rng.integers(0, 1 << 63, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_KEYS = _rng.integers(0, 1 << 63, KEYS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_NO_SPACE = ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8)


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(30))


def word_hashes(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the lower-cased words of text bytes, and where the words begin. Texts begin at ``begins``, their words too."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = _LOWER[data]
    begins, word = begins[begins < len(data)], _NO_SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    first[begins] = word[begins]
    last[:-1] &= ~word[1:]
    last[begins[begins > 0] - 1] = word[begins[begins > 0] - 1]
    starts = np.flatnonzero(first)
    sizes = np.flatnonzero(last) + 1 - starts
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))  # the eight bytes from each place on
    values = _stir(sizes.astype(np.uint64) * _FACTORS[0] + (eight[starts] & _MASKS[np.minimum(sizes, 8)]))
    for k in range(8, LONG, 8):
        rows = np.flatnonzero(sizes > k)
        if not len(rows):
            break
        part = eight[starts[rows] + k] & _MASKS[np.minimum(sizes[rows] - k, 8)]
        values[rows] = _stir(values[rows] * _FACTORS[0] + part)
    for row in np.flatnonzero(sizes > LONG):
        values[row] = xxhash.xxh64_intdigest(padded[starts[row] : starts[row] + sizes[row]].tobytes())
    return values, starts


class Hasher:
    """The n-grams of texts as sorted distinct 64-bit hashes."""

    def __init__(self, words: int = WORDS):
        self.words = words

    def _combined(self, hashes: np.ndarray, words: int) -> np.ndarray:
        n = len(hashes) - words + 1
        out = np.full(n, words, dtype=np.uint64)
        for k in range(words):
            out = _stir(out * _FACTORS[k % 4] + hashes[k : k + n])
        return out

    def __call__(self, text: str | None) -> np.ndarray:
        carried, parts = np.zeros(0, dtype=np.uint64), []
        for part in windows((text or "").encode(), WINDOW):
            found, _ = word_hashes(np.frombuffer(part, dtype=np.uint8), np.zeros(1, dtype=np.int64))
            hashes = np.concatenate((carried, found))
            if len(hashes) >= self.words:
                parts.append(self._combined(hashes, self.words))
                hashes = hashes[len(hashes) - self.words + 1 :]
            carried = hashes
        if not parts:
            return self._combined(carried, len(carried)) if len(carried) else carried
        return np.unique(np.concatenate(parts))

    def each(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same for many texts: the hashes of some texts, one text after the other, and how many each text has."""
        texts = texts.fill_null("").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data, start = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8), 0
        while start < len(texts):
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + TOGETHER, "right")) - 1)
            if offsets[end] - offsets[start] > WINDOW:  # a long one alone, in windows
                hashes = self(texts[start].as_py())
                yield hashes, np.array([len(hashes)])
            else:
                yield self._several(data[offsets[start] : offsets[end]], offsets[start:end] - offsets[start])
            start = end

    def _several(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes, places = word_hashes(data, begins)
        texts = len(begins)
        words = np.bincount(np.searchsorted(begins, places, "right") - 1, minlength=texts)
        ends = np.cumsum(words)
        values, own = np.zeros(len(hashes), dtype=np.uint64), np.repeat(np.arange(texts), words)
        if len(hashes) >= self.words:
            values[: len(hashes) - self.words + 1] = self._combined(hashes, self.words)
        starts = np.arange(len(hashes)) + self.words <= ends[own]
        for text in np.flatnonzero((words > 0) & (words < self.words)):
            first = ends[text] - words[text]
            starts[first], values[first] = True, self._combined(hashes[first : ends[text]], words[text])[0]
        values, own = values[starts], own[starts]
        place = np.searchsorted(own, np.arange(texts + 1)).tolist()
        for a, b in zip(place, place[1:], strict=False):
            values[a:b].sort()
        new = np.ones(len(values), dtype=bool)
        new[1:] = (values[1:] != values[:-1]) | (own[1:] != own[:-1])
        return values[new], np.bincount(own[new], minlength=texts)


def name(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def parities(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Bitmaps of parities of sets, a row of longs each: sets differ in at least as many elements as their bitmaps in bits."""
    place = np.repeat(np.arange(len(lengths)) * BITS, lengths) + (hashes & np.uint64(BITS - 1)).astype(np.int64)
    counts = np.bincount(place, minlength=len(lengths) * BITS).reshape(-1, BITS)
    return np.packbits((counts & 1).astype(np.uint8), axis=1, bitorder="little").view("<i8")


def wide_parities(hashes: np.ndarray) -> bytes:
    """A bitmap of parities with two to four bits for each element, so that it tells large sets apart as well."""
    size = max(BITS, 1 << (2 * len(hashes) - 1).bit_length()) if len(hashes) else BITS
    counts = np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits(counts & 1, bitorder="little").tobytes()


def least_apart(one: np.ndarray, other: np.ndarray) -> int:
    """A lower bound of the elements in which two sets differ, from wide bitmaps (bytes); the larger one is folded."""
    small, large = sorted((one, other), key=len)
    folded = np.bitwise_xor.reduce(large.reshape(-1, len(small)), axis=0)
    return int(np.bitwise_count(folded ^ small).sum())


def needed(n, m, percent: int = PERCENT):
    """The least overlap of linked sets of sizes ``n`` and ``m``; for numbers, arrays and columns."""
    whole = percent * (n + m) + 99 + percent
    return F.floor(whole / (100 + percent)).cast("long") if isinstance(whole, Column) else whole // (100 + percent)


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))


_BASE = "doc_id long, key long, node long, n int, bits array<bigint>, mins array<bigint>, bucket int, seen long"


def sets(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """A row per document: ``doc_id, key, node, n, bits, mins``; and rows ``bucket, seen`` that count frequent n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, counts, total = Hasher(words), np.zeros(BUCKETS, dtype=np.int32), 0
        lists = lambda values, each: pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(each))).astype(np.int32), values)
        for batch in batches:
            nodes, sizes, bits, mins = [], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            for hashes, lengths in hasher.each(batch.column(2)):
                ends = np.cumsum(lengths)
                nodes += [name(hashes[a:b]) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                sizes.append(lengths)
                bits.append(parities(hashes, lengths).ravel())
                firsts = (ends - lengths)[lengths > 0]
                if len(firsts):
                    mins.append(np.stack([np.minimum.reduceat(hashes * f, firsts) for f in _KEYS], axis=1).view(np.int64).ravel())
                np.add.at(counts, (hashes >> np.uint64(43)).astype(np.int64), np.int32(1))
                total += len(hashes)
            sizes, bits, mins = (np.concatenate(x) for x in (sizes, bits, mins))
            made = [pa.array(nodes, type=pa.int64()), pa.array(sizes, type=pa.int32()), lists(bits, np.full(len(sizes), BITS // 64)), lists(mins, len(_KEYS) * (sizes > 0))]
            empty = [pa.nulls(len(batch), pa.int32()), pa.nulls(len(batch), pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made, *empty], _BASE_NAMES)
        # Buckets that stand out from chance among those of this task, however small it is; an order of n-grams needs no more.
        often = np.flatnonzero(counts > math.ceil(total / BUCKETS + 3 * math.sqrt(total / BUCKETS)))
        none = [pa.nulls(len(often), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*none, pa.array(often.astype(np.int32)), pa.array(counts[often].astype(np.int64))], _BASE_NAMES)

    return texts.mapInArrow(tidy(run), _BASE)


_BASE_NAMES = [field.split()[0] for field in _BASE.split(", ")]


def postings(texts: DataFrame, frequent: tuple[np.ndarray, np.ndarray], words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``token, node, n, rest``: the first n-grams of every set, and how many follow, itself included."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent)  # BUCKETS numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, counts, seen = Hasher(words), np.zeros(BUCKETS, dtype=np.uint16), set()
        counts[shared.value[0]] = np.log2(shared.value[1] + 1.0) * 1024  # sixteen bits are sorted fast
        for batch in batches:
            tokens, nodes, sizes, rests = [], [], [], []
            for hashes, each in hasher.each(batch.column(0)):
                common, end = counts[(hashes >> np.uint64(43)).astype(np.int64)], 0
                for n in each.tolist():
                    start, end = end, end + n
                    node = name(hashes[start:end])
                    if not n or node in seen:
                        continue
                    if len(seen) >= KNOWN:
                        seen.clear()
                    seen.add(node)
                    p = prefix_size(n, percent)
                    order = np.argsort(common[start:end], kind="stable")[:p]
                    tokens.append(hashes[start + order].view(np.int64))
                    nodes.append(node)
                    sizes.append(n)
                    rests.append(n - np.arange(p, dtype=np.int32))
            lengths = [len(t) for t in tokens]
            columns = [
                np.concatenate(tokens or [np.zeros(0, dtype=np.int64)]), np.repeat(np.array(nodes, dtype=np.int64), lengths),
                np.repeat(np.array(sizes, dtype=np.int32), lengths), np.concatenate(rests or [np.zeros(0)]).astype(np.int32),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "node", "n", "rest"])

    return texts.select("text").mapInArrow(tidy(run), "token long, node long, n int, rest int")


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of many rows at once; rows equal in the first columns stay together. Rows come sorted."""
    left: list[np.ndarray] | None = None
    for batch in batches:
        if not len(batch):
            continue
        new = [c.to_numpy() for c in batch.columns]
        rows = new if left is None else [np.concatenate(x) for x in zip(left, new, strict=True)]
        left = rows
        if len(rows[0]) < GATHERED:
            continue
        last = np.logical_and.reduce([rows[k] == rows[k][-1] for k in range(keys)])
        whole = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
        if whole:
            yield [r[:whole] for r in rows]
            left = [r[whole:] for r in rows]
    if left is not None:
        yield left


def shared_lists(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The postings whose list has another set of a size in reach, each set once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come by token, size and set, so the nearest size stands next to a row: no list is gathered.
        before: list[np.ndarray] | None = None  # the last row, whose next neighbour is not known yet
        fits = lambda a, b: (a[0] == b[0]) & (100 * a[2].astype(np.int64) >= percent * b[2].astype(np.int64))
        near = False  # whether that row has a neighbour before it
        for batch in batches:
            rows = [c.to_numpy() for c in batch.columns]
            if before is not None:
                rows = [np.concatenate(x) for x in zip(before, rows, strict=True)]
            new = np.concatenate(([True], (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]))) if len(rows[0]) else np.zeros(0, dtype=bool)
            rows = [r[new] for r in rows]
            if not len(rows[0]):
                continue
            ahead = fits([r[:-1] for r in rows], [r[1:] for r in rows])
            keep = np.concatenate(([near], ahead)) | np.concatenate((ahead, [False]))
            before, near = [r[-1:] for r in rows], bool(keep[-1])
            yield pa.RecordBatch.from_arrays([pa.array(r[:-1][keep[:-1]]) for r in rows], ["token", "node", "n", "rest"])
        if before is not None and near:
            yield pa.RecordBatch.from_arrays([pa.array(r) for r in before], ["token", "node", "n", "rest"])

    dealt = rows.repartition("token").sortWithinPartitions("token", "n", "node")
    return dealt.mapInArrow(tidy(run), "token long, node long, n int, rest int")


def _ends(pairs: np.ndarray) -> np.ndarray:
    """Of pairs ``(low, high, seen, a, b)``, one a column, the first and the last of each ``low`` and ``high``."""
    pairs = pairs[:, np.lexsort(pairs[::-1])]
    new = np.ones(pairs.shape[1] + 1, dtype=bool)
    new[1:-1] = (pairs[:2, 1:] != pairs[:2, :-1]).any(axis=0)
    return pairs[:, new[:-1] | new[1:]]


def met(lists: DataFrame, spans: DataFrame, percent: int = PERCENT, nearest: bool = False) -> DataFrame:
    """Pairs ``(a, b)`` of clusters of different components that may hold linked sets.

    ``nearest`` gives only the nearest pair of each two components, as ``low, high, a, b, more``: the components, the pair, and
    whether there are others.

    ``lists`` has ``token, leader, comp, low, high, rest``: the sizes of the members in the list, and the largest number of
    n-grams that follow. ``spans`` has ``node, off, high, bits`` of every leader; bitmaps are compared inside the lists, so that only
    pairs within reach leave them, and of those in one unit between two components the nearest and the farthest, if ``nearest``.
    """
    sizes = lists.groupBy("token").agg(F.count("*").alias("rows"), F.min("comp").alias("one"), F.max("comp").alias("other"))
    several = sizes.where("one <> other").select(F.col("token").alias("_token"), F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"))
    kept = lists.join(several, F.col("token") == F.col("_token")).drop("_token")
    bits = [f"bits{k}" for k in range(BITS // 64)]
    wide = spans.select(F.col("node").alias("leader"), "off", F.col("high").alias("most"), *[F.col("bits")[k].alias(c) for k, c in enumerate(bits)])
    own = F.pmod(F.xxhash64("leader"), F.col("blocks")).cast("int")
    placed = kept.join(wide, "leader").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    columns = ["low", "leader", "comp", "high", "rest", "own", "off", "most", *bits]
    units = placed.select("token", F.least("own", "other").alias("u"), F.greatest("own", "other").alias("v"), *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, u, v, low, leader, comp, high, rest, own, off, most, *bits in _whole_groups(batches, 3):
            n = len(token)
            head = np.concatenate(([True], (token[1:] != token[:-1]) | (u[1:] != u[:-1]) | (v[1:] != v[:-1])))
            place = np.arange(n) - np.maximum.accumulate(np.where(head, np.arange(n), 0))
            low, high, rest, off, most = (x.astype(np.int64) for x in (low, high, rest, off, most))
            bits = np.stack(bits, axis=1).view(np.uint64)  # unsigned, as bits of negative numbers are not counted
            group = np.cumsum(head)
            # The largest size and the longest rest among the rows of a unit up to each row.
            most_high = np.maximum.accumulate(high + (group << 40)) & ((1 << 40) - 1)
            most_rest = np.maximum.accumulate(rest + (group << 40)) & ((1 << 40) - 1)
            found, at, lag = [np.zeros((5, 0), dtype=np.int64)], np.arange(n), 0
            while len(at):
                lag += 1
                at = at[place[at] >= lag]
                to = at - lag
                # Skip all earlier rows of the unit at once.
                open_ = (100 * most_high[to] >= percent * low[at]) & (np.minimum(most_rest[to], rest[at]) >= needed(low[at], low[at] * percent // 100, percent))
                at, to = at[open_], to[open_]
                good = (100 * high[to] >= percent * low[at]) & (100 * high[at] >= percent * low[to]) & (comp[at] != comp[to])
                good &= np.minimum(rest[at], rest[to]) >= needed(low[at], low[to], percent)
                good &= (u[at] == v[at]) | (own[at] != own[to])
                if not good.any():
                    continue
                x, y = at[good], to[good]
                seen = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
                within = seen - off[x] - off[y] <= most[x] + most[y] - 2 * needed(most[x], most[y], percent)
                x, y, seen = x[within], y[within], seen[within]
                pair, comps = np.stack([leader[x], leader[y]]), np.stack([comp[x], comp[y]])
                found.append(np.stack([comps.min(axis=0), comps.max(axis=0), seen, pair.min(axis=0), pair.max(axis=0)]))
                if sum(f.shape[1] for f in found) > GATHERED:
                    found = [_ends(np.concatenate(found, axis=1))] if nearest else found
                    if found[0].shape[1] > GATHERED // 2 or not nearest:
                        yield batch_of(found)
                        found = [np.zeros((5, 0), dtype=np.int64)]
            yield batch_of([_ends(np.concatenate(found, axis=1))] if nearest else found)

    def batch_of(found: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(p)) for p in np.concatenate(found, axis=1)], ["low", "high", "seen", "a", "b"])

    dealt = units.repartition("token", "u", "v").sortWithinPartitions("token", "u", "v", "low", "leader")
    pairs = dealt.mapInArrow(tidy(run), "low long, high long, seen long, a long, b long")
    if not nearest:
        return pairs.select("a", "b").distinct()
    pair = F.struct("seen", "a", "b")
    ends = pairs.groupBy("low", "high").agg(F.min(pair).alias("p"), F.max(pair).alias("last"))
    return ends.select("low", "high", "p.a", "p.b", (F.col("p") != F.col("last")).alias("more"))


def _apart(one: str, other: str) -> Column:
    """Bits in which two bitmaps differ."""
    return sum((F.bit_count(F.col(one)[k].bitwiseXOR(F.col(other)[k])) for k in range(BITS // 64)), F.lit(0))


def _with(pairs: DataFrame, table: DataFrame, columns: list[str], sides: tuple[str, str] = ("a", "b")) -> DataFrame:
    """``columns`` of ``table`` (``node`` and others) for both sides of pairs, as ``a_name`` and ``b_name``."""
    for side in sides:
        pairs = pairs.join(table.select(F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns]), side)
    return pairs


def asked_sets(texts: DataFrame, nodes: DataFrame, asked: DataFrame, words: int = WORDS) -> DataFrame:
    """``node, n, wide, hashes`` of the asked nodes, once each, from one text of each."""
    wanted = cut(asked.join(nodes.select("node", "least"), "node").select("node", F.col("least.doc_id").alias("_id"), F.col("least.key").alias("_key")))
    small = F.broadcast(wanted) if wanted.count() <= LOOKUP else wanted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(words)
        for batch in batches:
            found = [hasher(t.as_py()) for t in batch.column(1)]
            same = pa.array([name(h) == n for h, n in zip(found, batch.column(0).to_pylist(), strict=True)], type=pa.bool_())
            wide, whole = (pa.array([f(h) for h in found], type=pa.binary()) for f in (wide_parities, np.ndarray.tobytes))
            sizes = pa.array([len(h) for h in found], type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, wide, whole], ["node", "n", "wide", "hashes"]).filter(same)

    read = texts.join(small, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    return cut(read.select("node", "text").mapInArrow(tidy(run), "node long, n long, wide binary, hashes binary").dropDuplicates(["node"]))


def overlaps(pairs: DataFrame, hashes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``a, b, linked, apart`` of each pair; ``apart`` is exact where a link was open, else a bound beyond the reach of links."""

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = (batch.column(k) for k in (4, 5))
            found = [least_apart(*(np.frombuffer(w.as_buffer(), dtype=np.uint8) for w in pair)) for pair in zip(*wide, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, type=pa.int64())], ["a", "b", "a_n", "b_n", "apart"])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = np.zeros(len(batch), dtype=np.int64)
            for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
                one, other = (np.frombuffer(h.as_buffer(), dtype=np.uint64) for h in (x, y))
                small, large = sorted((one, other), key=len)
                common = np.count_nonzero(large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small)
                apart[i] = len(one) + len(other) - 2 * common
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(apart)], ["a", "b", "a_n", "b_n", "apart"])

    out, open_ = "a long, b long, a_n long, b_n long, apart long", F.col("apart") <= _reach("a_n", "b_n", percent)
    known = _with(pairs.select("a", "b"), hashes, ["n", "wide"]).select("a", "b", "a_n", "b_n", "a_wide", "b_wide")
    known = cut(known.mapInArrow(tidy(bounds), out))
    both = _with(known.where(open_).drop("apart"), hashes, ["hashes"]).select("a", "b", "a_n", "b_n", "a_hashes", "b_hashes")
    every = both.mapInArrow(tidy(counts), out).union(known.where(~open_))
    return cut(every.select("a", "b", open_.alias("linked"), "apart"))


def _reach(n: str, m: str, percent: int) -> Column:
    """How many n-grams linked sets of two sizes may not have in common."""
    return F.col(n) + F.col(m) - 2 * needed(F.col(n), F.col(m), percent)


def _fits(percent: int) -> Column:
    """Whether two sizes can link, and the bitmaps leave a link open."""
    sizes = 100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")
    return sizes & (_apart("a_bits", "b_bits") <= _reach("a_n", "b_n", percent))


def _roots(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``node, comp`` of every node; unlinked ones are their own."""
    return cut(nodes.select("node").join(components(links), "node", "left").select("node", F.coalesce("root", "node").alias("comp")))


def _leaders(keyed: DataFrame, keys: list[str]) -> DataFrame:
    """``a, b``: every node ``b`` and the leader ``a`` of each key that it has in common with others.

    The leader is the node whose keys are the most common ones: in a group of copies the one in the middle, near which most are.
    """
    sizes = keyed.groupBy(*keys).agg(F.count("*").alias("sets")).where("sets > 1")
    shared = keyed.join(sizes, keys)
    shared = shared.join(shared.groupBy("node").agg(F.sum("sets").alias("common")), "node").select("node", "common", *keys)
    leaders = shared.groupBy(*keys).agg(F.max(F.struct("common", "node")).getField("node").alias("leader"))
    return shared.join(leaders, keys).where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b"))


def linked_sets(texts: DataFrame, words: int = WORDS, percent: int = PERCENT, more_keys=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All that link: ``base`` (a row per text), ``nodes`` (a row per set that is not empty), ``roots`` (``node, comp``).

    ``texts`` has ``doc_id, key, text``. ``more_keys`` gives keys (``node`` and others) from ``nodes`` and texts, by which sets
    find leaders first. What these link is not compared again by the smallest hashes and the lists.
    """
    made = cut(sets(texts, words))
    base = made.where("node is not null").select("doc_id", "key", "node", "n", "bits", "mins")
    first = lambda c: F.first(c).alias(c)
    nodes = cut(base.where("n > 0").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("least"), first("n"), first("bits"), first("mins")))

    # Relations: sets against the leader of those that share a key. Keys that are given come first; the smallest hashes
    # go on from what those have linked.
    roots = hashes = links = None
    if more_keys is not None:
        keyed = more_keys(nodes, texts)
        links, hashes = _related(keyed, [c for c in keyed.columns if c != "node"], texts, nodes, None, None, words, percent)
        roots = _roots(nodes, links)
    keyed = nodes.select("node", F.posexplode("mins").alias("k", "least_hash"))
    more, hashes = _related(keyed, ["k", "least_hash"], texts, nodes, roots, hashes, words, percent)
    roots = _roots(nodes, more) if roots is None else _joined(roots, more)
    relations = more if links is None else links.union(more)

    frequent = made.where("bucket is not null").groupBy("bucket").agg(F.sum("seen").alias("seen")).toArrow()
    lists = cut(shared_lists(postings(texts, tuple(frequent.column(k).to_numpy() for k in range(2)), words, percent), percent))
    clusters = relations.groupBy(F.col("b").alias("node")).agg(F.min(F.struct(F.col("a").alias("leader"), F.col("apart").alias("off"))).alias("l"))
    members = cut(
        roots.join(clusters, "node", "left")
        .select("node", F.coalesce("l.leader", "node").alias("leader"), F.coalesce("l.off", F.lit(0)).alias("off"), "comp")
    )
    spans = members.join(nodes.select("node", "n"), "node").groupBy("leader").agg(F.max("off").alias("off"), F.max("n").alias("high"))
    spans = cut(spans.join(nodes.select(F.col("node").alias("leader"), "bits"), "leader").withColumnRenamed("leader", "node"))

    # Clusters against clusters of other components, by the lists.
    named = lists.join(members.select("node", "leader", "comp"), "node")
    grouped = named.groupBy("token", "leader").agg(F.min("comp").alias("comp"), F.min("n").alias("low"), F.max("n").alias("high"), F.max("rest").alias("rest"))
    compared, roots, hashes = _connected(cut(grouped), spans, texts, nodes, roots, hashes, words, percent)

    # Members of clusters that are still apart, where the answer of their leaders leaves it open: by the same lists.
    # A leader may be a member of another cluster, so a cluster of one set may still have members besides its leader.
    open_ = _with(compared.select("a", "b", "apart"), spans, ["off", "high"]).where("a_off > 0 or b_off > 0")
    open_ = open_.where(F.col("apart") - F.col("a_off") - F.col("b_off") <= _reach("a_high", "b_high", percent))
    open_ = cut(_with(open_.select("a", "b"), roots, ["comp"]).where("a_comp <> b_comp").select("a", "b"))
    if not open_.isEmpty():
        asked = open_.select(F.col("a").alias("leader")).union(open_.select("b")).distinct()
        some = members.join(asked, "leader").select("node").join(roots, "node")
        alone = lists.join(some, "node").select("token", F.col("node").alias("leader"), "comp", F.col("n").alias("low"), F.col("n").alias("high"), "rest")
        each = some.join(nodes, "node").select("node", F.lit(0).alias("off"), F.col("n").alias("high"), "bits")
        _, roots, _ = _connected(cut(alone), cut(each), texts, nodes, roots, hashes, words, percent)
    return base, nodes, roots


def _related(
    keyed: DataFrame, keys: list[str], texts: DataFrame, nodes: DataFrame, roots: DataFrame | None, hashes: DataFrame | None, words: int, percent: int
) -> tuple[DataFrame, DataFrame]:
    """``a, b, apart``: links of sets ``b`` to leaders ``a`` with which they share keys, and the sets read so far.

    Pairs that ``roots`` connect are left out.
    """
    near = _leaders(keyed, keys).groupBy("a", "b").agg(F.count("*").alias("keys"))
    if roots is not None:
        near = _with(near, roots, ["comp"]).where("a_comp <> b_comp").select("a", "b", "keys")
    # A set may have a leader for each key; those with the most keys in common do. This bounds the work and loses no link.
    often = near.groupBy("b").agg(F.sort_array(F.collect_list(F.struct("keys", "a")), asc=False).alias("l"))
    near = often.select(F.explode(F.slice("l", 1, LEADERS)).alias("l"), "b").select("l.a", "b")
    near = cut(_with(near, nodes, ["n", "bits"]).where(_fits(percent)).select("a", "b"))
    hashes = _read_sets(near, texts, nodes, hashes, words)
    return overlaps(near, hashes, percent).where("linked").select("a", "b", "apart"), hashes


def _read_sets(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, known: DataFrame | None, words: int) -> DataFrame:
    """``asked_sets`` of both sides of pairs, added to those that are known."""
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    if known is None:
        return asked_sets(texts, nodes, asked, words)
    asked = cut(asked.join(known.select("node"), "node", "left_anti"))
    return known if asked.isEmpty() else known.union(asked_sets(texts, nodes, asked, words))


def _connected(
    lists: DataFrame, spans: DataFrame, texts: DataFrame, nodes: DataFrame, roots: DataFrame, hashes: DataFrame, words: int, percent: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``a, b, linked, apart`` of pairs that meet in lists (``met``), the roots with their links, and the sets read so far.

    Of the pairs between two components the nearest one is compared first, and only that one leaves the lists; where those
    stay apart and there are others, their lists are gone through again for all.
    """
    nearest = cut(met(lists, spans, percent, True))
    hashes = _read_sets(nearest, texts, nodes, hashes, words)
    compared = overlaps(nearest, hashes, percent)
    roots = _joined(roots, compared.where("linked"))
    # The components of lists are those from before; an end of a pair tells where each is now.
    left = _with(nearest.where("more").select("low", "high", "a", "b"), roots, ["comp"]).where("a_comp <> b_comp")
    asked = cut(left.select(F.explode(F.array("low", "high")).alias("comp")).distinct())
    if not asked.isEmpty():
        open_ = lists.join(asked, "comp", "left_semi").drop("comp").join(roots.withColumnRenamed("node", "leader"), "leader")
        others = cut(met(cut(open_), spans, percent).join(nearest.select("a", "b"), ["a", "b"], "left_anti"))
        hashes = _read_sets(others, texts, nodes, hashes, words)
        more = overlaps(others, hashes, percent)
        compared, roots = compared.union(more), _joined(roots, more.where("linked"))
    return compared, roots, hashes


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Roots that go on through more links: only components are linked, so this is far less than all links again."""
    between = _with(links.select("a", "b"), roots, ["comp"]).select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b"))
    moved = components(between).select(F.col("node").alias("comp"), "root")
    return cut(roots.join(moved, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")))


def jaccard_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id``.

    Texts are lower-cased (A to Z) and cut into words by white space. A set has the distinct four-word shingles; fewer
    words are one shingle. Sets link at a Jaccard similarity of 0.85 or more; ``component_id`` is the smallest id that
    links reach, itself included, null where no row of the component has an id. Null texts and texts without a word
    have no shingle and link with nothing. Repeated rows stay repeated. An empty table gives an empty result;
    other columns do not matter, whatever their names.
    """
    base, nodes, roots = linked_sets(_texts(df, id_col, text_col), words, percent)
    ids = roots.join(nodes.select("node", F.col("least.doc_id").alias("id")), "node")
    # Stored first, so that Spark can split the join where one component is very large.
    smallest = cut(ids.groupBy("comp").agg(F.min("id").alias("component_id")))
    found = cut(roots.join(smallest, "comp").select("node", "component_id"))
    some = base.where("n > 0").join(found, "node").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    return some.union(base.where("n = 0").select("doc_id", F.lit(0).cast("long"), "doc_id"))
