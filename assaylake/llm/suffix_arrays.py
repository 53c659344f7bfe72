"""Suffix arrays in numpy: Larsson-Sadakane refinement, Kasai common prefixes, merging by binary search."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SYMBOLS = 6  # of ten bits each, in the first sort key


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and rank of every position, for symbols 0..1022.

    The first sort is by six symbols; what lies behind the end is smaller than all of them. Each refinement looks at the ranks ``h`` places on, sorts only the
    groups that are still tied, and doubles ``h``.
    """
    n = len(text)
    padded = np.concatenate([text.astype(np.int64) + 1, np.zeros(SYMBOLS, dtype=np.int64)])
    key = np.zeros(n, dtype=np.int64)
    for i in range(SYMBOLS):
        key = key << 10 | padded[i : i + n]
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.concatenate(([True], key[1:] != key[:-1]))
    heads = np.maximum.accumulate(np.where(first, np.arange(n), 0))  # where the group of each place starts
    rank = np.empty(n, dtype=np.int64)
    rank[order] = heads
    tied = np.flatnonzero(~(first & np.append(first[1:], True)))  # places in groups of two or more
    h = SYMBOLS
    while len(tied):
        positions = order[tied]
        ahead = np.where(positions + h < n, rank[np.minimum(positions + h, n - 1)] + 1, 0)
        group = rank[positions]
        by = np.argsort(group * (n + 1) + ahead, kind="stable")
        positions, group, ahead = positions[by], group[by], ahead[by]
        order[tied] = positions
        first = np.concatenate(([True], (group[1:] != group[:-1]) | (ahead[1:] != ahead[:-1])))
        heads = np.maximum.accumulate(np.where(first, tied, 0))
        rank[positions] = heads
        tied = tied[~(first & np.append(first[1:], True))]
        h *= 2
    return order, rank


def common_prefixes(text: np.ndarray, order: np.ndarray, rank: np.ndarray, starts: np.ndarray, lengths: np.ndarray, most: int) -> np.ndarray:
    """Common prefix, up to ``most``, of each suffix and the one before it in the array.

    Kasai's rule: stepping one place to the right loses one symbol at most. Stretches that start at ``starts``
    are independent of each other, so all of them take each step together. Other places stay 0.
    """
    n = len(text)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    found = np.zeros(n, dtype=np.int64)
    padded = np.concatenate([text.astype(np.int32), np.full(most + 1, -1, dtype=np.int32)])
    by = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[by], lengths[by]
    common = np.zeros(len(starts), dtype=np.int64)
    for step in range(int(lengths[0]) if len(lengths) else 0):
        alive = int(np.searchsorted(-lengths, -step, side="left"))
        at = starts[:alive] + step
        other = before[at]
        common = np.where(other >= 0, np.maximum(common[:alive] - 1, 0), 0)
        going = np.flatnonzero((other >= 0) & (common < most))
        while len(going):
            same = padded[at[going] + common[going]] == padded[other[going] + common[going]]
            going = going[same]
            common[going] += 1
            going = going[common[going] < most]
        found[at] = common
    return found


@dataclass
class Grams:
    """Distinct strings of one length in sorted order, as rows of 64-bit words, with the smallest id of each."""

    words: np.ndarray
    smallest: np.ndarray


def words_of(text: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """The strings at these places as big-endian words, so that rows compare like strings."""
    padded = np.concatenate([text, np.zeros(8, dtype=np.uint8)])
    columns = []
    for start in range(0, size, 8):
        word = np.zeros(len(places), dtype=np.uint64)
        for i in range(8):
            word = word << np.uint64(8)
            if start + i < size:
                word |= padded[places + (start + i)].astype(np.uint64)
        columns.append(word)
    return np.stack(columns, axis=1) if columns else np.zeros((len(places), 0), dtype=np.uint64)


def binary_search(rows: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the first row that is not below each wanted row, and whether it is equal."""
    low, high = np.zeros(len(wanted), dtype=np.int64), np.full(len(wanted), len(rows), dtype=np.int64)
    while len(rows) and (open_ := low < high).any():
        middle = np.minimum((low + high) // 2, len(rows) - 1)
        below, decided = np.zeros(len(wanted), dtype=bool), np.zeros(len(wanted), dtype=bool)
        for column in range(rows.shape[1]):
            mine, theirs = rows[middle, column], wanted[:, column]
            below |= ~decided & (mine < theirs)
            decided |= mine != theirs
            if decided.all():
                break
        low, high = np.where(open_ & below, middle + 1, low), np.where(open_ & ~below, middle, high)
    if not len(rows):
        return low, np.zeros(len(wanted), dtype=bool)
    return low, (low < len(rows)) & (rows[np.minimum(low, len(rows) - 1)] == wanted).all(axis=1)


def merged(a: Grams, b: Grams) -> Grams:
    """Two shards' strings as one sorted list: those of ``b`` are located in ``a`` by binary search."""
    place, equal = binary_search(a.words, b.words)
    smallest = a.smallest.copy()
    np.minimum.at(smallest, place[equal], b.smallest[equal])
    new = ~equal
    return Grams(np.insert(a.words, place[new], b.words[new], axis=0), np.insert(smallest, place[new], b.smallest[new]))


def joined(segments: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments with a zero byte behind each: bytes, starts, lengths, and the place of every window of ``size``."""
    lengths = np.array([len(s) for s in segments], dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    raw = np.frombuffer(b"\0".join(segments) + b"\0", dtype=np.uint8)
    windows = lengths - size + 1
    places = np.repeat(starts - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
    return raw, starts, lengths, places


def may_repeat(segments: list[bytes], size: int) -> np.ndarray:
    """Which segments hold a window whose hash occurs twice; the windows of all others are unique."""
    raw, _, lengths, places = joined(segments, size)
    padded = np.concatenate([raw, np.zeros(8, dtype=np.uint8)])
    words = np.ndarray(len(raw), dtype="<u8", buffer=padded, strides=(1,))
    value = np.zeros(len(places), dtype=np.uint64)
    for at in [*range(0, size - 7, 8), size - 8]:
        value = (value ^ (value >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + words[places + at]
    value = (value ^ (value >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    value ^= value >> np.uint64(33)
    ordered = np.sort(value)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    hit = np.zeros(len(value), dtype=bool)
    if len(twice):
        hit = twice[np.minimum(np.searchsorted(twice, value), len(twice) - 1)] == value
    windows = lengths - size + 1
    return np.add.reduceat(hit.astype(np.int64), np.cumsum(windows) - windows) > 0


def repeated_grams(segments: list[bytes], ids: np.ndarray, size: int) -> tuple[Grams, np.ndarray, np.ndarray]:
    """The strings of ``size`` bytes in the segments of a shard, and for every window its place among them.

    ``ids`` has the smallest id of each segment. Windows are numbered through, segment by segment.
    """
    raw, starts, lengths, places = joined(segments, size)
    text = raw.astype(np.int16) + 1
    text[starts + lengths] = 0
    order, rank = suffix_array(text)
    windows = lengths - size + 1
    common = common_prefixes(text, order, rank, starts, windows, size)
    by = np.argsort(rank[places])
    sorted_places = places[by]
    fresh = common[sorted_places] < size
    fresh[:1] = True
    number = np.cumsum(fresh) - 1
    heads = np.flatnonzero(fresh)
    owner = np.repeat(np.arange(len(segments)), windows)
    grams = Grams(words_of(raw, sorted_places[heads], size), np.minimum.reduceat(ids[owner[by]], heads))
    of_window = np.empty(len(places), dtype=np.int64)
    of_window[by] = number
    return grams, of_window, owner
