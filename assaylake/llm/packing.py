"""Best-fit packing into sequences, certified and repaired by lower bounds.

Pieces are dealt evenly to groups, and each group packs its own with best-fit decreasing. Dual feasible
functions over the lengths of a group give a lower bound of its number of sequences. A group that meets its
bound gives up its emptiest sequence only; a group with a gap gives up as many of its emptiest ones
as the gap asks for, several times over. What was given up is dealt to fewer groups, which so exchange
documents, and is packed again, until one group packs the rest or nothing can be gained.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import cut, tidy
from .word_tokens import word_encoder

CAPACITY = 4096
END = 1
PIECES_PER_GROUP = 20_000
RELEASED = 4  # sequences given up for each sequence of a gap
_ITEMS = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(df: DataFrame, path: str, end: int = END, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: the ids of each text and an end id, cut only where too long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.array([end], dtype="<u2").tobytes()
        for batch in batches:
            rows = []
            for doc_id, data in zip(batch.column(0).to_pylist(), word_encoder(path).encode(batch.column(1).to_pylist()), strict=True):
                ids = np.frombuffer(data + last, dtype="<u2")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append((doc_id, piece, start, len(part), zlib.crc32(part.astype("<u4").tobytes())))
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                arrays = [pa.array(x, type=t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32"])

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(tidy(run), _ITEMS)


@lru_cache(maxsize=4)
def _dual_feasible(capacity: int) -> list[tuple[np.ndarray, int]]:
    """Dual feasible functions as integer values of the lengths 0..capacity, with the value of a whole bin."""
    x, found = np.arange(capacity + 1, dtype=np.int64), []
    for cut_off in range(1, capacity // 2 + 1):
        found.append((np.where(x > capacity - cut_off, capacity, np.where(x < cut_off, 0, x)), capacity))
    for k in range(1, 21):  # steps of 1 / k; where (k + 1) x is a multiple of the capacity, x itself
        steps, rest = np.divmod((k + 1) * x, capacity)
        found.append((np.where(rest == 0, steps * k, steps * (k + 1)), k * (k + 1)))
    for small in range(2, capacity // 2 + 1, max(1, capacity // 512)):
        whole = capacity // small
        found.append((np.where(2 * x > capacity, whole - (capacity - x) // small, np.where(x < small, 0, 1)), whole))
    return found


def lower_bound(counts: np.ndarray, capacity: int = CAPACITY) -> float:
    """No packing of ``counts[length]`` pieces needs fewer bins; not rounded up."""
    return max((float(values @ counts) / whole for values, whole in _dual_feasible(capacity)), default=0.0)


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of every piece, and the room left in each bin. Longest first, tightest bin first."""
    bins, offsets, room = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r: some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        fitting = open_rooms >> length
        if fitting:
            left = length + (fitting & -fitting).bit_length() - 1
            place = by_room[left].pop()
            if not by_room[left]:
                open_rooms ^= 1 << left
        else:
            left, place = capacity, len(room)
            room.append(capacity)
        bins[i], offsets[i], room[place] = place, capacity - left, left - length
        if left > length:
            by_room[left - length].append(place)
            open_rooms |= 1 << (left - length)
    return bins, offsets, room


def _pack_group(round_number: int, capacity: int, last: bool):
    def run(key: tuple[pa.Scalar, ...], items: pa.Table) -> pa.Table:
        lengths = items.column("length").to_numpy()
        ids, parts = items.column("doc_id").fill_null(-1).to_numpy(), items.column("piece").to_numpy()
        order = np.lexsort((parts, ids, -lengths))  # the same packing whatever order the rows arrive in
        items, lengths = items.drop_columns(["group"]).take(order), lengths[order]
        bins, offsets, room = best_fit_decreasing(lengths, capacity)
        room, released = np.array(room), np.zeros(len(room), dtype=bool)
        if not last:
            gap = len(room) - lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
            emptiest = np.argsort(-room, kind="stable")[: 1 if gap < 1 else int(RELEASED * np.ceil(gap))]
            released[emptiest] = room[emptiest] > 0
        sequence = (round_number << 52) + (key[0].as_py() << 24) + bins
        for name, values in (("sequence_id", sequence), ("offset", offsets), ("released", released[bins])):
            items = items.append_column(name, pa.array(values))
        return items

    return run


def packed(items: DataFrame, capacity: int = CAPACITY, per_group: int = PIECES_PER_GROUP) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; the pieces of a sequence follow each other without gaps."""
    done, waiting, before = [], cut(items), None
    for round_number in range(64):
        count = waiting.count()
        groups = max(1, -(-count // per_group))
        last = groups == 1 or before is not None and count > 0.9 * before  # no more gain from exchanging
        group = F.pmod(F.xxhash64("doc_id", "piece", F.lit(round_number)), F.lit(groups))
        result = waiting.withColumn("group", group.cast("int")).groupBy("group")
        result = cut(result.applyInArrow(_pack_group(round_number, capacity, last), f"{_ITEMS}, sequence_id long, offset long, released boolean"))
        done.append(result.where("not released").drop("released"))
        if last:
            break
        waiting, before = result.where("released").select("doc_id", "piece", "start", "length", "ids_crc32"), count
    return reduce(DataFrame.unionByName, done)


def certificate(packs: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """Number of sequences, and a bound below which no packing can go. Reads one count per length."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, count in packs.groupBy("length").count().collect():  # as many rows as lengths at most
        counts[length] = count
    sequences = packs.select("sequence_id").distinct().count()
    return sequences, int(np.ceil(lower_bound(counts, capacity) - 1e-9))


def best_fit_packing(df: DataFrame, path: str, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null and empty texts are one piece that holds the end id. Only documents longer than a sequence are cut.
    Repeated rows are packed as often as they occur. An empty table gives an empty result.
    """
    return packed(pieces(df, path, end, capacity), capacity)
