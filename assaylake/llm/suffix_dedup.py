"""Removal of text that repeats across documents, with suffix arrays per shard.

Every window of 50 bytes is named by the smallest hash among its 16-byte strings (its minimizer), and runs of
windows with the same minimizer are taken together as segments. Equal windows have equal minimizers, so

1. texts are stored in compressed blocks, each with a number of its own;
2. blocks send the distinct minimizers of their windows, dealt by value, and learn which of them occur in
   more than one document; whole copies of an earlier document are found by digest;
3. segments of such minimizers go to the shard of the minimizer, equal ones only once per block. A shard
   builds suffix arrays over runs of bounded size, finds equal windows by their common prefixes, and merges
   the sorted windows of its runs by binary search, keeping the smallest document id of each;
4. blocks learn that id for their windows, and remove those that start in a smaller document.

Windows of a minimizer with very many different segments are dealt by their own content instead, so no shard
grows with one frequent string. Nothing but block and shard numbers and their byte strings is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .shared import cut, tidy
from .suffix_arrays import binary_search, may_repeat, merged, repeated_grams

SIZE = 50  # bytes of a window
PART = 16  # bytes of the strings that name it
STEP = 1 << 16  # bytes that are scanned at once
RUN = 64  # windows of a segment at most
BLOCK = 4 << 20  # bytes of text in a block
SHARD = 2 << 20  # bytes of the segments of a shard
ARRAY = 1 << 19  # bytes under one suffix array
ANCHORS = 1 << 20  # minimizers that one bucket compares
HOT = 20_000  # segments of a minimizer above which windows are dealt by content
NO_ID = np.iinfo(np.int64).max  # rows without an id come after all others
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD))


def blocks(df: DataFrame, text_col: str, id_col: str, block: int = BLOCK) -> DataFrame:
    """Rows to blocks ``block, ids, digests, sizes, texts, others``: all columns, texts compressed."""
    source = df.withColumn(text_col, F.coalesce(F.col(text_col), F.lit("")))
    place, id_place = df.columns.index(text_col), df.columns.index(id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number, waiting, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def made() -> pa.RecordBatch:
            rows = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            texts = [x.as_py().encode() for x in rows.column(place)]
            ids = rows.column(id_place).cast(pa.int64()).fill_null(NO_ID)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema.remove(place)) as stream:
                stream.write_batch(pa.RecordBatch.from_arrays([c for i, c in enumerate(rows.columns) if i != place], schema=rows.schema.remove(place)))
            pack = zstandard.ZstdCompressor(level=5).compress
            sizes = np.array([len(t) for t in texts], dtype=np.int64).tobytes()
            values = [base + number, ids.to_pylist(), [hashlib.sha256(t).digest() for t in texts], sizes, pack(b"".join(texts)), pack(sink.getvalue().to_pybytes())]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(values, kinds, strict=True)], ["block", "ids", "digests", "sizes", "texts", "others"])

        for batch in batches:
            lengths, start = [len(x.as_py()) for x in batch.column(place)], 0
            for stop in range(1, len(batch) + 1):
                size += lengths[stop - 1]
                if size >= block:
                    waiting.append(batch.slice(start, stop - start))
                    yield made()
                    number, waiting, size, start = number + 1, [], 0, stop
            if start < len(batch):
                waiting.append(batch.slice(start))
        if waiting:
            yield made()

    return source.mapInArrow(tidy(run), "block long, ids array<long>, digests array<binary>, sizes binary, texts binary, others binary")


class Block:
    """The texts of a block and the segments of their windows."""

    def __init__(self, texts: bytes, sizes: bytes):
        self.data = zstandard.ZstdDecompressor().decompress(texts)
        self.raw = np.frombuffer(self.data, dtype=np.uint8)
        self.sizes = np.frombuffer(sizes, dtype=np.int64)
        self.ends = np.cumsum(self.sizes)
        self.begins = self.ends - self.sizes

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, number of windows, minimizer (48 bits) and document of each segment, in text order."""
        found = []
        for start in range(0, len(self.raw), STEP):  # steps that stay in the processor's cache
            part = self.raw[start : start + STEP + SIZE - 1]
            if len(part) >= SIZE:
                found.append(self._segments(part, start))
        if not found:
            return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.uint64, np.int64))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _segments(self, part: np.ndarray, base: int) -> tuple[np.ndarray, ...]:
        words = np.ndarray(len(part) - 7, dtype="<u8", buffer=part, strides=(1,))  # the eight bytes at every place
        hashes = words[:-8] * _MIX[0]
        hashes ^= hashes >> np.uint64(32)
        hashes += words[8:]
        hashes *= _MIX[1]
        hashes ^= hashes >> np.uint64(29)
        hashes *= _MIX[0]
        hashes >>= np.uint64(16)
        least, width, count = hashes, 1, SIZE - PART + 1
        while width * 2 <= count:
            least, width = np.minimum(least[:-width], least[width:]), width * 2
        if width < count:
            least = np.minimum(least[: len(least) - (count - width)], least[count - width :])
        n = len(least)
        breaks = np.concatenate(([True], least[1:] != least[:-1]))
        for edge in (self.begins, np.maximum(self.begins, self.ends - SIZE + 1)):
            at = edge - base
            breaks[at[(at > 0) & (at < n)]] = True
        starts = np.flatnonzero(breaks)
        lengths = np.diff(np.append(starts, n))
        parts = -(-lengths // RUN)  # long runs of one minimizer are cut
        if (parts > 1).any():
            step = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
            left = np.repeat(lengths, parts) - step * RUN
            starts, lengths = np.repeat(starts, parts) + step * RUN, np.minimum(left, RUN)
        document = np.searchsorted(self.ends, starts + base, side="right")
        inside = starts + base + SIZE <= self.ends[np.minimum(document, len(self.ends) - 1)]
        return (starts + base)[inside], lengths[inside], least[starts][inside], document[inside]


def _six(values: np.ndarray) -> np.ndarray:
    """48-bit numbers as six bytes each."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])


def _from_six(data: np.ndarray) -> np.ndarray:
    full = np.zeros((len(data), 8), dtype=np.uint8)
    full[:, :6] = data
    return full.view("<u8").ravel()


def minimizers(stored: DataFrame, buckets: int) -> DataFrame:
    """``bucket, block, found, more``: distinct minimizers of each block, with their number and whether documents share them.

    ``found`` counts to 127; ``more`` has the place and the rest of each higher count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, sizes, texts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                _, _, names, document = Block(texts, sizes).segments()
                if not len(names):
                    continue
                order = np.argsort(names, kind="stable")
                names, document = names[order], document[order]
                heads = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
                count = np.diff(np.append(heads, len(names)))
                shared = np.minimum.reduceat(document, heads) != np.maximum.reduceat(document, heads)
                names = names[heads]
                rows = np.concatenate([_six(names), np.minimum(count, 127)[:, None].astype(np.uint8) | shared[:, None].astype(np.uint8) << 7], axis=1)
                bucket = _bucket(names, buckets)
                order = np.argsort(bucket, kind="stable")
                rows, bucket, count = rows[order], bucket[order], count[order]
                edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
                spans = list(zip(edges, [*edges[1:], len(rows)], strict=True))
                found, more = [rows[a:b].tobytes() for a, b in spans], [_rest(count[a:b]) for a, b in spans]
                columns = [pa.array(bucket[edges], type=pa.int32()), pa.array([block] * len(edges), type=pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, type=pa.binary()), pa.array(more, type=pa.binary())], ["bucket", "block", "found", "more"])

    return stored.select("block", "sizes", "texts").mapInArrow(tidy(run), "bucket int, block long, found binary, more binary")


def _rest(count: np.ndarray) -> bytes:
    high = np.flatnonzero(count > 127)
    return np.stack([high, count[high] - 127], axis=1).astype("<u4").tobytes()


def _bucket(names: np.ndarray, buckets: int) -> np.ndarray:
    """Even buckets of the 48-bit names. Minimizers are small numbers, so they are mixed first."""
    return ((names * _MIX[0] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def _compare(hot: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        blocks_, parts = rows.column("block").to_pylist(), rows.column("found").to_pylist()
        data = [np.frombuffer(p, dtype=np.uint8).reshape(-1, 7) for p in parts]
        names = np.concatenate([_from_six(d[:, :6]) for d in data])
        marks = np.concatenate([d[:, 6] for d in data])
        known, inverse, times = np.unique(names, return_inverse=True, return_counts=True)
        count, start = (marks & 127).astype(np.float64), 0
        for part, rest in zip(data, rows.column("more").to_pylist(), strict=True):
            place, high = np.frombuffer(rest, dtype="<u4").reshape(-1, 2).T
            count[start + place] += high
            start += len(part)
        total = np.bincount(inverse, weights=count, minlength=len(known))
        shared = times > 1
        shared[inverse[marks > 127]] = True
        keep = shared[inverse]
        rows = np.concatenate([_six(names), (total[inverse] > hot)[:, None].astype(np.uint8)], axis=1)
        owner = np.repeat(np.arange(len(parts)), [len(d) for d in data])[keep]
        rows, edges = rows[keep], np.searchsorted(owner, np.arange(len(parts) + 1))
        out = [(b, rows[edges[i] : edges[i + 1]].tobytes()) for i, b in enumerate(blocks_) if edges[i + 1] > edges[i]]
        return pa.table([pa.array([b for b, _ in out], type=pa.int64()), pa.array([x for _, x in out], type=pa.binary())], names=["block", "shared"])

    return run


class Cut:
    """The segments of a block that may repeat, dealt to shards; equal segments of a shard count once."""

    def __init__(self, block: Block, ids: np.ndarray, copies: np.ndarray, shared: list[bytes], shards: int):
        """``copies`` marks documents that equal an earlier one: they are removed anyway."""
        known = np.concatenate([np.frombuffer(x, dtype=np.uint8).reshape(-1, 7) for x in shared]) if shared else np.zeros((0, 7), dtype=np.uint8)
        names, hot = _from_six(known[:, :6]), known[:, 6] > 0
        order = np.argsort(names)
        names, hot = names[order], hot[order]
        starts, lengths, name, document = block.segments()
        at = np.minimum(np.searchsorted(names, name), max(0, len(names) - 1))
        keep = (names[at] == name) if len(names) else np.zeros(len(name), dtype=bool)
        keep &= ~copies[document]
        starts, lengths, name, document, at = (x[keep] for x in (starts, lengths, name, document, at))
        very = hot[at] if len(names) else keep[:0]
        if very.any():  # one segment for each window
            step = np.arange(int(lengths[very].sum())) - np.repeat(np.cumsum(lengths[very]) - lengths[very], lengths[very])
            single = np.repeat(starts[very], lengths[very]) + step
            starts = np.concatenate([starts[~very], single])
            document = np.concatenate([document[~very], np.repeat(document[very], lengths[very])])
            lengths = np.concatenate([lengths[~very], np.ones(len(single), dtype=np.int64)])
            content = [int.from_bytes(hashlib.blake2b(block.data[s : s + SIZE], digest_size=6).digest(), "little") for s in single.tolist()]
            name = np.concatenate([name[~very], np.array(content, dtype=np.uint64)])
        self.starts, self.lengths, self.ids = starts, lengths, ids[document]
        shard = (name % np.uint64(shards)).astype(np.int64)
        # Equal segments have the same minimizer, and so the same shard.
        data, numbers = block.data, {}
        number = numbers.setdefault
        segment = np.array([number(data[a:b], len(numbers)) for a, b in zip(starts.tolist(), (starts + lengths + SIZE - 1).tolist(), strict=True)], dtype=np.int64)
        texts = list(numbers)
        order = np.argsort(segment, kind="stable")
        heads = np.flatnonzero(np.concatenate(([True], segment[order][1:] != segment[order][:-1]))) if len(order) else order
        least = np.minimum.reduceat(self.ids[order], heads) if len(order) else self.ids
        most = np.maximum.reduceat(self.ids[order], heads) if len(order) else self.ids
        of_text = shard[order[heads]]
        dealt = np.argsort(of_text, kind="stable")
        edges = np.flatnonzero(np.concatenate(([True], of_text[dealt][1:] != of_text[dealt][:-1]))) if len(dealt) else dealt
        place = np.empty(len(texts), dtype=np.int64)  # number of a segment among those of its shard
        self.parts: list[tuple[int, list[bytes], np.ndarray, np.ndarray]] = []
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(dealt)], strict=False):
            mine = dealt[a:b]
            place[mine] = np.arange(b - a)
            self.parts.append((int(of_text[mine[0]]), [texts[i] for i in mine.tolist()], least[mine], most[mine]))
        self.shard, self.segment = shard, place[segment] if len(segment) else segment


def _cut(row: dict, shards: int) -> tuple[Block, np.ndarray, np.ndarray, Cut]:
    block, ids = Block(row["texts"], row["sizes"]), np.array(row["ids"], dtype=np.int64)
    copies = np.zeros(len(ids), dtype=bool)
    copies[row["copies"] or []] = True
    return block, ids, copies, Cut(block, ids, copies, row["shared"] or [], shards)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(len(batch)):
        yield batch.slice(i, 1).to_pylist()[0]


def _packed(texts: list[bytes], least: np.ndarray, most: np.ndarray) -> bytes:
    """Segments with their smallest and largest ids; ids byte by byte, so that they compress well."""
    lengths = np.array([len(t) for t in texts], dtype="<u2")
    ids = np.stack([least, most - least]).astype("<i8").view(np.uint8).reshape(2, -1, 8).transpose(0, 2, 1)
    return len(texts).to_bytes(4, "little") + lengths.tobytes() + np.ascontiguousarray(ids).tobytes() + b"".join(texts)


def _unpacked(data: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    count = int.from_bytes(data[:4], "little")
    lengths = np.frombuffer(data, dtype="<u2", count=count, offset=4)
    ids = np.frombuffer(data, dtype=np.uint8, count=16 * count, offset=4 + 2 * count).reshape(2, 8, count)
    least, more = np.ascontiguousarray(ids.transpose(0, 2, 1)).view("<i8").reshape(2, count)
    ends = np.cumsum(lengths.astype(np.int64)) + 4 + 18 * count
    return [data[a:b] for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)], least, least + more


def segments(stored: DataFrame, shards: int) -> DataFrame:
    """``shard, block, segments``: the distinct segments of each block for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for row in _rows(batch):
                _, _, _, found = _cut(row, shards)
                out = [(shard, row["block"], pack(_packed(texts, least, most))) for shard, texts, least, most in found.parts]
                if out:
                    kinds = (pa.int32(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["shard", "block", "segments"])

    return stored.mapInArrow(tidy(run), "shard int, block long, segments binary")


def _resolve(limit: int):
    """Smallest document of every window of a shard, told to the blocks that hold larger ones."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        unpack, numbers, ids, sources = zstandard.ZstdDecompressor().decompress, {}, [], []
        for block, data in zip(rows.column("block").to_pylist(), rows.column("segments").to_pylist(), strict=True):
            texts, least, most = _unpacked(unpack(data))
            mine = np.array([numbers.setdefault(t, len(numbers)) for t in texts], dtype=np.int64)
            ids.append((mine, least))
            sources.append((block, mine, most))
        texts, smallest_of = list(numbers), np.full(len(numbers), NO_ID, dtype=np.int64)
        for mine, least in ids:  # a segment occurs once in a block
            smallest_of[mine] = np.minimum(smallest_of[mine], least)
        ids = smallest_of
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        # Windows that no other segment has belong to their own segment's smallest document.
        again = np.flatnonzero(may_repeat(texts, SIZE))
        edges = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes[again]) // limit)) + 1).tolist(), len(again)]
        runs, all_grams = [], None
        for a, b in zip(edges, edges[1:], strict=False):
            if a < b:
                grams, of_window, _ = repeated_grams([texts[i] for i in again[a:b].tolist()], ids[again[a:b]], SIZE)
                runs.append((grams, of_window))
                all_grams = grams if all_grams is None else merged(all_grams, grams)
        smallest = np.repeat(ids, sizes - SIZE + 1)
        if runs:
            found = [all_grams.smallest[binary_search(all_grams.words, g.words)[0]][w] if len(runs) > 1 else g.smallest[w] for g, w in runs]
            use = np.zeros(len(texts), dtype=bool)
            use[again] = True
            smallest[np.repeat(use, sizes - SIZE + 1)] = np.concatenate(found)
        windows = sizes - SIZE + 1
        first = np.cumsum(windows) - windows
        out = []
        for block, mine, most in sources:
            # Stretches of windows with one answer, where some document of this block may lose them.
            count = windows[mine]
            place = np.repeat(first[mine] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            segment, offset, answer = np.repeat(np.arange(len(mine)), count), place - np.repeat(first[mine], count), smallest[place]
            use = answer < np.repeat(most, count)
            segment, offset, answer = segment[use], offset[use], answer[use]
            if not len(segment):
                continue
            heads = np.flatnonzero(np.concatenate(([True], (segment[1:] != segment[:-1]) | (answer[1:] != answer[:-1]) | (offset[1:] != offset[:-1] + 1))))
            length = np.diff(np.append(heads, len(segment)))
            table = np.zeros(len(heads), dtype=_ANSWER)
            table["segment"], table["offset"], table["length"], table["smallest"] = segment[heads], offset[heads], length, answer[heads]
            out.append((block, key[0].as_py(), table.tobytes()))
        kinds = (pa.int64(), pa.int32(), pa.binary())
        columns = zip(*out, strict=True) if out else ([], [], [])
        return pa.table([pa.array(list(x), type=t) for x, t in zip(columns, kinds, strict=True)], names=["block", "shard", "answers"])

    return run


_ANSWER = np.dtype([("segment", "<u4"), ("offset", "u1"), ("length", "u1"), ("smallest", "<i8")])


def _covered(block: Block, copies: np.ndarray, found: Cut, answers: list[dict]) -> np.ndarray:
    """Which bytes of a block are removed."""
    change = np.zeros(len(block.raw) + 1, dtype=np.int64)
    order = np.lexsort((found.segment, found.shard))
    shard, segment = found.shard[order], found.segment[order]
    for answer in answers:
        table = np.frombuffer(answer["answers"], dtype=_ANSWER)
        a, b = np.searchsorted(shard, [answer["shard"], answer["shard"] + 1])
        low, high = (np.searchsorted(segment[a:b], table["segment"], side=s) + a for s in ("left", "right"))
        times = high - low
        row = np.repeat(np.arange(len(table)), times)
        place = order[np.repeat(low - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))]
        lost = table["smallest"][row] < found.ids[place]
        start = (found.starts[place] + table["offset"][row])[lost]
        np.add.at(change, start, 1)
        np.add.at(change, start + table["length"][row][lost].astype(np.int64) + SIZE - 1, -1)
    for document in np.flatnonzero(copies & (block.sizes >= SIZE)):
        change[block.begins[document]] += 1
        change[block.ends[document]] -= 1
    return np.cumsum(change[:-1]) > 0


def kept_texts(stored: DataFrame, shards: int, make, schema: str) -> DataFrame:
    """Let ``make(others, kept, spans, sizes)`` build the rows of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                block, _, copies, found = _cut(row, shards)
                covered = _covered(block, copies, found, row["answers"] or [])
                edges = np.flatnonzero(np.diff(np.concatenate(([0], covered.astype(np.int8), [0]))))
                starts = np.unique(np.concatenate([edges[::2], block.begins[covered[np.minimum(block.begins, max(0, len(covered) - 1))] & (block.sizes > 0)] if len(covered) else edges[:0]]))
                document = np.searchsorted(block.ends, starts, side="right")
                stops = np.minimum(edges[1::2][np.searchsorted(edges[1::2], starts, side="right")] if len(starts) else starts, block.ends[document] if len(starts) else starts)
                kept, spans = [], []
                cuts = np.searchsorted(document, np.arange(len(block.sizes) + 1))
                for i, (begin, end) in enumerate(zip(block.begins.tolist(), block.ends.tolist(), strict=True)):
                    mine = list(zip(starts[cuts[i] : cuts[i + 1]].tolist(), stops[cuts[i] : cuts[i + 1]].tolist(), strict=True))
                    at, parts = begin, []
                    for start, stop in mine:
                        parts.append(block.data[at:start])
                        at = stop
                    kept.append(b"".join([*parts, block.data[at:end]]))
                    spans.append([{"start": a - begin, "stop": b - begin} for a, b in mine])
                others = zstandard.ZstdDecompressor().decompress(row["others"])
                with pa.ipc.open_stream(others) as stream:
                    yield make(stream.read_next_batch(), kept, spans, block.sizes)

    return stored.mapInArrow(tidy(run), schema)


def resolved(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, shard: int = SHARD, hot: int = HOT) -> tuple[DataFrame, int]:
    """Blocks with everything that decides what is removed, and the number of shards."""
    stored = cut(blocks(df, text_col, id_col, block))
    parallel = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parallel, -(-stored.count() * block // (18 * ANCHORS)))  # a minimizer for each 18 bytes or so
    found = minimizers(stored, buckets).groupBy("bucket").applyInArrow(_compare(hot), "block long, shared binary")
    shared = cut(found)
    number = shared.select(F.sum(F.octet_length("shared") / 7)).first()[0] or 0
    shards = max(parallel, int(-(-number * 70 // shard)))
    documents = stored.select("block", F.posexplode(F.arrays_zip("ids", "digests")).alias("place", "document"))
    documents = documents.select("block", "place", F.col("document.ids").alias("id"), F.col("document.digests").alias("digest"))
    least = documents.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("digest", "least")
    # Stored first, so that Spark can split the join where one text has very many copies.
    copies = documents.join(cut(least), "digest").where("id > least").groupBy("block").agg(F.collect_list("place").alias("copies"))
    told = shared.groupBy("block").agg(F.collect_list("shared").alias("shared"))
    # Both uses below read the same columns, so that the blocks are shuffled once.
    columns = stored.select("block", "ids", "sizes", "texts", "others")
    ready = columns.join(cut(told.join(copies, "block", "full_outer")), "block", "left")
    answers = segments(ready, shards).groupBy("shard").applyInArrow(_resolve(ARRAY), "block long, shard int, answers binary")
    answers = answers.groupBy("block").agg(F.collect_list(F.struct("shard", "answers")).alias("answers"))
    return ready.join(answers, "block", "left"), shards


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, spans, kept``.

    ``spans`` are the removed stretches of the UTF-8 text (bytes, start and stop), ``kept`` the bytes that are
    left. A byte goes if a string of 50 bytes that covers it also starts in a document with a smaller id.
    Null counts as empty; texts below 50 bytes stay. Rows without an id count as larger than all ids and
    remove nothing from each other, and neither do rows with the same id. Other columns do not matter.
    """
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ready, shards = resolved(source, **settings)
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def make(others, kept, spans, sizes):
        return pa.RecordBatch.from_arrays([others.column(0), pa.array(sizes), pa.array(spans, type=span), pa.array(kept, type=pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return kept_texts(ready, shards, make, "doc_id long, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary")


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The same rows and columns with repeated text removed; bytes of a character that lost others go too."""
    ready, shards = resolved(df, id_col, text_col, **settings)
    names, place = df.columns, df.columns.index(text_col)

    def make(others, kept, spans, sizes):
        columns = list(others.columns)
        columns.insert(place, pa.array([k.decode(errors="ignore") for k in kept], type=pa.string()))
        return pa.RecordBatch.from_arrays(columns, names)

    return kept_texts(ready, shards, make, ", ".join(f"`{c}` {t}" for c, t in df.dtypes))
