"""Token-id files with bit-plane shuffling.

A file holds the documents of one range of ids, in ascending order. Its ids are cut into blocks of a fixed
number; a block is transposed into bit planes (or byte planes), every plane is compressed with zstandard
by itself, and a chunk index at the end of the file says where each block and its planes lie:

``IDPL`` | planes of block 0 | planes of block 1 | ... | index | length of the index (8 bytes) | ``IDPL``

The index is compressed JSON: width and kind of planes, ids per block, for each block its place, its number
of ids and the lengths of its planes, and for each document its id and number of ids. Any range of ids
is read from the blocks it touches.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .shared import cut, shared_folder
from .word_tokens import word_encoder

MAGIC = b"IDPL"
BLOCK = 1 << 16  # ids
WIDTH = 16  # bits
LEVEL = 3
DOCS_PER_FILE = 10_000
END = 2


def encoded(df: DataFrame, path: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` of every row: 16-bit ids of the whole text and one id at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.array([end], dtype="<u2").tobytes()
        for batch in batches:
            ids = [x + last for x in word_encoder(path).encode(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, type=pa.binary())], ["doc_id", "ids"])

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, ids binary")


def to_planes(ids: np.ndarray, kind: str = "bit") -> list[bytes]:
    """The planes of a block of 16-bit ids, lowest first."""
    data = np.ascontiguousarray(ids, dtype="<u2").view(np.uint8).reshape(-1, WIDTH // 8)
    if kind == "bit":
        data = np.unpackbits(data, axis=1, bitorder="little")
        return [np.packbits(plane, bitorder="little").tobytes() for plane in data.T]
    return [plane.tobytes() for plane in data.T]


def from_planes(planes: list[bytes], count: int, kind: str = "bit") -> np.ndarray:
    rows = [np.frombuffer(p, dtype=np.uint8) for p in planes]
    if kind == "bit":
        bits = np.stack([np.unpackbits(r, count=count, bitorder="little") for r in rows], axis=1)
        return np.packbits(bits, axis=1, bitorder="little").view("<u2").ravel()
    return np.ascontiguousarray(np.stack(rows, axis=1)).view("<u2").ravel()


class Writer:
    """Writes one file; only the current block and the index are in memory."""

    def __init__(self, out, kind: str = "bit", block: int = BLOCK):
        self.out, self.kind, self.block = out, kind, block
        self.pack = zstandard.ZstdCompressor(level=LEVEL).compress
        self.blocks, self.docs, self.waiting, self.size, self.place = [], [], [], 0, len(MAGIC)
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id, len(ids) // 2))
        values = np.frombuffer(ids, dtype="<u2")
        while len(values):
            taken, values = values[: self.block - self.size], values[self.block - self.size :]
            self.waiting.append(taken)
            self.size += len(taken)
            if self.size == self.block:
                self._flush()

    def _flush(self) -> None:
        planes = [self.pack(p) for p in to_planes(np.concatenate(self.waiting), self.kind)]
        self.blocks.append((self.place, self.size, [len(p) for p in planes]))
        for plane in planes:
            self.out.write(plane)
            self.place += len(plane)
        self.waiting, self.size = [], 0

    def close(self) -> None:
        if self.size:
            self._flush()
        index = {"width": WIDTH, "planes": self.kind, "block": self.block, "blocks": self.blocks, "docs": self.docs}
        data = self.pack(json.dumps(index).encode())
        self.out.write(data + len(data).to_bytes(8, "little") + MAGIC)


class Reader:
    """Reads documents of a file through its index, block by block."""

    def __init__(self, source):
        size = source.size()
        source.seek(size - 12)
        tail = source.read(12)
        if tail[8:] != MAGIC:
            raise ValueError("not a token-id file, or not a whole one")
        length = int.from_bytes(tail[:8], "little")
        source.seek(size - 12 - length)
        self.source, self.unpack = source, zstandard.ZstdDecompressor().decompress
        self.index = json.loads(self.unpack(source.read(length)))

    def block(self, number: int) -> np.ndarray:
        place, count, lengths = self.index["blocks"][number]
        self.source.seek(place)
        data, planes = self.source.read(sum(lengths)), []
        for length in lengths:
            planes.append(self.unpack(data[:length]))
            data = data[length:]
        return from_planes(planes, count, self.index["planes"])

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids at places ``start`` to ``stop`` of the file."""
        size, parts = self.index["block"], []
        for number in range(start // size, -(-stop // size)):
            parts.append(self.block(number)[max(0, start - number * size) : stop - number * size])
        return np.concatenate(parts) if parts else np.zeros(0, dtype="<u2")

    def documents(self) -> Iterator[tuple[int | None, int, Iterator[np.ndarray]]]:
        """Id, start in the file and ids (in parts of a block at most) of every document, in order."""
        size, start, current, at = self.index["block"], 0, None, -1
        for doc_id, count in self.index["docs"]:
            parts, place, stop = [], start, start + count
            while place < stop:
                if place // size != at:
                    at = place // size
                    current = self.block(at)
                upto = min(stop, (at + 1) * size)
                parts.append(current[place - at * size : upto - at * size])
                place = upto
            yield doc_id, start, iter(parts)
            start = stop


def file_bounds(df: DataFrame, id_col: str = "doc_id", docs_per_file: int = DOCS_PER_FILE) -> list[int]:
    """Last ids of all files but the final one: quantiles of the id column, which alone is read."""
    column = df.select(F.col(id_col).cast("long").alias("doc_id"))
    rows, known = column.select(F.count("*"), F.count("doc_id")).first()
    files = -(-rows // docs_per_file)
    if files < 2 or not known:
        return []
    found = column.select(F.percentile_approx("doc_id", [i / files for i in range(1, files)], 100 * files)).first()[0]
    return sorted(set(found))


def write_files(ids: DataFrame, bounds: list[int], folder: str, kind: str = "bit") -> DataFrame:
    """Write ``doc_id, ids`` rows, in ascending order of ``doc_id`` over all files, into a folder.

    Gives ``file, path, n_docs, n_ids``. Rows without an id come first. A task writes under a name of its own
    and renames the whole file, so a repeated task does no harm.
    """
    limits = F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>")
    place = F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(limits, lambda b: b < F.col("doc_id"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        writer = current = out = None
        made = []

        def finish():
            writer.close()
            out.close()
            name = f"{root}/ids-{current:06d}.idpl"
            store.move(f"{name}.{attempt}", name)
            made.append((current, name, len(writer.docs), sum(n for _, n in writer.docs)))

        attempt = uuid.uuid4().hex
        for batch in batches:
            for number, doc_id, data in zip(*(batch.column(i) for i in range(3)), strict=True):
                number = number.as_py()
                if number != current:
                    if writer:
                        finish()
                    current = number
                    out = store.open_output_stream(f"{root}/ids-{current:06d}.idpl.{attempt}")
                    writer = Writer(out, kind)
                writer.add(doc_id.as_py(), data.as_py())
        if writer:
            finish()
        if made:
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, type=t) for x, t in zip(zip(*made, strict=True), (pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)],
                ["file", "path", "n_docs", "n_ids"],
            )

    parted = ids.select(place.cast("int").alias("file"), "doc_id", "ids").repartitionById(len(bounds) + 1, "file")
    return cut(parted.sortWithinPartitions("file", F.col("doc_id").asc_nulls_first()).mapInArrow(run, "file int, path string, n_docs long, n_ids long"))


def read_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files alone."""
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                with store.open_input_file(path) as source:
                    for doc_id, start, parts in Reader(source).documents():
                        crc = count = 0
                        for part in parts:
                            crc, count = zlib.crc32(part.astype("<u4").tobytes(), crc), count + len(part)
                        rows.append((doc_id, base + start, count, crc))
                yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = starts.select("path", "before", "file").repartitionById(max(1, manifest.count()), F.col("file")).drop("file")
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(df: DataFrame, path: str, end: int = END, folder: str | None = None, kind: str = "bit") -> DataFrame:
    """Encode whole texts, write them as token-id files and read the files back.

    One row per input row: ``doc_id, start, n_tokens, ids_crc32``; ``start`` counts the ids of all documents
    before it. Null and empty texts hold the end id alone. Rows with equal ids stand side by side in any
    order, rows without an id come first. An empty table writes no file and gives no row.
    """
    folder = folder or f"{shared_folder(df.sparkSession)}/token-files-{uuid.uuid4().hex}"
    manifest = write_files(encoded(df, path, end), file_bounds(df), folder, kind)
    return read_files(df.sparkSession, folder, manifest)
