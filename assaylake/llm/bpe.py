"""Byte-level BPE as a streaming transducer with bounded lookahead, and its decoder.

Merges apply in the order of their rank, and a merge can only be disturbed by an earlier one that took or
made the symbol on its right. Such disturbances run to the left through merges of rising rank; the
longest such run over the merge list is its *sufficient lookahead*. A token that starts that many bytes
before the end of what has been read cannot change any more, whatever follows, so it is emitted; what
is left is read again together with the next bytes. Memory does not depend on the text.

Decoding joins the bytes of the tokens and turns them into text with an incremental UTF-8 decoder.
"""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .pretokens import PIECE, pre_tokens, text_windows

WINDOW = 1 << 20  # characters of a text that are looked at together
CACHED = 250_000  # pieces, and as many pre-tokens, that a Python worker remembers
CACHED_LENGTH = 64  # of characters; longer pieces are not remembered


def byte_symbols() -> dict[str, int]:
    """The public table that shows every byte as one printable character."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class MergeList:
    """A vocabulary with ranked merges, from the JSON file of a byte-level BPE tokenizer."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        symbols, model = byte_symbols(), data["model"]
        as_bytes = lambda token: bytes(symbols[c] for c in token)
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.ids = {as_bytes(t): i for t, i in model["vocab"].items() if t not in self.special}
        self.bytes = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.of_byte = [self.ids[bytes([b])] for b in range(256)]
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        pairs = [(as_bytes(a), as_bytes(b)) for a, b in pairs]
        self.rank = {(self.ids[a], self.ids[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.made, self.none = [self.ids[a + b] for a, b in pairs], len(pairs)
        self.lookahead = sufficient_lookahead(pairs)
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces: dict[str, bytes] = {}
        self.tokens: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[int]:
        """The tokens of a short byte string: the lowest rank first, the leftmost place first."""
        symbols = [self.of_byte[b] for b in data]
        if len(symbols) > 80:
            return self._merge_long(symbols)
        rank, none = self.rank.get, self.none
        ranks = [rank(pair, none) for pair in zip(symbols, symbols[1:])]  # noqa: B905
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            symbols[i : i + 2] = (self.made[best],)
            del ranks[i]
            if i:
                ranks[i - 1] = rank((symbols[i - 1], symbols[i]), none)
            if i < len(ranks):
                ranks[i] = rank((symbols[i], symbols[i + 1]), none)
        return symbols

    def _merge_long(self, symbols: list[int]) -> list[int]:
        rank, n = self.rank, len(symbols)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank[p], i, *p) for i, p in enumerate(zip(symbols, symbols[1:])) if p in rank]  # noqa: B905
        heapify(heap)
        while heap:
            best, i, a, b = heappop(heap)
            j = right[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = self.made[best], -1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
            for x, y in ((left[i], i), (i, k)):
                if x >= 0 and y < n and (found := rank.get((symbols[x], symbols[y]))) is not None:
                    heappush(heap, (found, x, symbols[x], symbols[y]))
        return [s for s in symbols if s >= 0]

    def stream(self, data: bytes, read: int = 4096) -> Iterator[list[int]]:
        """The tokens of a pre-token of any length, in lists, each emitted as soon as it is stable."""
        read = max(read, 2 * self.lookahead)
        start, kept = 0, b""
        while start < len(data):
            kept, start = kept + data[start : start + read], start + read
            tokens = self.merge(kept)
            if start >= len(data):
                yield tokens
                return
            done = count = 0
            while done + self.lookahead <= len(kept):
                done, count = done + len(self.bytes[tokens[count]]), count + 1
            yield tokens[:count]
            kept = kept[done:]

    def piece(self, piece: str) -> bytes:
        """The ids of a piece, four bytes each."""
        if (known := self.pieces.get(piece)) is not None:
            return known
        found = b"".join(map(self.token, pre_tokens(piece)))
        if len(piece) <= CACHED_LENGTH:
            remember(self.pieces, piece, found)
        return found

    def token(self, token: str) -> bytes:
        """The ids of a pre-token."""
        if (known := self.tokens.get(token)) is not None:
            return known
        data = token.encode()
        if len(data) > self.lookahead:
            return b"".join(np.array(ids, dtype="<u4").tobytes() for ids in self.stream(data))
        ids = self.merge(data)
        found = pack(f"<{len(ids)}I", *ids)
        if len(token) <= CACHED_LENGTH:
            remember(self.tokens, token, found)
        return found

    def encode(self, text: str) -> Iterator[bytes]:
        """The ids of a text, window by window; special strings become their own ids."""
        parts = self.split.split(text) if self.split and any(s in text for s in self.special) else [text]
        for part in parts:
            if part in self.special:
                yield np.array([self.special[part]], dtype="<u4").tobytes()
                continue
            for window in text_windows(part, WINDOW):
                yield b"".join(map(self.piece, PIECE.findall(window)))

    def decode(self, ids: np.ndarray, size: int = WINDOW) -> Iterator[str]:
        """Text of ids, block by block: bytes that do not end a character yet wait for the next block."""
        state = codecs.getincrementaldecoder("utf-8")(errors="replace")
        for start in range(0, len(ids), size):
            yield state.decode(b"".join(map(self.bytes.__getitem__, ids[start : start + size].tolist())))
        yield state.decode(b"", final=True)


def remember(cache: dict, key: str, value) -> None:
    """Keep a value; a full cache starts again, so that its size stays bounded."""
    if len(cache) >= CACHED:
        cache.clear()
    cache[key] = value


def sufficient_lookahead(pairs: list[tuple[bytes, bytes]]) -> int:
    """Bytes after a token's start beyond which the text cannot change it.

    ``reach[u]`` is the longest disturbance so far that arrives at a symbol which starts with ``u``. A
    merge ``(a, b)`` passes on what arrives at any beginning of ``b``, over the length of ``a``. Ranks rise
    along a disturbance, provided that every merge comes after those that make its parts.
    """
    reach: dict[bytes, int] = {}
    made: set[bytes] = set()
    longest = 1
    for a, b in pairs:
        if any(len(x) > 1 and x not in made for x in (a, b)):
            raise ValueError("the merge list is not in the order of its derivations")
        made.add(a + b)
        passed = max((reach.get(b[:i], 0) for i in range(1, len(b) + 1)), default=0)
        total = len(a) + max(len(b), passed)
        longest = max(longest, total)
        reach[a] = max(reach.get(a, 0), total)
    return longest


@lru_cache(maxsize=2)
def merge_list(path: str) -> MergeList:
    return MergeList(path)


def encode(df: DataFrame, path: str, text_col: str = "text", into: str = "ids") -> DataFrame:
    """Add the token ids of a text column as binary, little-endian unsigned 32-bit numbers.

    Null texts count as empty, and empty texts have no ids. All other columns stay; ``into`` may not be
    one of them.
    """
    return _added(df, into, "binary", text_col, _encoder(path))


def decode(df: DataFrame, path: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """Add the text of ids as ``encode`` writes them, special tokens included. Null counts as no ids."""
    return _added(df, into, "string", ids_col, _decoder(path))


def _encoder(path):
    return lambda text: b"".join(merge_list(path).encode(text or ""))


def _decoder(path):
    return lambda ids: "".join(merge_list(path).decode(np.frombuffer(ids or b"", dtype="<u4")))


def _added(df: DataFrame, into: str, kind: str, source: str, change) -> DataFrame:
    if into in df.columns:
        raise ValueError(f"there is a column {into} already")
    place, kinds = df.columns.index(source), {"binary": pa.large_binary(), "string": pa.large_string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([change(x.as_py()) for x in batch.column(place)], type=kinds[kind])
            made = made.cast(pa.binary() if kind == "binary" else pa.string()) if made.nbytes < 1 << 31 else made
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, into])

    fields = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return df.select("*").mapInArrow(run, f"{fields}, `{into}` {kind}")


def digests(df: DataFrame) -> DataFrame:
    """Number and digests of encoded and decoded columns."""
    return df.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
