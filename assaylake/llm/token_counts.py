"""Token counts by rank-synchronous array merging.

The pre-tokens of a batch that are not known yet lie in one flat array of symbols, ragged by their
offsets. In each step every pre-token finds its lowest-rank pair and all of them apply theirs at once;
pre-tokens without a pair are done, and their surviving symbols are counted. Counts of pre-tokens
are remembered, so a frequent one is merged once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import CACHED, CACHED_LENGTH, MergeList
from .pretokens import PIECE, pre_tokens, text_windows

LIMIT = 512
BATCH = 2 << 20  # characters of text whose new pre-tokens are merged together
NONE = np.int32(2**31 - 1)


class Counter:
    """Counts tokens as the byte-level BPE of a tokenizer file gives them."""

    def __init__(self, path: str):
        self.list = MergeList(path)
        self.of_byte = np.array(self.list.of_byte, dtype=np.int64)
        keys = np.array([a << 32 | b for a, b in self.list.rank], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), np.array(self.list.made, dtype=np.int64)
        self.lengths = np.zeros(max(self.list.bytes) + 1, dtype=np.int64)
        for token, data in self.list.bytes.items():
            self.lengths[token] = len(data)
        self.known: dict[str, int] = {}
        self.known_pieces: dict[str, int] = {}

    def pair_ranks(self, symbols: np.ndarray) -> np.ndarray:
        keys = symbols[:-1] << 32 | symbols[1:]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NONE)

    def merge(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Surviving symbols of non-empty pre-tokens, flat, and the number of them in each pre-token."""
        symbols = self.of_byte[np.frombuffer(b"".join(tokens), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
        done_symbols, done_owner = [], []
        while len(symbols):
            ranks = np.full(len(symbols), NONE, dtype=np.int32)
            inside = owner[1:] == owner[:-1]
            ranks[:-1][inside] = self.pair_ranks(symbols)[inside]
            starts = np.flatnonzero(np.concatenate(([True], ~inside)))
            lowest = np.minimum.reduceat(ranks, starts)
            sizes = np.diff(np.append(starts, len(symbols)))
            best = np.repeat(lowest, sizes)
            idle = best == NONE
            if idle.any():
                done_symbols.append(symbols[idle])
                done_owner.append(owner[idle])
            hit = (ranks == best) & ~idle
            # Of pairs that overlap (three equal symbols or more) every second one applies, from the left.
            chained = np.concatenate(([False], hit[:-1] & hit[1:] & inside))
            if chained.any():
                places = np.arange(len(hit))
                first = np.maximum.accumulate(np.where(hit & ~chained, places, -1))
                hit &= (places - first) % 2 == 0
            symbols[hit] = self.made[ranks[hit]]
            keep = ~idle
            keep[1:] &= ~hit[:-1]
            symbols, owner = symbols[keep], owner[keep]
        if not done_symbols:
            return symbols, np.zeros(len(tokens), dtype=np.int64)
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        return symbols[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(tokens))

    def long_count(self, token: bytes, read: int = 8192) -> int:
        """Count of one very long pre-token: windows are cut where tokens cannot change any more."""
        start, kept, total, ahead = 0, b"", 0, self.list.lookahead
        while True:
            kept, start = kept + token[start : start + read], start + read
            symbols, _ = self.merge([kept])
            if start >= len(token):
                return total + len(symbols)
            begins = np.concatenate(([0], np.cumsum(self.lengths[symbols])))
            stable = int(np.searchsorted(begins, len(kept) - ahead, side="right"))
            total, kept = total + stable, kept[begins[stable] :]

    def learn(self, tokens: list[str]) -> None:
        encoded = [t.encode() for t in tokens]
        short = [i for i, t in enumerate(encoded) if len(t) <= 8 * self.list.lookahead]
        if short:
            _, counts = self.merge([encoded[i] for i in short])
            self.known.update(zip((tokens[i] for i in short), counts.tolist(), strict=True))
        for i in set(range(len(tokens))) - set(short):
            self.known[tokens[i]] = self.long_count(encoded[i])

    def _parts(self, text: str) -> Iterator[str | None]:
        """Windows of a text; ``None`` stands for one special token."""
        special = self.list.special
        parts = self.list.split.split(text) if self.list.split and any(s in text for s in special) else [text]
        for part in parts:
            if part in special:
                yield None
            else:
                yield from text_windows(part, BATCH)

    def counts(self, texts: list[str | None]) -> list[int]:
        totals, waiting, size = [0] * len(texts), [], 0
        for row, text in enumerate(texts):
            for part in self._parts(text or ""):
                if part is None:
                    totals[row] += 1
                    continue
                waiting.append((row, part))
                size += len(part)
                if size >= BATCH:
                    self._add(totals, waiting)
                    waiting, size = [], 0
        self._add(totals, waiting)
        return totals

    def _add(self, totals: list[int], waiting: list[tuple[int, str]]) -> None:
        pieces = [(row, PIECE.findall(part)) for row, part in waiting]
        known = self.known_pieces
        fresh = {p for _, found in pieces for p in found if p not in known}
        cut = {p: pre_tokens(p) for p in fresh}
        tokens = {t for found in cut.values() for t in found}
        if len(self.known) + len(tokens) > CACHED:  # the memory stays bounded
            self.known.clear()
        self.learn(list(tokens - self.known.keys()))
        made = {p: sum(map(self.known.__getitem__, found)) for p, found in cut.items()}
        for row, found in pieces:
            totals[row] += sum([made[p] if p in made else known[p] for p in found])
        if len(known) + len(made) > CACHED:
            known.clear()
        known.update((p, n) for p, n in made.items() if len(p) <= CACHED_LENGTH)


@lru_cache(maxsize=1)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_tokens, over_limit``.

    Null and empty texts have no bytes and no tokens. Special strings in a text count as one token.
    Repeated rows stay repeated; other columns do not matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = counter(path).counts(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(counts, type=pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return source.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
