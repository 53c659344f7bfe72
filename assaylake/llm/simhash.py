"""SimHash near-duplicates by anchor-point covering.

The 64 bits are cut into two blocks. Two fingerprints that differ in at most two bits differ in at most
one bit of the first block, or agree in the second. In the first block the anchors are the words of the
perfect Hamming code of length 31: every value lies within one bit of exactly one anchor, so a value and
every neighbour at one bit meet at the anchor of either of them, which is within two bits of both. A
fingerprint therefore has one home anchor and sixteen anchors (or one) within two bits. In the second
block, where no bit may differ, every value is its own anchor. Fingerprints meet per anchor, homes
against replicas, and distances are compared on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .components import components
from .shared import cut, windows

WORDS = 3
SEED = 42
BITS = 31  # of the first block, the length of the Hamming code
CHECKS = 5  # its parity checks
DISTANCE = 2
WINDOW = 1 << 20


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The SimHash of a text as an unsigned number; 0 without any word."""
    counts, total, carried = np.zeros(64, dtype=np.int64), 0, []
    data = (text or "").encode().lower()
    for part in windows(data, WINDOW):
        found = carried + part.split()
        shingles = [b" ".join(x) for x in zip(*(found[i:] for i in range(words)), strict=False)]
        carried = found[len(found) - words + 1 :] if words > 1 and len(found) >= words else found if words > 1 else []
        if shingles:
            counts += _bit_counts(shingles)
            total += len(shingles)
    if not total and carried:
        counts, total = _bit_counts([b" ".join(carried)]), 1
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0]) if total else 0


def _bit_counts(shingles: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), dtype="<u8", count=len(shingles))
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``doc_id, fingerprint`` (a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)), dtype="<u8", count=len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fingerprint"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, fingerprint long"
    )


def _near_masks() -> list[list[int]]:
    """For each syndrome the changes that lead from a value to the anchors within two bits; the home first."""
    found = [[0]]
    for syndrome in range(1, 1 << CHECKS):
        pairs = [(i, i ^ syndrome) for i in range(1, BITS + 1) if i < i ^ syndrome]
        found.append([1 << (syndrome - 1)] + [1 << (i - 1) | 1 << (j - 1) for i, j in pairs])
    return found


def _syndrome(block: Column) -> Column:
    """The Hamming syndrome: the exclusive or of the numbers 1..31 of the set bits."""
    total = F.lit(0)
    for check in range(CHECKS):
        mask = sum(1 << (i - 1) for i in range(1, BITS + 1) if i >> check & 1)
        parity = F.bit_count(block.bitwiseAND(F.lit(mask))).bitwiseAND(F.lit(1))
        total = total + parity * (1 << check)
    return total


def anchored(prints: DataFrame) -> DataFrame:
    """Distinct fingerprints to ``fingerprint, family, anchor, home``, one row per anchor in reach."""
    low = F.col("fingerprint").bitwiseAND(F.lit((1 << BITS) - 1))
    masks = F.array(*[F.array(*[F.lit(m).cast("long") for m in row]) for row in _near_masks()])
    first = (
        prints.select("fingerprint", low.alias("low"), F.element_at(masks, (_syndrome(low) + 1).cast("int")).alias("masks"))
        .select("fingerprint", "low", F.posexplode("masks").alias("place", "mask"))
        .select("fingerprint", F.lit(0).alias("family"), F.col("low").bitwiseXOR(F.col("mask")).alias("anchor"), (F.col("place") == 0).alias("home"))
    )
    second = prints.select(
        "fingerprint", F.lit(1).alias("family"), F.shiftrightunsigned("fingerprint", BITS).alias("anchor"), F.lit(True).alias("home")
    )
    return first.unionByName(second)


def links(prints: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of distinct fingerprints that differ in one or two bits, each pair once.

    A fingerprint has no more than 2,080 neighbours at that distance, so the pairs grow in proportion.
    """
    reach = anchored(prints)
    homes = reach.where("home").select(F.col("fingerprint").alias("a"), "family", "anchor")
    others = reach.select(F.col("fingerprint").alias("b"), "family", "anchor")
    apart = F.col("a").bitwiseXOR(F.col("b"))
    in_first = F.bit_count(apart.bitwiseAND(F.lit((1 << BITS) - 1)))
    return (
        homes.join(others, ["family", "anchor"])
        .where((F.col("a") < F.col("b")) & (F.bit_count(apart) <= DISTANCE))
        .where((F.col("family") == 0) == (in_first < DISTANCE))
        .select("a", "b")
    )


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint`` (16 hex digits), ``component_id``.

    Fingerprints link at two or fewer differing bits; ``component_id`` is the smallest id that can be
    reached, null where no row of the group has an id. Texts that are null, empty or without a word
    have the fingerprint zero and link like any other. Repeated rows stay repeated. An empty table
    gives an empty result; other columns do not matter.
    """
    base = cut(fingerprints(df, id_col, text_col, words))
    smallest = cut(base.groupBy("fingerprint").agg(F.min("doc_id").alias("smallest")))
    roots = cut(components(links(smallest.select("fingerprint"))).withColumnRenamed("node", "fingerprint"))
    linked = cut(roots.join(smallest, "fingerprint"))
    # Stored first, so that Spark can split the join where one component is very large.
    reached = cut(linked.groupBy("root").agg(F.min("smallest").alias("component_id")))
    group = smallest.join(linked.join(reached, "root").select("fingerprint", "component_id"), "fingerprint", "left").select(
        "fingerprint", F.coalesce("component_id", "smallest").alias("component_id")
    )
    return base.join(cut(group), "fingerprint").select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """The documents that stay, one of each group, with all their columns. Rows without an id stay."""
    groups = near_groups(df.where(F.col(id_col).isNotNull()), id_col, text_col, words)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_dropped_id"))
    return df.join(gone, F.col(id_col) == F.col("_dropped_id"), "left_anti")
