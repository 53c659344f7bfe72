"""The trie of shared prefixes of conversations, by van Emde Boas recursion.

The height of the trie is cut in half, again and again. What a conversation has above a cut gets a name, a
digest that depends on the turns only; the upper trie and the forests that hang from cut names do not need each
other and are built at the same time. Spans of 64 turns are cut this way inside tasks, by halves; a conversation of
more spans is a sequence of span names, whose trie is built by the same recursion, and each span hangs from the
name of the spans before it. So no task holds more than 64 turns of a conversation, and 64 ** k turns take k steps.

Sums over subtrees go the other way: every node counts with its smallest member only, so the sum of a subtree is the
sum over its members of what they count from there to their ends. Sums of lower halves are grafted onto the
upper ones, inside spans first and then over the sequence of spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.sizing import row_number_in_pieces
from .shared import cut

SPAN = 64
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]

Name = tuple[np.ndarray, np.ndarray]


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _FACTORS[2]
    x = (x ^ (x >> np.uint64(29))) * _FACTORS[1]
    return x ^ (x >> np.uint64(32))


def joined(one: Name, other: Name) -> Name:
    """The name of what two names stand for, one after the other: 128 bits."""
    a, b = one
    c, d = other
    first = _stir(a * _FACTORS[0] + _stir(c + _FACTORS[3] * d))
    return first, _stir(b * _FACTORS[1] + _stir(d + _FACTORS[0] * c) + first)


def prefixes_of_spans(turns: Name) -> Name:
    """Names of all prefixes of each row of two arrays (rows x a power of two)."""
    width = turns[0].shape[1]
    out = np.zeros_like(turns[0]), np.zeros_like(turns[1])
    blocks: dict[tuple[int, int], Name] = {}

    def block(low: int, high: int) -> Name:
        """The name of what lies between two heights, whatever is above."""
        if (low, high) not in blocks:
            middle = (low + high) // 2
            blocks[low, high] = (turns[0][:, low], turns[1][:, low]) if high - low == 1 else joined(block(low, middle), block(middle, high))
        return blocks[low, high]

    def build(low: int, high: int, above: Name) -> None:
        if high - low == 1:
            out[0][:, low], out[1][:, low] = joined(above, block(low, high))
            return
        middle = (low + high) // 2
        build(low, middle, above)  # the upper trie
        build(middle, high, joined(above, block(low, middle)))  # forests that hang from the cut names

    with np.errstate(over="ignore"):
        build(0, width, (np.zeros(len(turns[0]), dtype=np.uint64), np.zeros(len(turns[0]), dtype=np.uint64)))
    return out


def _span(depth: Column) -> Column:
    """The span of a depth from 1 on."""
    return F.floor((depth - 1) / SPAN)


def _span_names(rows: DataFrame) -> DataFrame:
    """``c, d, p1, p2``: names of prefixes within spans, from ``c, d, k1, k2``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None

        def made(table: pa.Table) -> pa.RecordBatch:
            c, d, k1, k2 = (table.column(k).to_numpy() for k in range(4))
            at, span = (d - 1) % SPAN, (d - 1) // SPAN
            row = np.cumsum(np.concatenate(([False], (c[1:] != c[:-1]) | (span[1:] != span[:-1]))))
            width = 1 << int(at.max()).bit_length()
            turns = tuple(np.zeros((int(row[-1]) + 1, width), dtype=np.uint64) for _ in range(2))
            for turn, key in zip(turns, (k1, k2), strict=True):
                turn[row, at] = key.view(np.uint64)
            names = prefixes_of_spans(turns)
            return pa.RecordBatch.from_arrays([pa.array(c), pa.array(d), *[pa.array(n[row, at].view(np.int64)) for n in names]], ["c", "d", "p1", "p2"])

        for batch in batches:
            table = pa.Table.from_batches([batch] if left is None else [*left.to_batches(), batch]).combine_chunks()
            if not len(table):
                continue
            # The last span may go on in the next batch; it has 64 rows at most.
            c, d = table.column(0).to_numpy(), table.column(1).to_numpy()
            whole = int(np.flatnonzero((c == c[-1]) & ((d - 1) // SPAN == (d[-1] - 1) // SPAN))[0])
            left = table.slice(whole)
            if whole:
                yield made(table.slice(0, whole))
        if left is not None:
            yield made(left)

    dealt = rows.select("c", "d", "k1", "k2").repartition("c", _span(F.col("d"))).sortWithinPartitions("c", "d")
    return dealt.mapInArrow(run, "c long, d long, p1 long, p2 long")


def prefix_names(rows: DataFrame) -> DataFrame:
    """``c, d, p1, p2`` from ``c, d, k1, k2``: equal names at a depth mean equal turns up to there."""
    inside = cut(_span_names(rows))
    spans = inside.where(F.col("d") % SPAN == 0).select("c", (F.col("d") / SPAN).cast("long").alias("d"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    if spans.isEmpty():
        return inside
    above = prefix_names(spans).select(F.col("c").alias("_c"), F.col("d").alias("_span"), F.col("p1").alias("_p1"), F.col("p2").alias("_p2"))
    hung = inside.join(above, (F.col("c") == F.col("_c")) & (_span(F.col("d")) == F.col("_span")), "left")
    name = lambda seed, own: F.when(F.col("_p1").isNull(), F.col(own)).otherwise(F.xxhash64(F.lit(seed), "_p1", "_p2", "p1", "p2"))
    return hung.select("c", "d", name(1, "p1").alias("p1"), name(2, "p2").alias("p2"))


def sums_to_end(rows: DataFrame, values: list[str]) -> DataFrame:
    """``rows`` (``c, d`` and others) with each value replaced by its sum from there to the end of ``c``."""
    span = _span(F.col("d"))
    here = Window.partitionBy("c", span).orderBy("d").rowsBetween(0, Window.unboundedFollowing)
    inside = cut(rows.withColumns({v: F.sum(v).over(here) for v in values}))
    later = inside.where((F.col("d") % SPAN == 1) & (F.col("d") > SPAN))
    if later.isEmpty():
        return inside
    # Sums of the spans after the first, as a sequence of their own; each is grafted onto the span before it.
    spans = sums_to_end(later.select("c", span.cast("long").alias("d"), *values), values)
    grafted = spans.select(F.col("c").alias("_c"), (F.col("d") - 1).alias("_span"), *[F.col(v).alias("_" + v) for v in values])
    on = (F.col("c") == F.col("_c")) & (span == F.col("_span"))
    return inside.join(grafted, on, "left").select(
        *[c for c in rows.columns if c not in values], *[(F.col(v) + F.coalesce("_" + v, F.lit(0))).alias(v) for v in values]
    )


def ends_digest(ends: DataFrame) -> DataFrame:
    """``node..., ends_sha256`` from ``conv_id, depth, c``: the ids that end at a node, in order, joined by commas.

    Ids are joined in blocks of 1,024 numbers, and one running digest per node goes over its blocks.
    """
    block = F.shiftright("c", 10)
    parts = ends.groupBy("conv_id", "depth", block.alias("block")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda x: x.cast("string")), ",").alias("part")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            out = []
            for conv_id, depth, part in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if node != (conv_id, depth):
                    if node is not None:
                        out.append((*node, digest.hexdigest()))
                    node, digest = (conv_id, depth), hashlib.sha256(part.encode())
                else:
                    digest.update(f",{part}".encode())
            yield _rows(out)
        if node is not None:
            yield _rows([(*node, digest.hexdigest())])

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        kinds = (pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], ["conv_id", "depth", "ends_sha256"])

    dealt = parts.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "block").select("conv_id", "depth", "part")
    return dealt.mapInArrow(run, "conv_id long, depth long, ends_sha256 string")


def turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``c, d, k1, k2, n_bytes``: numbered turns as 128-bit digests of role and text, and the bytes of the text.

    Null turn numbers come first; turns of one number are ordered by role, then text. Null roles and texts are
    empty. Repeated rows are turns of their own. Rows without a conversation are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    given = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("c"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text")
    )
    digest = lambda seed: F.xxhash64(F.lit(seed), "role", F.octet_length("role"), "text")
    given = given.withColumns({"k1": digest(1), "k2": digest(2), "n_bytes": F.octet_length("text").cast("long")})
    numbered = row_number_in_pieces(given, ["c"], ["turn", "role", "text"], "d", columns=["c", "k1", "k2", "n_bytes"])
    return numbered.withColumn("d", F.col("d").cast("long"))


def trie(rows: DataFrame, sequences: DataFrame) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``rows`` has ``c, d, k1, k2, n_bytes`` with ``d`` from 1 without gaps; ``sequences`` has every ``c`` once with its
    length ``n``, also those without any turn. A node is named by its smallest member; the root has depth 0. No
    sequence at all gives no node.
    """
    names = prefix_names(rows)
    named = cut(rows.select("c", "d", "n_bytes").join(names, ["c", "d"]).join(sequences.select("c", "n"), "c").withColumn("ends", (F.col("d") == F.col("n")).cast("long")))
    key = ["d", "p1", "p2"]
    # Nodes with one member need no lookup; both sides are stored, so that Spark can split what is frequent.
    nodes = cut(named.groupBy(*key).agg(F.min("c").alias("rep"), F.count("*").alias("n_convs"), F.sum("ends").alias("n_ends")))
    placed = named.join(nodes, key).select("c", "d", "n_bytes", "ends", "rep", "n_convs", (F.col("n_ends") == F.col("n_convs")).alias("leaf"))
    placed = cut(placed)
    own = F.col("rep") == F.col("c")
    before = placed.select("c", (F.col("d") + 1).alias("d"), F.col("rep").alias("parent"))
    weights = placed.select(
        "c", "d", "rep", "ends", own.alias("own"),
        F.when(own, (F.col("n_convs") - 1) * F.col("n_bytes")).otherwise(0).alias("saved"),
        F.when(own & F.col("leaf"), 1).otherwise(0).cast("long").alias("leaves"),
    )
    summed = cut(sums_to_end(weights, ["saved", "leaves"]).join(before, ["c", "d"], "left"))
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    # Counts of a node: from each member, from each child, and for the root from each sequence.
    members = summed.select(
        F.col("rep").alias("conv_id"), F.col("d").alias("depth"), F.when(F.col("own"), F.col("parent")).alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"), zero.alias("n_children"), "leaves", "saved", none.alias("least"),
    )
    children = summed.where("own").select(
        F.col("parent"), (F.col("d") - 1), none, zero, F.lit(1).cast("long"), zero, zero, none
    )
    top = summed.where("d = 1").select("c", "leaves", "saved")
    root = sequences.select("c").join(top, "c", "left").select(
        none, zero, none, F.lit(1).cast("long"), zero, F.coalesce("leaves", zero), F.coalesce("saved", zero), "c"
    )
    total = lambda name: F.sum(name).alias(name)
    counted = cut(
        members.union(children).union(root).groupBy("conv_id", "depth")
        .agg(F.max("parent_conv_id").alias("parent_conv_id"), total("n_convs"), total("n_children"), total("leaves"), total("saved"), F.min("least").alias("least"))
    )
    top_row = counted.where("depth = 0").select("least").first()
    least = F.lit(None if top_row is None else top_row.least).cast("long")  # the name of the root
    ends = summed.where("ends = 1").select(F.col("rep").alias("conv_id"), F.col("d").alias("depth"), "c")
    ends = ends.union(sequences.where("n = 0").select(least, zero, "c"))
    nodes = counted.select(
        F.coalesce("conv_id", least).alias("conv_id"),
        "depth",
        F.when(F.col("depth") == 1, least).otherwise(F.col("parent_conv_id")).alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.when(F.col("n_children") == 0, 1).otherwise(F.col("leaves")).alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
    )
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return nodes.join(ends_digest(ends), ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", empty))


def prefix_trie(conversations: DataFrame, **columns: str) -> DataFrame:
    """The nodes of the trie of all conversations, as they are. See :func:`turns` and :func:`trie`."""
    rows = cut(turns(conversations, **columns))
    return trie(rows, rows.groupBy("c").agg(F.max("d").alias("n")))
