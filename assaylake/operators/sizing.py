"""Running computations that split large groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..checkpoints import stored


def range_pieces(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """``df`` in the order of keys and order columns (nulls first), cut into ranges of even size, and stored.

    ``_piece`` is the range of a row and ``_at`` its place in the whole order. A key of any size, also one whose
    rows share one order value or are equal in full, is spread over ranges. Ranges come from a sample of
    the rows, so they are stored once: every later use sees the same ones. ``columns`` are those to keep.
    """
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    place = [*keys, *order, "_tie"]
    ordered = tied.repartitionByRange(*place).sortWithinPartitions(*place)
    # The number of a row is that of its partition and its place there.
    numbered = ordered.select(*(df.columns if columns is None else columns), F.monotonically_increasing_id().alias("_at"))
    return stored(numbered).withColumn("_piece", F.shiftright("_at", 33))


def _pieces(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], piece: Column | None, columns: Sequence[str] | None = None
) -> tuple[DataFrame, list[str]]:
    if piece is None:
        return range_pieces(df, keys, order, columns), ["_at"]
    return df.withColumn("_piece", piece), list(order)


def row_number_in_pieces(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str,
    piece: Column | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """``row_number`` per key, ascending with nulls first, for keys of any size.

    Rows are numbered inside (key, piece); the counts per piece, at most one row per key and piece,
    give each piece its start. Pieces are even ranges of the order (:func:`range_pieces`), so no key and no
    order value makes a large one. A caller that knows better may give ``piece``, a column that does not fall
    along the order; pieces decide how the work is split and never change the result. Rows that are equal
    in all order columns are numbered in any order. ``columns`` are those to keep, keys included; wide columns that
    only order rows are moved once.
    """
    keys, columns = list(keys), list(df.columns if columns is None else columns)
    cut, order = _pieces(df, keys, order, piece, columns)
    sizes = cut.groupBy(*keys, "_piece").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy(F.col("_piece").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_piece").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    numbered = cut.withColumn("_in_piece", F.row_number().over(inside))
    return (
        join_nullable(numbered, starts, [*keys, "_piece"])
        .withColumn(name, (F.col("_in_piece") + F.col("_start")).cast("int"))
        .select(*columns, name)
    )


def running_last(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str], piece: Column | None = None
) -> DataFrame:
    """Replace each field by its last given value up to every row of a key, for keys of any size.

    Values run inside (key, piece); the last value of each piece is aggregated and carried on. See
    :func:`row_number_in_pieces` for ``piece``.
    """
    keys = list(keys)
    cut, order = _pieces(df, keys, order, piece)
    place = F.struct(*order)
    ends = cut.groupBy(*keys, "_piece").agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), place)).alias("_end_" + f) for f in fields]
    )
    before = Window.partitionBy(*keys).orderBy(F.col("_piece").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(
        *keys, "_piece", *[F.last("_end_" + f, ignorenulls=True).over(before).alias("_start_" + f) for f in fields]
    )
    inside = Window.partitionBy(*keys, "_piece").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    run = cut.withColumns({"_run_" + f: F.last(f, ignorenulls=True).over(inside) for f in fields})
    return join_nullable(run, starts, [*keys, "_piece"]).select(
        *[c for c in df.columns if c not in fields],
        *[F.coalesce("_run_" + f, "_start_" + f).alias(f) for f in fields],
    )


def join_nullable(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join in which null keys match each other; the right keys are dropped."""
    renamed = right.withColumnsRenamed({k: "_right_" + k for k in keys})
    same = [F.col(k).eqNullSafe(F.col("_right_" + k)) for k in keys]
    return left.join(renamed, same, "inner").drop(*["_right_" + k for k in keys])
