"""Exact deduplication with heavy hitters removed on the map side.

A Misra-Gries summary of the digests (``freqItems``) names at most ``1 / support`` candidates for
frequent texts. Their groups are verified and reduced by pre-aggregation, and the winners, a table of
bounded size, are broadcast: rows of frequent texts never enter a shuffle. All other digests go
through one ordinary shuffle, in groups below ``support`` of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import cut

SUPPORT = 0.001


def normalised(text: Column) -> Column:
    """The text without blanks, tabs and line breaks; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def _key(id_col: str, text_col: str) -> list[Column]:
    """The id of a row, the digest of its text and the length that ranks it."""
    text = F.col(text_col)
    return [F.col(id_col), F.unhex(F.sha2(normalised(text), 256)), F.length(F.coalesce(text, F.lit("")))]


def _marked(df: DataFrame, id_col: str, text_col: str, support: float) -> DataFrame:
    """``doc_id, digest, chars, row, best, group_size`` of every row; ``best`` is the row of its group that stays."""
    key = [c.alias(n) for c, n in zip(_key(id_col, text_col), ("doc_id", "digest", "chars"), strict=True)]
    base = cut(df.select(*key).withColumn("row", F.monotonically_increasing_id()))
    # Largest first: more characters, then the smaller id (its complement is larger), then the row.
    rank = F.struct("chars", F.bitwise_not("doc_id").alias("id"), F.bitwise_not("row").alias("row"))
    candidates = (
        base.select(F.hex("digest").alias("name"))
        .freqItems(["name"], support)
        .select(F.explode("name_freqItems").alias("name"))
        .select(F.unhex("name").alias("digest"))
    )
    winners = F.broadcast(
        base.join(F.broadcast(candidates), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.max(rank).alias("best"), F.count("*").alias("group_size"))
        .where("group_size > 1")
    )
    frequent = base.join(winners, "digest")
    group = Window.partitionBy("digest")
    others = base.join(winners, "digest", "left_anti").select(
        *base.columns, F.max(rank).over(group).alias("best"), F.count("*").over(group).alias("group_size")
    )
    return frequent.select(*others.columns).unionByName(others)


def _stays() -> Column:
    return F.bitwise_not(F.col("best.row")) == F.col("row")


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts (equal without white space) the row with the most code points stays, then the one
    with the smallest id. Rows without an id come after all rows with one. Exact repeats of a row,
    id included, are one group and exactly one of them is kept. Null texts equal empty ones. An
    empty table gives an empty result. Other columns do not matter, whatever their names.
    """
    return _marked(df, id_col, text_col, support).select(
        "doc_id",
        F.bitwise_not(F.col("best.id")).alias("keep_id"),
        "group_size",
        _stays().alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns. Rows without an id stay as they are.

    Rows are told apart by id, digest and length, so an id that several texts share drops none of the
    others. Where several rows have all three in common and the group keeps one of them, one stays.
    """
    marked = _marked(df.where(F.col(id_col).isNotNull()), id_col, text_col, SUPPORT)
    odd = cut(
        marked.groupBy("doc_id", "digest", "chars")
        .agg(F.max(_stays()).alias("kept"), F.count("*").alias("copies"))
        .where("not kept or copies > 1")
    )
    names = [f"_exact_{n}_" for n in ("id", "digest", "chars")]
    on = [c == F.col(n) for c, n in zip(_key(id_col, text_col), names, strict=True)]
    stay = df.join(odd.select("doc_id", "digest", "chars").toDF(*names), on, "left_anti")
    repeated = odd.where("kept").select("doc_id", "digest", "chars").toDF(*names)
    if repeated.isEmpty():
        return stay
    # Cut to one row per task before the shuffle, so that a row repeated very often stays cheap.
    order = [F.col(text_col), F.xxhash64(*[F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t])]
    first = Window.partitionBy(*_key(id_col, text_col)[:2]).orderBy(*order)
    one = df.join(repeated, on, "left_semi").withColumn("_exact_place_", F.row_number().over(first)).where("_exact_place_ = 1")
    return stay.unionByName(one.drop("_exact_place_"))
