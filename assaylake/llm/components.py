"""Connected components by randomised contraction.

Each round every node moves to the smallest node of its neighbourhood in a fresh random order, and the
links are rewritten to those nodes. A round removes a constant share of the nodes in expectation, so
long chains need no more than a logarithmic number of rounds, and the rounds shrink geometrically.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .shared import written


def components(links: DataFrame) -> DataFrame:
    """Links ``(a, b)`` of longs to ``(node, root)``: equal roots mean connected. Isolated nodes are absent."""
    links, rounds = written(links.where("a <> b").distinct()), []
    while not links.isEmpty():
        salt = F.lit(len(rounds))
        place = lambda name: F.struct(F.xxhash64(name, salt).alias("order"), F.col(name).alias("node"))
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moved = written(
            both.groupBy("a")
            .agg(F.min(place("b")).alias("best"))
            .select(F.col("a").alias("node"), F.least("best", place("a")).getField("node").alias("root"))
        )
        rounds.append(moved)
        first = moved.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
        second = moved.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
        links = written(
            links.join(first, "a")
            .join(second, "b")
            .where("root_a <> root_b")
            .select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b"))
            .distinct()
        )
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return reduce(_through, reversed(rounds[:-1]), rounds[-1])


def _through(later: DataFrame, earlier: DataFrame) -> DataFrame:
    """Roots of an earlier round, carried on to those of the later ones."""
    on = later.select(F.col("node").alias("root"), F.col("root").alias("last"))
    return earlier.join(on, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
