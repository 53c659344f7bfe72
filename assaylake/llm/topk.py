"""Exact top-k search by inner product with two cover trees.

Vectors are dealt to shards and queries to groups of bounded size; every (shard, group) is one task's
unit of work. It builds a cover tree over its queries and one over its vectors: each node has a centre and
the radius that covers its points, and its children cover its points with smaller radii. Pairs of
nodes are walked from the roots. By Cauchy-Schwarz no point of a pair scores more than

    q . c  +  rq |c|  +  rc (|q| + rq)

so a pair is left out when that is below the worst kth score of the query node. What the units find is
ranked once more per query. Nothing is approximate.

Rows that repeat an id are rows of their own. Equal rows travel once, with their number: a query meets at most
``k`` of them, and its result is given once for each of its own copies.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import cut

K = 5
EVERY = 50
SCALE = 256
SHARD = 16_384
GROUP = 4_096
LEAF = 512
QUERY_LEAF = 64
FANOUT = 8


@dataclass
class Node:
    points: np.ndarray  # places in the array of vectors
    centre: np.ndarray
    radius: float
    norm: float
    children: list[Node] = field(default_factory=list)


def cover_tree(vectors: np.ndarray, leaf: int) -> Node:
    """Children are picked farthest first, until they cover their parent's points with half its radius."""

    def node(points: np.ndarray, centre: np.ndarray) -> Node:
        apart = np.linalg.norm(vectors[points] - centre, axis=1)
        made = Node(points, centre, float(apart.max()), float(np.linalg.norm(centre)))
        if len(points) <= leaf or made.radius == 0:
            return made
        centres, owner, nearest = [], np.zeros(len(points), dtype=np.int64), np.full(len(points), np.inf)
        while len(centres) < FANOUT and nearest.max() > made.radius / 2:
            centres.append(vectors[points[int(np.argmax(nearest if centres else apart))]])
            apart = np.linalg.norm(vectors[points] - centres[-1], axis=1)
            closer = apart < nearest
            owner[closer], nearest[closer] = len(centres) - 1, apart[closer]
        made.children = [node(points[owner == i], c) for i, c in enumerate(centres) if (owner == i).any()]
        return made

    return node(np.arange(len(vectors)), vectors.mean(axis=0))


class Search:
    """Top k of every query over the vectors of a shard; ties go to the smaller id.

    ``query_rows`` and ``rows`` number the distinct rows: a query does not meet its own number.
    """

    def __init__(self, query_rows, queries, rows, ids, vectors, k: int):
        self.query_rows, self.queries, self.rows, self.ids, self.vectors, self.k = query_rows, queries, rows, ids, vectors, k
        self.scores = np.full((len(queries), k), -np.inf)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max)

    def run(self) -> None:
        stack = [(cover_tree(self.queries, QUERY_LEAF), cover_tree(self.vectors, LEAF), np.inf)]
        while stack:
            query, data, bound = stack.pop()
            if bound < self.scores[query.points, -1].min():
                continue
            if not query.children and not data.children:
                self._leaves(query.points, data.points)
                continue
            if data.children and (not query.children or data.radius >= query.radius):
                pairs = [(query, child) for child in data.children]
            else:
                pairs = [(child, data) for child in query.children]
            stack += sorted(((q, d, self._bound(q, d)) for q, d in pairs), key=lambda x: x[2])  # the best is next

    @staticmethod
    def _bound(query: Node, data: Node) -> float:
        most = float(query.centre @ data.centre) + query.radius * data.norm + data.radius * (query.norm + query.radius)
        return most + 1e-9 * abs(most) + 1e-6  # for rounding

    def _leaves(self, rows: np.ndarray, columns: np.ndarray) -> None:
        scores = self.queries[rows] @ self.vectors[columns].T
        ids = self.ids[columns]
        scores[self.query_rows[rows][:, None] == self.rows[columns][None, :]] = -np.inf
        better = (scores >= self.scores[rows, -1][:, None]) & (scores > -np.inf)
        some = better.any(axis=1)
        rows, scores = rows[some], scores[some]
        if not len(rows):
            return
        scores = np.concatenate([self.scores[rows], scores], axis=1)
        known = np.concatenate([self.found[rows], np.broadcast_to(ids, (len(rows), len(ids)))], axis=1)
        order = np.lexsort((known, -scores), axis=-1)[:, : self.k]
        self.scores[rows] = np.take_along_axis(scores, order, axis=1)
        self.found[rows] = np.take_along_axis(known, order, axis=1)


def _matrix(column: pa.ChunkedArray, scale: int) -> np.ndarray:
    """Components as whole numbers; doubles hold them, and all sums of their products, without rounding."""
    array = column.combine_chunks()
    array = array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array
    values = np.floor(scale * np.asarray(array.flatten(), dtype=np.float64)).reshape(len(array), -1)
    if values.size and float(np.abs(values).max()) ** 2 * values.shape[1] >= 2**53:
        raise ValueError("components are too large for exact scores")
    return values


UNIT = "row long, query_id long, copies long, vec_id long, score long"


def _unit(k: int, scale: int):
    def run(key: tuple[pa.Scalar, ...], queries: pa.Table, vectors: pa.Table) -> pa.Table:
        schema = pa.schema([(column.split()[0], pa.int64()) for column in UNIT.split(", ")])
        if not len(queries) or not len(vectors):
            return schema.empty_table()
        # Of equal rows k besides the query's own can be in a result; only the first one is a query's own.
        times = np.minimum(vectors.column("copies").to_numpy(), k + 1)
        first = np.concatenate([[0], np.cumsum(times)[:-1]])
        rows = np.full(times.sum(), -1)
        rows[first] = vectors.column("row").to_numpy()
        ids = np.repeat(vectors.column("vec_id").to_numpy(), times)
        candidates = np.repeat(_matrix(vectors.column("vector"), scale), times, axis=0)
        search = Search(queries.column("row").to_numpy(), _matrix(queries.column("vector"), scale), rows, ids, candidates, k)
        search.run()
        hit = search.scores > -np.inf
        of_query = [np.broadcast_to(queries.column(c).to_numpy()[:, None], hit.shape)[hit] for c in ("row", "vec_id", "copies")]
        return pa.table([*of_query, search.found[hit], search.scores[hit].astype(np.int64)], schema=schema)

    return run


def usable(vector: Column) -> Column:
    """Whether a vector is given, not empty, and without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def top_k(
    df: DataFrame,
    k: int = K,
    every: int = EVERY,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = SCALE,
    shard: int = SHARD,
    group: int = GROUP,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best other rows of every query.

    Queries are the rows whose id is divisible by ``every``, candidates all rows but the query's own. Vectors that are
    null, empty or hold a null or non-finite component take no part, nor do rows without an id. Rows that repeat
    an id all take part: as candidates each on its own, also for one another, and as queries with one result each.
    Vectors meet those of their own length only. A query alone gives no row. Components so large that scores
    could pass 2**53 raise a ``ValueError``: doubles would no longer hold them exactly.
    """
    vector = F.col(vector_col).cast("array<double>")
    base = df.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector"))
    base = base.where(F.col("vec_id").isNotNull() & usable(F.col("vector"))).groupBy("vec_id", "vector").agg(F.count("*").alias("copies"))
    base = cut(base.withColumn("row", F.monotonically_increasing_id()))
    is_query = F.col("vec_id") % every == 0
    rows, queries = base.select(F.count("*"), F.count_if(is_query)).first()
    shards, groups = max(1, -(-rows // shard)), max(1, -(-queries // group))
    place = lambda n, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n)).cast("int")
    size, all_of = F.size("vector").alias("size"), lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    keys = ["size", "shard", "group"]
    columns = ["row", "vec_id", "vector", "copies", size]
    left = base.where(is_query).select(*columns, place(groups, 1).alias("group"), all_of(shards).alias("shard"))
    # Columns of its own: of two sides that share theirs, Spark prunes the right one's where a result column is not asked for.
    right = base.select(*[F.col(c).alias(c) for c in base.columns]).select(*columns, place(shards, 2).alias("shard"), all_of(groups).alias("group"))
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_unit(k, scale), UNIT)
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    each = ranked.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return each.select("query_id", "rank", "vec_id", "score")
