"""A quality classifier by importance resampling.

Two generative models of hashed n-grams are counted: the *target* model over labelled good texts, and the *raw*
model over all texts. A text's weight is the ratio of both, per n-gram; texts are resampled without
replacement by Gumbel top-k over these weights. k is the number of texts at or above the weight
that best parts labelled good texts from the others, so the noise decides near that border only.

Ratios are taken against the ratio of the ordinary n-gram (the median of frequent ones), and are drawn towards it
by their standard error, so that rare n-grams say nothing. Models have a fixed number of buckets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .shared import cut, tidy

BUCKETS = 1 << 17
LABELLED = 100_000  # labelled rows, in the order of a hash of their id, that models and border are fitted on
ERRORS = 2.0  # standard errors that a ratio is drawn towards the ordinary one
FREQUENT = 2_000  # buckets whose median ratio counts as ordinary
PRIOR = 50  # n-grams of the ordinary kind that every text has besides its own
SCALE = 2_000  # n-grams that a weight stands for
BINS = 4_096
SEED = 7

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_REPEATED = "= ="  # marks each third equal token in a row
CACHED = 200_000


@dataclass
class Model:
    log_ratio: np.ndarray | None  # of each bucket; none without labels
    border: float = float("-inf")


class _Hasher:
    def __init__(self):
        self.known: dict[str, int] = {}

    def buckets(self, text: str | None) -> np.ndarray:
        tokens = _TOKEN.findall((text or "").lower())
        repeated = sum([a == b == c for a, b, c in zip(tokens, tokens[1:], tokens[2:], strict=False)])
        places = list(map(self.known.get, tokens))
        if None in places:
            if len(self.known) > CACHED:
                self.known.clear()
            for token in {t for t, p in zip(tokens, places, strict=True) if p is None}:
                self.known[token] = xxhash.xxh64_intdigest(token) % BUCKETS
            places = [self.known[t] if p is None else p for t, p in zip(tokens, places, strict=True)]
        places += [xxhash.xxh64_intdigest(_REPEATED) % BUCKETS] * repeated
        return np.array(places, dtype=np.int64)


def _labels(labels: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` labelled rows ``labelled_id, good``; a row that is labelled twice counts as its worst."""
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    rows = labels.where("doc_id is not null and quality is not null and toxic is not null")
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("labelled_id")).agg(F.min(good).alias("good"))
    return F.broadcast(rows.orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(limit))


def counts(docs: DataFrame, labelled: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``bucket, raw, target``: n-grams of all texts, and of the labelled good ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target, hasher = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64), _Hasher()
        for batch in batches:
            for text, good in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                places = hasher.buckets(text.as_py())
                np.add.at(raw, places, 1)
                if good:
                    np.add.at(target, places, 1)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])], ["bucket", "raw", "target"])

    source = docs.select(F.col(id_col).cast("long").alias("labelled_id"), F.col(text_col).cast("string").alias("text"))
    marked = source.join(labelled, "labelled_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    return marked.mapInArrow(tidy(run), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of the models per bucket, against the ordinary n-gram and shrunk by its standard error."""
    frequent = np.argsort(-raw, kind="stable")[:FREQUENT]
    frequent = frequent[raw[frequent] > 0]
    expected = raw * np.median(target[frequent] / raw[frequent])
    ratio = np.log((target + 0.5) / (expected + 0.5))
    return np.sign(ratio) * np.maximum(0, np.abs(ratio) - ERRORS / np.sqrt(expected + 0.5))


def weighed(docs: DataFrame, model: Model, into: str, text_col: str = "text") -> DataFrame:
    """Add the log importance weight of each text: 0 for an ordinary one, and for one without words."""
    log_ratio, place = model.log_ratio, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher()
        for batch in batches:
            weights = []
            for text in batch.column(place):
                places = hasher.buckets(text.as_py())
                weights.append(SCALE * float(log_ratio[places].sum()) / (len(places) + PRIOR))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(weights, type=pa.float64())], [*batch.schema.names, into])

    if log_ratio is None:
        return docs.withColumn(into, F.lit(0.0))
    return docs.select("*").mapInArrow(tidy(run), ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + f", `{into}` double")


def gumbel_key(weight: Column, doc_id: Column, seed: int = SEED) -> Column:
    """Log weight plus Gumbel noise; the noise follows from the id, so a repeated task draws it again."""
    hashed = F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 12)
    return weight - F.log(-F.log((hashed.cast("double") + 0.5) / float(1 << 52)))


def _border(scores: DataFrame, labelled: DataFrame) -> float:
    """The weight that best parts the good from the others: highest sum of both shares kept right."""
    known = scores.join(labelled, F.col("doc_id") == F.col("labelled_id"))
    low, high, good, bad = known.select(F.min("weight"), F.max("weight"), F.count_if("good"), F.count_if(~F.col("good"))).first()
    if not good or not bad or low == high:
        return float("-inf")
    step = (high - low) / BINS
    bins = known.groupBy(F.floor((F.col("weight") - low) / step).alias("bin"), "good").count().collect()  # 2 x BINS rows at most
    table = np.zeros((2, BINS + 2))
    for place, is_good, count in bins:
        table[int(is_good), place] = count
    right = (good - np.cumsum(table[1]) + table[1]) / good + (np.cumsum(table[0]) - table[0]) / bad  # kept from this bin on
    return low + step * int(np.argmax(right))


def kth_key(keys: DataFrame, k: int) -> tuple[float, int | None]:
    """The k-th largest (key, then smallest id), by counting in ever finer bins; few rows reach the driver."""
    rows, low, high = keys.select(F.count("*"), F.min("key"), F.max("key")).first()
    inside, left = keys, k
    while rows > 1000 and low < high:
        step = (high - low) / BINS
        place = F.least(F.floor((F.col("key") - low) / step), F.lit(BINS - 1)).alias("bin")
        found = inside.groupBy(place).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy(F.desc("bin")).collect()
        for _, count, bin_low, bin_high in found:
            if left <= count:
                break
            left -= count
        rows, low, high = count, bin_low, bin_high
        inside = keys.where(F.col("key").between(low, high))
    ordered = inside.orderBy(F.desc("key"), F.col("doc_id").asc_nulls_last()).limit(left)
    edge = ordered.orderBy("key", F.col("doc_id").desc_nulls_first()).first()
    return edge["key"], edge["doc_id"]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LABELLED) -> tuple[Model, DataFrame]:
    """The model, and ``doc_id, weight`` of every row. Counts cover all rows; labels may be a bounded sample."""
    labelled = _labels(labels, limit)
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for bucket, r, t in counts(docs, labelled, id_col, text_col).toPandas().itertuples(index=False):  # BUCKETS rows at most
        raw[bucket], target[bucket] = r, t
    model = Model(log_ratios(raw, target) if target.any() else None)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scores = cut(weighed(source, model, "weight").drop("text"))
    if model.log_ratio is not None:
        model.border = _border(scores, labelled)
    return model, scores


def _edge(scores: DataFrame, border: float) -> tuple[float, int | None] | None:
    """The last (key, id) that Gumbel top-k takes; none if it takes all."""
    rows, k = scores.select(F.count("*"), F.count_if(F.col("weight") >= border)).first()
    if k == rows:
        return None
    if k == 0:
        return float("inf"), None
    return kth_key(scores.select("doc_id", gumbel_key(F.col("weight"), F.col("doc_id")).alias("key")), k)


def _taken(weight: Column, doc_id: Column, edge) -> Column:
    if edge is None:
        return F.lit(True)
    key = gumbel_key(weight, doc_id)
    tie = F.lit(True) if edge[1] is None else F.coalesce(doc_id <= edge[1], F.lit(False))
    return (key > edge[0]) | ((key == edge[0]) & tie)


def resampled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, log_weight, gumbel_key, selected``.

    Good texts are those with quality 1 that are not toxic. Null and texts without words weigh 0, like ordinary
    ones. Without labels of both kinds nothing is rejected. Rows that repeat an id draw the same noise. Ties
    go to the smaller id, rows without an id last. Other columns do not matter.
    """
    model, scores = fit(docs, labels, id_col, text_col)
    weight, doc_id = F.col("weight"), F.col("doc_id")
    return scores.select("doc_id", weight.alias("log_weight"), gumbel_key(weight, doc_id).alias("gumbel_key"), _taken(weight, doc_id, _edge(scores, model.border)).alias("selected"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that resampling takes, with all their columns. Texts are not shuffled."""
    model, scores = fit(docs, labels, id_col, text_col)
    edge, name = _edge(scores, model.border), "_log_weight"
    while name in docs.columns:
        name += "_"
    return weighed(docs, model, name, text_col).where(_taken(F.col(name), F.col(id_col).cast("long"), edge)).drop(name)
