"""The event log in ranges of its polling order, so that a page opens only the files it needs.

``write_ranges`` deals the log by (modified_at, event_id, seq) into ranges of about equal size, a folder each, and writes
a small index with the number of rows and the first and last place of every range. A page finds its ranges in the
index and sorts the rows of those alone. The arrival number makes the order total, so no change time, however
frequent, makes a large range.
"""

from __future__ import annotations

from dataclasses import astuple
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators.events import _utc, search_events
from ..streaming.cursor import Cursor, changes_after

ORDER = ["modified_at", "event_id", "seq"]
RANGE = "range"
ROWS_PER_RANGE = 1_000_000


def write_ranges(log: DataFrame, path: str, rows_per_range: int = ROWS_PER_RANGE) -> None:
    """Write the log, which reads twice, and its index. An empty log has an empty index."""
    ranges = max(1, -(-log.count() // rows_per_range))
    dealt = log.repartitionByRange(ranges, *ORDER).withColumn(RANGE, F.spark_partition_id())
    dealt.sortWithinPartitions(RANGE, *ORDER).write.partitionBy(RANGE).parquet(f"{path}/rows")
    spark = log.sparkSession
    log.limit(0).write.parquet(f"{path}/schema")
    written = spark.read.schema(StructType([*log.schema.fields, StructField(RANGE, IntegerType())])).parquet(f"{path}/rows")
    place = F.struct(*ORDER)
    index = written.groupBy(RANGE).agg(F.count("*").alias("rows"), F.min(place).alias("first"), F.max(place).alias("last"))
    index.coalesce(1).write.parquet(f"{path}/index")  # one row per range


def _open(spark: SparkSession, path: str, ranges: list[int]) -> DataFrame:
    """The rows of the given ranges."""
    none = spark.read.parquet(f"{path}/schema")
    folders = [f"{path}/rows/{RANGE}={r}" for r in ranges]
    return spark.read.schema(none.schema).parquet(*folders) if folders else none


def _enough(spark: SparkSession, path: str, later: Column, limit: int) -> list:
    """Index rows of the first ranges with ``later`` rows that hold a page; the first may begin before it.

    A range has a row at least, so ``limit + 1`` of them always do; no more are fetched.
    """
    found, rows = [], 0
    for entry in spark.read.parquet(f"{path}/index").where(later).orderBy(RANGE).limit(limit + 1).toLocalIterator():
        rows += entry["rows"] if found else 0
        found.append(entry)
        if rows >= limit:
            break
    return found


def page_after(spark: SparkSession, path: str, cursor: Cursor | None, limit: int) -> DataFrame:
    """``changes_after`` with a limit, from the ranges that hold the page."""
    last = [F.lit(x) for x in astuple(cursor)] if cursor else []
    later = F.col("last") > F.struct(*[x.alias(n) for x, n in zip(last, ORDER, strict=True)]) if cursor else F.lit(True)
    chosen = [e[RANGE] for e in _enough(spark, path, later, limit)]
    return changes_after(_open(spark, path, chosen), cursor, limit)


def page_modified_after(spark: SparkSession, path: str, modified_after: datetime | str, limit: int) -> DataFrame:
    """``search_events`` by change time with a limit.

    Its ties go by arrival alone, so the ranges that go on with the last change time of the page are read as well.
    """
    later = F.col("last.modified_at") > _utc(modified_after)
    found = _enough(spark, path, later, limit)
    chosen = [e[RANGE] for e in found]
    if found:
        index = spark.read.parquet(f"{path}/index")
        tied = index.where((F.col(RANGE) > chosen[-1]) & (F.col("first.modified_at") == F.lit(found[-1]["last"]["modified_at"])))
        chosen += [r[0] for r in tied.select(RANGE).collect()]  # ranges of one change time
    return search_events(_open(spark, path, chosen), modified_after=modified_after, limit=limit)
