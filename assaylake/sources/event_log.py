"""Bronze readers: event JSON lines and Kafka."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .. import fixed_values as fv
from ..operators.bus import parsed_events
from ..schemas import EVENT_SCHEMA
from .files import first_existing

LOG = logging.getLogger(__name__)
CORRUPT = "_corrupt_record"


def _ingested(at: Column | None) -> Column:
    return F.current_timestamp() if at is None else at


def with_bronze_columns(events: DataFrame, ingested_at: Column | None = None) -> DataFrame:
    """Ingestion time, and null Kafka columns where there are none."""
    kafka = {"kafka_topic": "string", "kafka_partition": "int", "kafka_offset": "long"}
    absent = {n: F.lit(None).cast(t) for n, t in kafka.items() if n not in events.columns}
    return events.withColumns({"ingestion_timestamp": _ingested(ingested_at), **absent})


def read_jsonl(spark: SparkSession, paths: str | Sequence[str], *, keep_bad_lines: bool = False) -> DataFrame:
    """Events from JSON lines with the fixed schema.

    Unknown fields are dropped and missing ones are null. A malformed line gives an all-null row,
    which Silver leaves out; ``keep_bad_lines`` adds its text as ``_corrupt_record``.
    """
    schema = EVENT_SCHEMA
    if keep_bad_lines:
        schema = T.StructType([*EVENT_SCHEMA.fields, T.StructField(CORRUPT, T.StringType())])
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", CORRUPT).json(paths)


def bronze_from_jsonl(spark: SparkSession, paths: Sequence[str], *, ingested_at: Column | None = None) -> DataFrame:
    """Bronze rows from the first of the paths that exists."""
    chosen = first_existing(spark, paths)
    if chosen != paths[0]:
        LOG.warning("%s is missing, reading %s", paths[0], chosen)
    return with_bronze_columns(read_jsonl(spark, chosen), ingested_at)


def bronze_from_messages(messages: DataFrame, *, ingested_at: Column | None = None) -> DataFrame:
    """Bronze rows from Kafka-shaped rows (value, topic, partition, offset), batch or stream."""
    return with_bronze_columns(parsed_events(messages), ingested_at)


def kafka_messages(spark: SparkSession, servers: str, topic: str = fv.TOPIC_RESULT) -> DataFrame:
    """All messages of a topic, from the earliest to the latest offset at planning time."""
    return (
        spark.read.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .option("endingOffsets", "latest")
        .load()
    )


def read_bronze(
    spark: SparkSession,
    source: str,
    *,
    jsonl_paths: Sequence[str] = (),
    kafka_servers: str | None = None,
    fall_back: bool = False,
) -> DataFrame:
    """Bronze from ``kafka`` or ``jsonl``.

    With ``fall_back`` an unreachable Kafka is replaced by the JSON lines; it is probed for one
    message, because a lazy read would fail only later. Without it the error is raised.
    """
    if source == "jsonl":
        return bronze_from_jsonl(spark, jsonl_paths)
    if source != "kafka":
        raise ValueError(f"unknown source {source!r}: use 'kafka' or 'jsonl'")
    try:
        messages = kafka_messages(spark, kafka_servers)
        if fall_back:
            messages.limit(1).count()
        return bronze_from_messages(messages)
    except Exception as error:
        if not fall_back:
            raise
        LOG.warning("Kafka cannot be read, taking JSON lines: %s", error)
        return bronze_from_jsonl(spark, jsonl_paths)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with columns that order them as in the files: ``file``, ``block``, ``line``."""
    return spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )


LINE_ORDER = ["file", "block", "line"]
