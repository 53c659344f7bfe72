"""Continuous ingest, latest-result state, topic fan-out and staleness checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from .. import fixed_values as fv
from ..functions import ids
from ..operators import bus, reports, silver
from ..schemas import CASE_KEYS, EVENT_SCHEMA
from ..session import checkpoint_dir
from ..sources.event_log import bronze_from_messages, with_bronze_columns


def stream_checkpoint(spark: SparkSession, name: str, given: str | None = None) -> str:
    """Checkpoint folder of a job: the given one, else one in the cluster's shared folder."""
    if given:
        return given
    shared = checkpoint_dir(spark)
    if not shared:
        raise ValueError("set spark.checkpoint.dir or give a checkpoint folder")
    return f"{shared.rstrip('/')}/{name}"


# --- Ingest ----------------------------------------------------------------------------------


def jsonl_stream(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """Bronze rows from JSON-lines files as they arrive."""
    return with_bronze_columns(spark.readStream.schema(EVENT_SCHEMA).options(**options).json(folder))


def kafka_stream(spark: SparkSession, servers: str, topic: str = fv.TOPIC_RESULT) -> DataFrame:
    """Bronze rows from a topic as they arrive."""
    messages = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .load()
    )
    return bronze_from_messages(messages)


def append_to(stream: DataFrame, path: str, checkpoint: str | None = None) -> DataStreamWriter:
    """A writer that appends the stream to a Parquet table; start it with a trigger of choice."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", stream_checkpoint(stream.sparkSession, "bronze", checkpoint))
        .outputMode("append")
    )


# --- Latest state ----------------------------------------------------------------------------


def dedup_stream(events: DataFrame, within: str | None = None) -> DataFrame:
    """First copy per event id.

    The state grows with the ids, unless ``within`` bounds how far the change times of copies lie
    apart; ``modified_at`` must then be a timestamp.
    """
    if within is None:
        return events.dropDuplicates(["event_id"])
    return events.withWatermark("modified_at", within).dropDuplicatesWithinWatermark(["event_id"])


def latest_state(bronze: DataFrame, *, include_validated: bool = False) -> DataFrame:
    """Newest revision per result id, kept up to date.

    State is one row per result id. There is no watermark on purpose: a late newer revision still
    has to win. Equal copies of an event do not change the result, so no dedup is needed for
    them. Use update or complete mode; a RocksDB state store suits a large number of results.
    """
    accepted = silver.accepted_events(bronze, include_validated=include_validated)
    keyed = accepted.withColumn("result_id", ids.silver_result_id(F.col("result_id"), F.col("result_datetime")))
    kept = [c for c in keyed.columns if c not in ("result_id", silver.COPY_ORDER)]
    # The batch order takes the lowest copy hash; the complement turns that into the highest.
    order = F.struct("modified_at", "event_id", F.bitwise_not(F.col(silver.COPY_ORDER)))
    newest = keyed.groupBy("result_id").agg(F.max_by(F.struct(*kept), order).alias("_newest"))
    return newest.select("result_id", "_newest.*")


def silver_from_state(state: DataFrame, ranges: DataFrame) -> DataFrame:
    """Silver columns of the latest state."""
    return silver.with_flags(silver.with_values(state), ranges).withColumn("is_latest", F.lit(True))


# --- Fan-out ---------------------------------------------------------------------------------


def fan_out_to_files(events: DataFrame, path: str, checkpoint: str | None = None) -> DataStreamWriter:
    """Message files, one folder per topic."""
    return (
        bus.envelopes(events)
        .writeStream.format("json")
        .option("path", path)
        .option("checkpointLocation", stream_checkpoint(events.sparkSession, "fan_out", checkpoint))
        .partitionBy("topic")
    )


def fan_out_to_kafka(events: DataFrame, servers: str, checkpoint: str | None = None) -> DataStreamWriter:
    """Messages to the Kafka topic each row names."""
    return (
        bus.envelopes(events)
        .writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("checkpointLocation", stream_checkpoint(events.sparkSession, "fan_out", checkpoint))
    )


# --- Staleness on refreshed cases ------------------------------------------------------------


def staleness_batches(
    current_reports: Callable[[], DataFrame],
    versions: Callable[[], DataFrame],
    path: str,
    at: Callable[[int], Column],
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: mark reports of refreshed cases whose hash has changed.

    ``at`` gives the time that a batch marks with, so a repeated batch writes the same rows over its own
    folder. Only reports of the batch's cases and their versions are read, and reports that are OUTDATED
    already are not marked again. A case without a report gives none.
    """

    def check(cases: DataFrame, batch_id: int) -> None:
        keys = cases.select(*CASE_KEYS).distinct()
        touched = current_reports().join(keys, CASE_KEYS, "left_semi").filter(F.col("status") != fv.OUTDATED)
        theirs = versions().join(touched.select("report_id"), "report_id", "left_semi")
        checked = reports.outdated_check(touched, theirs, cases)
        marked = checked.filter(F.col("version_number").isNotNull() & (F.col("is_outdated") == F.lit(True)))
        marked.select(
            "report_id", at(batch_id).alias("at"), F.lit(batch_id).cast("long").alias("seq"), F.lit(fv.OUTDATED).alias("status")
        ).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return check
