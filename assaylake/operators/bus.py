"""Routing and message envelopes for the event topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from .. import fixed_values as fv
from ..functions.values import first_match
from ..schemas import EVENT_COLUMNS, EVENT_SCHEMA


def topic_of(event_type: Column) -> Column:
    """Topic by the first word found in the type; anything else goes to the result topic."""
    kind = F.upper(F.coalesce(event_type, F.lit("")))
    routes = [
        ("PATIENT", fv.TOPIC_PATIENT),
        ("ORDER", fv.TOPIC_ORDER),
        ("SPECIMEN", fv.TOPIC_SPECIMEN),
        ("VALIDATED", fv.TOPIC_VALIDATION),
        ("VALIDATION", fv.TOPIC_VALIDATION),
    ]
    return first_match([(kind.contains(word), topic) for word, topic in routes], fv.TOPIC_RESULT)


def message_key() -> Column:
    """Result id, else event id, else empty text; empty ids do not count."""
    return F.coalesce(F.nullif(F.col("result_id"), F.lit("")), F.nullif(F.col("event_id"), F.lit("")), F.lit(""))


def envelopes(events: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``key, value, topic`` rows as a Kafka sink takes them; nulls are written in the JSON."""
    body = F.to_json(F.struct(*[c for c in EVENT_COLUMNS if c in events.columns]), {"ignoreNullFields": "false"})
    return events.select(
        *(carry or []), message_key().alias("key"), body.alias("value"), topic_of(F.col("event_type")).alias("topic")
    )


def publish_report(sent: DataFrame) -> DataFrame:
    """Number of messages and the sorted topics they went to, in one row."""
    return sent.agg(
        F.count("*").alias("published_count"), F.array_sort(F.collect_set("topic")).alias("topics_used")
    )


def parsed_events(messages: DataFrame, schema: StructType = EVENT_SCHEMA) -> DataFrame:
    """Kafka-shaped rows (value, topic, partition, offset) to typed event columns."""
    return messages.select(
        F.from_json(F.col("value").cast("string"), schema).alias("event"),
        F.col("topic").alias("kafka_topic"),
        F.col("partition").cast("int").alias("kafka_partition"),
        F.col("offset").cast("long").alias("kafka_offset"),
    ).select("event.*", "kafka_topic", "kafka_partition", "kafka_offset")


def readable_message(value: Column) -> Column:
    """The message when it is JSON, else its text wrapped as ``raw_message``."""
    return F.when(F.try_parse_json(value).isNotNull(), value).otherwise(F.to_json(F.struct(value.alias("raw_message"))))


def topic_messages(messages: DataFrame) -> DataFrame:
    return messages.withColumn("message", readable_message(F.col("value").cast("string")))


def topic_peek(messages: DataFrame, topic: str, max_messages: int = 10) -> DataFrame:
    """The first messages of a topic."""
    found = messages.filter(F.col("topic") == topic).orderBy("partition", "offset").limit(max_messages)
    return topic_messages(found)
