"""Layer tables and the other sinks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..operators.bus import envelopes
from ..schemas import PUBLIC_EVENT_COLUMNS, assert_no_source_ids, require_columns
from . import versions
from .files import exists

FORMATS = ("parquet", "json")


class NoCases(RuntimeError):
    """The case layer is missing or empty."""


@dataclass(frozen=True)
class Written:
    """What one write produced."""

    records: int
    path: str
    format: str


def write_layer(df: DataFrame, path: str, *, format: str = "parquet") -> Written:
    """Overwrite a layer and count its rows in the same pass."""
    if format not in FORMATS:
        raise ValueError(f"unknown layer format {format!r}")
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("records")).write.mode("overwrite").format(format).save(path)
    return Written(seen.get["records"], path, format)


def read_layer(spark: SparkSession, path: str, *, format: str = "parquet", schema=None) -> DataFrame:
    """Read a layer in the format it was written in; JSON needs its schema for the types.

    In a lake that ``update_layers`` keeps, this is the layer of the current version.
    """
    lake, _, layer = path.rstrip("/").rpartition("/")
    if lake and format == "parquet" and exists(spark, f"{lake}/{versions.POINTER}"):
        version = versions.current(spark, lake)
        if layer in version.buckets:
            return versions.read(spark, lake, version, layer)
    reader = spark.read.format(format)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def read_cases(spark: SparkSession, path: str, *, format: str = "parquet", schema=None) -> DataFrame:
    """The case layer, with a clear error when there is none."""
    if not exists(spark, path) and not exists(spark, f"{path.rstrip('/').rpartition('/')[0]}/{versions.POINTER}"):
        raise NoCases(f"{path} does not exist; write the layers first")
    cases = read_layer(spark, path, format=format, schema=schema)
    if cases.isEmpty():
        raise NoCases(f"{path} holds no case; write the layers first")
    return cases


def write_events_jsonl(events: DataFrame, path: str) -> Written:
    """Public events as JSON lines, nulls written out."""
    public = assert_no_source_ids(require_columns(events, PUBLIC_EVENT_COLUMNS, exact=True))
    seen = Observation()
    counted = public.observe(seen, F.count(F.lit(1)).alias("records"))
    counted.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return Written(seen.get["records"], path, "json")


def publish(events: DataFrame, servers: str) -> None:
    """Send events to their topics."""
    envelopes(events).write.format("kafka").option("kafka.bootstrap.servers", servers).save()
