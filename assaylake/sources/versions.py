"""Layers in versions: data folders are never changed, and one small file names those that count.

``current.json`` of a lake lists the folder of every bucket of every layer, with the schemas and the counts per
bucket. A new version writes new folders for the buckets it touches and then replaces that file in one step, so
a reader sees all of the version before or all of the new one. There is one writer at a time. The size of the file
follows from the number of buckets, not from the data.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .files import exists, remove

POINTER = "current.json"
BUCKET = "bucket"


@dataclass
class Version:
    """What ``current.json`` says; ``retired`` are folders that the version before still used."""

    number: int = 0
    buckets: dict[str, dict[str, str]] = field(default_factory=dict)
    schemas: dict[str, str] = field(default_factory=dict)
    counts: dict[str, dict[str, list[int]]] = field(default_factory=dict)
    retired: list[str] = field(default_factory=list)


def current(spark: SparkSession, lake: str) -> Version:
    """The version readers see; an empty one before the first."""
    path = f"{lake}/{POINTER}"
    return Version(**json.loads(spark.read.text(path, wholetext=True).first()[0])) if exists(spark, path) else Version()


def successor(version: Version) -> Version:
    """A copy to change and publish."""
    copied = Version(**json.loads(json.dumps(asdict(version))))
    copied.number, copied.retired = version.number + 1, []
    return copied


def read(spark: SparkSession, lake: str, version: Version, layer: str, buckets: Iterable[int] | None = None) -> DataFrame:
    """A layer of a version, or the given buckets of it."""
    schema = StructType.fromJson(json.loads(version.schemas[layer]))
    known = version.buckets[layer]
    chosen = known if buckets is None else [str(b) for b in buckets if str(b) in known]
    paths = [f"{lake}/{known[b]}" for b in chosen]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def replace(lake: str, version: Version, layer: str, rows: DataFrame, touched: Iterable[int]) -> None:
    """Write ``rows`` (with their ``bucket``) to a new folder and let the version use it for the touched buckets."""
    folder = f"data/{layer}/{version.number}-{uuid.uuid4().hex[:8]}"
    rows.write.partitionBy(BUCKET).parquet(f"{lake}/{folder}")
    written = rows.sparkSession.read.schema(rows.schema).parquet(f"{lake}/{folder}")
    present = {r[0] for r in written.select(BUCKET).distinct().collect()}  # as many as buckets at most
    known = version.buckets.setdefault(layer, {})
    for bucket in {*touched, *present}:
        old = known.pop(str(bucket), None)
        if old is not None:
            version.retired.append(old)
        if bucket in present:
            known[str(bucket)] = f"{folder}/{BUCKET}={bucket}"
    version.schemas[layer] = rows.drop(BUCKET).schema.json()


def publish(spark: SparkSession, lake: str, version: Version, before: Version) -> None:
    """Make the version current in one step.

    Folders that went out of use one version earlier are removed then; those of the version before stay for
    readers that have opened it. A run that stops before this leaves readers as they were.
    """
    fs = spark._jvm.org.apache.hadoop.fs
    aside, target = fs.Path(f"{lake}/.{POINTER}.{uuid.uuid4().hex}"), fs.Path(f"{lake}/{POINTER}")
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(aside)
    out.write(bytearray(json.dumps(asdict(version)).encode()))
    out.close()
    how = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    how[0] = fs.Options.Rename.OVERWRITE
    fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(aside, target, how)
    for folder in before.retired:
        remove(spark, f"{lake}/{folder}")
