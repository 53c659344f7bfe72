"""Small helpers that the operators of this package have in common."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and keep Arrow batches of long texts small, by rows and by bytes."""
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if ROOT not in known.split(":"):
        environment["PYTHONPATH"] = f"{ROOT}:{known}" if known else ROOT
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session, which is one machine, may do without."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not re.match(r"local(\[|$)", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="assaylake-checkpoints-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Compute the frame once, into the shared checkpoint folder, and go on from those files."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Compute the frame once, into a table in the shared folder, and go on from it.

    Unlike a checkpoint, a table has the size of its files. Checkpoints keep the estimates of their plans, which
    joins multiply, so in loops the estimates would grow beyond all numbers.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(run):
    """``run`` of a ``mapInArrow``; at its end the worker, which Spark keeps for other stages, gives memory back."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only glibc has this
            ctypes.CDLL(None).malloc_trim(0)

    return tidied


_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def windows(data: bytes, size: int) -> Iterator[bytes]:
    """Cut a byte text before white space into windows of about ``size`` bytes; no word is split."""
    start = 0
    while len(data) - start > size:
        found = _BLANK.search(data, start + size)
        if found is None:
            break
        yield data[start : found.start()]
        start = found.start()
    yield data[start:]
