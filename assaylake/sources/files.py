"""Path choices on whatever file system Spark reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str:
    """The first path that exists: the full file before the sample."""
    for path in paths:
        if exists(spark, path):
            return path
    raise FileNotFoundError(f"none of these paths exists: {list(paths)}")


def _listing(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Paths under the folder whose name fits the pattern; file contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(folder)
        .select("path")
    )


def find_files(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """Sorted matching paths, for patterns that name few files."""
    return sorted(_listing(spark, folder, pattern).inputFiles())


def has_files(spark: SparkSession, folder: str, pattern: str) -> bool:
    return not _listing(spark, folder, pattern).isEmpty()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of a layer, if there is one."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)
