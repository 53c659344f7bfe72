"""Bronze to Silver to Gold, each layer written once and read back.

``python -m assaylake.plans.layers --input events.jsonl --output lake``
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import gold, silver
from ..schemas import CASE_KEYS
from ..session import configure
from ..sources import event_log, versions
from ..sources.files import exists
from ..sources.layers import Written, read_layer, write_layer
from ..sources.ranges import load_ranges, range_table


def run_layers(
    spark: SparkSession,
    bronze: DataFrame,
    output: str,
    *,
    ranges: DataFrame | None = None,
    include_validated: bool = False,
) -> dict[str, Written]:
    """Write all layers under ``output`` and say what was written.

    Counts are observed while writing. Gold reads the written Silver, so nothing is computed
    twice.
    """
    if exists(spark, f"{output}/{versions.POINTER}"):
        raise ValueError(f"{output} holds layers in versions; bring them up to date with update_layers")
    ranges = range_table(spark) if ranges is None else ranges
    done = {"bronze": write_layer(bronze, f"{output}/bronze")}
    stored_bronze = read_layer(spark, f"{output}/bronze")
    done["silver"] = write_layer(
        silver.silver_lab_results(stored_bronze, ranges, include_validated=include_validated), f"{output}/silver"
    )
    stored_silver = read_layer(spark, f"{output}/silver")
    done["cases"] = write_layer(gold.gold_report_context(stored_silver), f"{output}/cases")
    stored_cases = read_layer(spark, f"{output}/cases")
    done["kpis"] = write_layer(gold.dashboard_kpis(stored_silver, stored_cases), f"{output}/kpis")
    return done


BUCKETS = 64


def _bucket(*columns: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, lake: str, version: versions.Version, layer: str, like: DataFrame, touched: list[int]) -> DataFrame:
    """The touched buckets of a layer, or no row before there is one."""
    return versions.read(spark, lake, version, layer, touched) if layer in version.buckets else like.limit(0)


def _buckets_of(rows: DataFrame) -> list[int]:
    return [r[0] for r in rows.select("bucket").distinct().collect()]  # as many as buckets at most


CASE_COUNTS = ["results_count", "abnormal_results_count"]


def _count_names(lake: str, version: versions.Version, layer: str, column: str, changes: DataFrame, buckets: int) -> None:
    """Keep how many cases each patient or order has, and the number of names per bucket."""
    spark = changes.sparkSession
    delta = changes.groupBy(F.col(column).alias("name")).agg(F.sum("change").alias("cases")).where("cases <> 0")
    delta = delta.withColumn("bucket", _bucket("name", buckets=buckets))
    touched = _buckets_of(delta)
    old = _read(spark, lake, version, layer, delta.drop("bucket"), touched)
    merged = old.select("name", "cases").unionByName(delta.drop("bucket")).groupBy("name").agg(F.sum("cases").alias("cases"))
    rows = merged.where("cases > 0").withColumn("bucket", _bucket("name", buckets=buckets))
    versions.replace(lake, version, layer, rows, touched)
    stored = versions.read(spark, lake, version, layer, touched).groupBy(_bucket("name", buckets=buckets).alias("bucket"))
    known = version.counts.setdefault(layer, {})
    known.update({str(b): [0] for b in touched})
    known.update({str(r[0]): [r[1]] for r in stored.count().collect()})


def _kpis(spark: SparkSession, version: versions.Version) -> DataFrame:
    """The dashboard row from the counts per bucket."""
    total = lambda layer, place=0: F.lit(sum(c[place] for c in version.counts[layer].values())).cast("long")
    return spark.range(1).select(
        total("cases", 2).alias("abnormal_results_count"),
        total("cases").alias("ready_for_ai_cases"),
        total("orders").alias("total_orders"),
        total("patients").alias("total_patients"),
        total("cases", 1).alias("total_results"),
        F.current_timestamp().alias("generated_at"),
        F.lit(0).alias("bucket"),
    )


def update_layers(
    spark: SparkSession,
    new_bronze: DataFrame,
    output: str,
    *,
    ranges: DataFrame | None = None,
    include_validated: bool = False,
    buckets: int = BUCKETS,
    batch: str | None = None,
) -> None:
    """Bring Silver, the case layer and the dashboard numbers up to date with new events, all in one step.

    Layers are kept in versions (:mod:`assaylake.sources.versions`) and read by ``read_layer``: a reader never
    sees an update half done, and a run that stops leaves the old state. They are divided into stable buckets,
    of the result id and of the case key. New results are merged with the touched buckets of Silver by the
    rule of the batch run, contexts are rebuilt for the touched cases only, and other buckets are not written.
    Dashboard numbers are sums of counts per bucket; how many cases each patient and order has is kept in two
    small layers of their own, so cases that come or go change only the buckets of their names.

    The result equals a full run over all events, as long as copies of one event are equal. Running a batch
    twice changes nothing. ``buckets`` must stay the same over the life of a lake. A ``batch`` name also stores the
    events as a part of Bronze, before everything else; the same name replaces its part.
    """
    ranges = range_table(spark) if ranges is None else ranges
    if batch is not None:
        new_bronze.write.mode("overwrite").parquet(f"{output}/bronze/batch={batch}")
        new_bronze = spark.read.schema(new_bronze.schema).parquet(f"{output}/bronze/batch={batch}")
    before = versions.current(spark, output)
    version = versions.successor(before)
    fresh = silver.silver_lab_results(new_bronze, ranges, include_validated=include_validated)
    fresh.withColumn("bucket", _bucket("result_id", buckets=buckets)).write.mode("overwrite").parquet(f"{output}/staging/fresh")
    fresh = spark.read.parquet(f"{output}/staging/fresh")
    touched = _buckets_of(fresh)
    if not touched:
        return
    fresh = fresh.drop("bucket")
    old = _read(spark, output, before, "silver", fresh, touched)
    # A result may move to another case: then its old case changes as well.
    replaced = old.join(fresh.select("result_id"), "result_id", "left_semi")
    keys = fresh.select(*CASE_KEYS).unionByName(replaced.select(*CASE_KEYS)).distinct()
    keys.write.mode("overwrite").parquet(f"{output}/staging/keys")
    keys = spark.read.parquet(f"{output}/staging/keys")
    newest = silver.newest_results(old.unionByName(fresh)).withColumn("bucket", _bucket("result_id", buckets=buckets))
    versions.replace(output, version, "silver", newest, touched)

    current = versions.read(spark, output, version, "silver").join(keys, CASE_KEYS, "left_semi")
    contexts = gold.gold_report_context(current)
    case_bucket = _bucket(*CASE_KEYS, buckets=buckets)
    touched = _buckets_of(keys.select(case_bucket.alias("bucket")))
    known = _read(spark, output, before, "cases", contexts, touched)
    untouched = known.join(keys, CASE_KEYS, "left_anti")
    versions.replace(output, version, "cases", untouched.unionByName(contexts).withColumn("bucket", case_bucket), touched)

    stored = versions.read(spark, output, version, "cases", touched).select(*CASE_KEYS, *CASE_COUNTS)
    sums = stored.groupBy(case_bucket.alias("bucket")).agg(F.count("*"), *[F.sum(c) for c in CASE_COUNTS])
    counts = version.counts.setdefault("cases", {})
    counts.update({str(b): [0, 0, 0] for b in touched})
    counts.update({str(b): list(found) for b, *found in sums.collect()})
    came = stored.join(keys, CASE_KEYS, "left_semi").select(*CASE_KEYS, F.lit(1).alias("change"))
    went = known.join(keys, CASE_KEYS, "left_semi").select(*CASE_KEYS, F.lit(-1).alias("change"))
    for layer, column in (("patients", "patient_id"), ("orders", "order_id")):
        _count_names(output, version, layer, column, came.unionByName(went), buckets)
    versions.replace(output, version, "kpis", _kpis(spark, version), [0])
    versions.publish(spark, output, version, before)


def layer_batches(output: str, **settings) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps the layers up to date with a stream of events."""

    def update(events: DataFrame, batch_id: int) -> None:
        update_layers(events.sparkSession, events, output, batch=str(batch_id), **settings)

    return update


def main() -> None:
    parser = argparse.ArgumentParser(description="Write the bronze, silver and gold layers.")
    parser.add_argument("--source", choices=["jsonl", "kafka"], default="jsonl")
    parser.add_argument("--input", nargs="*", default=[], help="JSON lines: the first existing path is read")
    parser.add_argument("--kafka-servers")
    parser.add_argument("--fall-back", action="store_true", help="read the JSON lines when Kafka cannot be read")
    parser.add_argument("--ranges", help="YAML or JSON file with reference ranges")
    parser.add_argument("--output", required=True)
    args = parser.parse_args()
    spark = configure(SparkSession.builder.appName("lab layers").getOrCreate())
    try:
        bronze = event_log.read_bronze(
            spark, args.source, jsonl_paths=args.input, kafka_servers=args.kafka_servers, fall_back=args.fall_back
        )
        ranges = load_ranges(spark, args.ranges) if args.ranges else None
        for layer, written in run_layers(spark, bronze, args.output, ranges=ranges).items():
            print(f"{layer}: {written.records} records in {written.path} ({written.format})")
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
