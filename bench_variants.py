"""Time the native operators against the plain way of doing the same work.

Row-at-a-time Python functions for numbers and flags, and one job per dashboard number, are what a
straightforward version of these layers uses. Both variants give the same values (checked here).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import tempfile
import time

from pyspark.sql import SparkSession, functions as F

from assaylake import fixed_values as fv
from assaylake.operators import gold, silver
from assaylake.session import configure
from assaylake.sources.ranges import range_table
from assaylake.streaming import jobs
from assaylake.verification import inputs


def with_python_udfs(rows):
    """Numbers and flags from Python functions called once per row."""
    bounds = {code: (low, high) for code, _, low, high, _ in fv.REFERENCE_RANGES}
    pattern = re.compile(fv.NUMBER_PATTERN)

    def number(text):
        found = pattern.search(text) if text is not None else None
        return float(found.group()) if found else None

    def flag(code, value):
        if value is None or code not in bounds:
            return "UNKNOWN"
        low, high = bounds[code]
        return "L" if value < low else "H" if value > high else "N"

    numeric = rows.withColumn("value_raw", F.col("value")).withColumn("value_numeric", F.udf(number, "double")("value"))
    return numeric.withColumn(
        "abnormal_flag", F.udf(flag, "string")(F.coalesce("loinc_code", "test_code"), F.col("value_numeric"))
    )


def timed(action, runs: int) -> float:
    times = []
    for _ in range(runs + 1):
        start = time.perf_counter()
        action()
        times.append(time.perf_counter() - start)
    return round(statistics.median(times[1:]), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)

    def latest():
        return silver.latest_results(silver.dedup_events(silver.accepted_events(inputs.lab_events(spark, sf_dir))))

    def native():
        return silver.with_flags(silver.with_values(latest()), range_table(spark))

    def run(df):
        df.write.format("noop").mode("overwrite").save()

    columns = ["result_id", "value_numeric", "abnormal_flag"]
    assert native().select(columns).exceptAll(with_python_udfs(latest()).select(columns)).isEmpty()

    def five_jobs():
        rows = native()
        for key in ("patient_id", "order_id", "result_id"):
            rows.select(key).distinct().count()
        gold.gold_report_context(rows.withColumn("is_latest", F.lit(True))).filter("status = 'READY_FOR_AI'").count()
        rows.filter(F.col("abnormal_flag").isin("H", "L")).count()

    def streamed():
        with tempfile.TemporaryDirectory() as folder:  # the session of this script is local
            state = jobs.latest_state(spark.readStream.schema(stored.schema).parquet(bronze))
            flagged = jobs.silver_from_state(state, range_table(spark))
            query = flagged.writeStream.outputMode("update").format("noop").option("checkpointLocation", folder)
            query.trigger(availableNow=True).start().awaitTermination()

    bronze = tempfile.mkdtemp(prefix="bench-bronze-") + "/events"
    inputs.lab_events(spark, sf_dir).write.parquet(bronze)
    stored = spark.read.parquet(bronze)

    seconds = {
        "gold_report_context": timed(lambda: run(inputs.lab_gold(spark, sf_dir)), runs),
        "silver_batch_of_stored_events": timed(lambda: run(silver.silver_lab_results(stored, range_table(spark))), runs),
        "silver_stream_of_stored_events": timed(streamed, runs),
        "silver_native": timed(lambda: run(native()), runs),
        "silver_python_udfs": timed(lambda: run(with_python_udfs(latest())), runs),
        "kpis_one_pass": timed(lambda: gold.dashboard_kpis(native().withColumn("is_latest", F.lit(True))).collect(), runs),
        "kpis_five_jobs": timed(five_jobs, runs),
    }
    print(json.dumps({"unit": "sec", "sf": sf_dir.rsplit("sf", 1)[-1], "median_of": runs, "variants": seconds}))


if __name__ == "__main__":
    main()
