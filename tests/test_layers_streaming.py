import json

import pytest
from pyspark.sql import functions as F

from assaylake.operators import events, gold, reports
from assaylake.plans import layers as runs
from assaylake.plans.layers import run_layers
from assaylake.schemas import EVENT_COLUMNS
from assaylake.sources.layers import read_layer
from assaylake.sources import event_log, layers
from assaylake.sources.ranges import load_ranges
from assaylake.streaming import jobs
from assaylake.verification import inputs

SF = "/root/testdata/sf0.001"


def json_lines(spark, path, files=1):
    rows = inputs.raw_events(spark, SF).select(*EVENT_COLUMNS).repartition(files)
    rows.write.json(str(path))
    return str(path)


def test_jsonl_keeps_bad_lines_as_null_rows(spark, tmp_path):
    lines = ['{"event_id":"a","value":1.50,"extra":1,"unit":{"x":[1]}}', "", "not json", "[1,2", '"text"']
    (tmp_path / "e.jsonl").write_text("\n".join(lines))
    bronze = event_log.bronze_from_jsonl(spark, [str(tmp_path / "none.jsonl"), str(tmp_path / "e.jsonl")])
    rows = bronze.collect()
    assert sorted((r.event_id, r.value, r.unit) for r in rows if r.event_id) == [("a", "1.50", '{"x":[1]}')]
    assert len(rows) == 4 and rows[0].kafka_topic is None and rows[0].ingestion_timestamp is not None
    bad = event_log.read_jsonl(spark, str(tmp_path / "e.jsonl"), keep_bad_lines=True).cache()
    assert bad.filter("_corrupt_record is not null").count() == 3


def test_no_source_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        event_log.bronze_from_jsonl(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    with pytest.raises(ValueError):
        event_log.read_bronze(spark, "other")


def test_kafka_fails_fast_and_falls_back_only_when_asked(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"event_id":"a"}\n')
    paths = [str(tmp_path / "e.jsonl")]
    with pytest.raises(Exception):
        event_log.read_bronze(spark, "kafka", jsonl_paths=paths, kafka_servers="127.0.0.1:1")
    assert event_log.read_bronze(spark, "kafka", jsonl_paths=paths, kafka_servers="127.0.0.1:1", fall_back=True).count() == 1


def test_sample_takes_the_first_objects_in_file_order(spark, tmp_path):
    lines = [f'{{"event_id":"{i}"}}' if i % 3 else ("" if i % 2 else "[1]") for i in range(300)]
    (tmp_path / "e.jsonl").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        sample = events.sample_lines(event_log.read_lines(spark, str(tmp_path / "e.jsonl")), event_log.LINE_ORDER, 100)
        found = [json.loads(r.value)["event_id"] for r in sample.orderBy(*event_log.LINE_ORDER).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == [str(i) for i in range(300) if i % 3][:100]


def test_layers_from_json_lines(spark, tmp_path):
    bronze = event_log.bronze_from_jsonl(spark, [json_lines(spark, tmp_path / "in")])
    done = run_layers(spark, bronze, str(tmp_path / "lake"))
    expected_silver = inputs.lab_silver(spark, SF)
    assert done["bronze"].records == inputs.raw_events(spark, SF).count()
    assert done["silver"].records == expected_silver.count()
    names = [c for c in gold.CONTEXT_COLUMNS if c not in ("results", "generated_at")]
    stored = layers.read_cases(spark, done["cases"].path)
    plain = gold.gold_report_context(expected_silver).select(*names)
    assert stored.select(*names).exceptAll(plain).isEmpty() and done["cases"].records == plain.count()
    kpis = layers.read_layer(spark, done["kpis"].path).first()
    assert (kpis.total_results, kpis.ready_for_ai_cases) == (done["silver"].records, done["cases"].records)


def test_case_lookup_is_pushed_to_the_scan(spark, tmp_path, ranges):
    gold.gold_report_context(inputs.lab_silver(spark, SF)).write.parquet(str(tmp_path / "cases"))
    plan = spark.read.parquet(str(tmp_path / "cases")).filter("patient_id = 'PAT-1' and order_id = 'x'").select("context_hash")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(patient_id,PAT-1)" in text and "ReadSchema: struct<patient_id:string,order_id:string,context_hash:string>" in text


def test_missing_and_empty_case_layers(spark, tmp_path):
    with pytest.raises(layers.NoCases):
        layers.read_cases(spark, str(tmp_path / "nothing"))
    spark.range(0).write.parquet(str(tmp_path / "empty"))
    with pytest.raises(layers.NoCases):
        layers.read_cases(spark, str(tmp_path / "empty"))


def test_ranges_from_yaml_or_json(spark, tmp_path):
    content = {"reference_ranges": {"1-1": {"name": "x", "low": 1, "unit": "u"}, "2-2": {"high": 2.5}}}
    (tmp_path / "r.json").write_text(json.dumps(content))
    assert sorted(tuple(r) for r in load_ranges(spark, str(tmp_path / "r.json")).collect()) == [
        ("1-1", "x", 1.0, None, "u"), ("2-2", None, None, 2.5, None),
    ]


def run_all(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.exception() is None


def test_stream_ingest_then_latest_state_equals_batch(spark, tmp_path, ranges):
    source = json_lines(spark, tmp_path / "in", files=5)
    stream = jobs.jsonl_stream(spark, source, maxFilesPerTrigger="2")
    run_all(jobs.append_to(stream, str(tmp_path / "bronze"), str(tmp_path / "cp1")))
    bronze = spark.read.parquet(str(tmp_path / "bronze"))
    assert bronze.count() == inputs.raw_events(spark, SF).count()

    state = jobs.latest_state(jobs.jsonl_stream(spark, source, maxFilesPerTrigger="2"))
    run_all(state.writeStream.outputMode("complete").format("memory").queryName("latest").option(
        "checkpointLocation", str(tmp_path / "cp2")))
    columns = ["event_id", "result_id", "value_numeric", "abnormal_flag", "modified_at", "validation_status"]
    streamed = jobs.silver_from_state(spark.table("latest"), ranges).select(*columns)
    batch = inputs.lab_silver(spark, SF).select(*columns)
    assert streamed.exceptAll(batch).isEmpty() and batch.exceptAll(streamed).isEmpty()


def test_stream_dedup(spark, tmp_path):
    source = json_lines(spark, tmp_path / "in", files=3)
    stream = jobs.dedup_stream(jobs.jsonl_stream(spark, source, maxFilesPerTrigger="1"))
    run_all(jobs.append_to(stream, str(tmp_path / "out"), str(tmp_path / "cp")))
    unique = inputs.raw_events(spark, SF).select("event_id").distinct().count()
    assert spark.read.parquet(str(tmp_path / "out")).count() == unique


def test_fan_out_by_topic(spark, tmp_path):
    stream = jobs.jsonl_stream(spark, json_lines(spark, tmp_path / "in", files=2))
    run_all(jobs.fan_out_to_files(stream, str(tmp_path / "out"), str(tmp_path / "cp")))
    counts = {r.topic: r["count"] for r in spark.read.json(str(tmp_path / "out")).groupBy("topic").count().collect()}
    raw = inputs.raw_events(spark, SF)
    assert sum(counts.values()) == raw.count() and set(counts) == {"glims.result", "glims.order", "glims.validation"}


def test_checkpoints_go_to_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    assert jobs.stream_checkpoint(spark, "bronze") == shared.rstrip("/") + "/bronze"


def test_staleness_is_marked_on_refreshed_cases(spark, tmp_path):
    cases = gold.gold_report_context(inputs.lab_silver(spark, SF))
    cases.write.parquet(str(tmp_path / "old"))
    cases = spark.read.parquet(str(tmp_path / "old"))
    current = reports.reports_with_status(inputs.reports(cases), inputs.status_changes(cases))
    stream = spark.readStream.schema(cases.schema).parquet(str(tmp_path / "old"))
    check = jobs.staleness_batches(lambda: current, lambda: inputs.versions(cases), str(tmp_path / "changes"), lambda _: F.lit("2026-05-01").cast("timestamp"))
    run_all(stream.writeStream.foreachBatch(check).option("checkpointLocation", str(tmp_path / "cp")))
    marked = spark.read.parquet(str(tmp_path / "changes"))
    stale = inputs.with_scenario(cases).filter("n in (1, 4)")
    assert marked.count() == stale.count() > 0
    assert marked.join(stale, "report_id", "left_anti").isEmpty()
    current = reports.reports_with_status(
        inputs.reports(cases), inputs.status_changes(cases).unionByName(marked.select("report_id", "at", "seq", "status"))
    )
    again = jobs.staleness_batches(
        lambda: current, lambda: inputs.versions(cases), str(tmp_path / "again"), lambda _: F.lit("2026-05-02").cast("timestamp")
    )
    again(cases, 0)
    assert spark.read.parquet(str(tmp_path / "again")).isEmpty()


def test_updated_layers_equal_a_full_run(spark, tmp_path, ranges):
    bronze = inputs.lab_events(spark, SF).drop("seq").cache()
    silver_columns = ["event_id", "result_id", "value", "abnormal_flag", "modified_at"]
    case_columns = ["patient_id", "order_id", "specimen_id", "results_count", "results", "context_hash"]
    run_layers(spark, bronze, str(tmp_path / "full"), ranges=ranges)
    step = F.pmod(F.xxhash64("event_id"), F.lit(3))
    for number in (0, 1, 2, 2):  # the last batch comes twice
        runs.update_layers(spark, bronze.filter(step == number), str(tmp_path / "kept"), ranges=ranges, buckets=5)
    for layer, columns in (("silver", silver_columns), ("cases", case_columns)):
        full, kept = (read_layer(spark, str(tmp_path / x / layer)).select(*columns) for x in ("full", "kept"))
        assert full.exceptAll(kept).isEmpty() and kept.exceptAll(full).isEmpty()
    full, kept = (read_layer(spark, str(tmp_path / x / "kpis")).drop("generated_at").collect() for x in ("full", "kept"))
    assert full == kept and len(full) == 1 and full[0].total_patients > 0
    bronze.unpersist()


def test_a_moved_result_leaves_its_old_case(spark, tmp_path, ranges, make_events):
    moved = make_events({"event_id": "E2", "order_id": "other", "modified_at": "2026-03-01T00:00:00Z"})
    for batch in (make_events({}), moved):
        runs.update_layers(spark, batch, str(tmp_path), ranges=ranges)
    cases = read_layer(spark, str(tmp_path / "cases")).collect()
    assert [(r.order_id, r.results_count) for r in cases] == [("other", 1)]
    kpis = read_layer(spark, str(tmp_path / "kpis")).first()
    assert (kpis.total_orders, kpis.total_patients, kpis.total_results, kpis.ready_for_ai_cases) == (1, 1, 1, 1)
    assert read_layer(spark, str(tmp_path / "orders")).collect() == [("other", 1)]


@pytest.mark.parametrize("stop", ["gold.gold_report_context", "versions.publish"])
def test_a_stopped_update_shows_the_old_state(spark, tmp_path, ranges, make_events, monkeypatch, stop):
    lake = str(tmp_path)
    runs.update_layers(spark, make_events({}), lake, ranges=ranges, buckets=3)
    second = make_events({"event_id": "E2", "modified_at": "2026-03-01T00:00:00Z", "value": "99"}, {"event_id": "E3", "result_id": "R3"})

    def state():
        layers = [read_layer(spark, f"{lake}/{name}") for name in ("silver", "cases", "kpis", "patients", "orders")]
        return [sorted(df.drop("generated_at", "cleaned_at", "silver_processed_at").collect(), key=str) for df in layers]

    def stopped(*_, **__):
        raise RuntimeError("stopped here")

    old = state()
    with monkeypatch.context() as patch:
        place, _, name = stop.rpartition(".")
        patch.setattr(getattr(runs, place) if place else runs, name, stopped)
        with pytest.raises(RuntimeError, match="stopped here"):
            runs.update_layers(spark, second, lake, ranges=ranges, buckets=3)
    assert state() == old
    runs.update_layers(spark, second, lake, ranges=ranges, buckets=3)
    assert read_layer(spark, f"{lake}/kpis").first().total_results == 2
    opened = read_layer(spark, f"{lake}/silver")  # a reader that opened this version reads on over the next one
    runs.update_layers(spark, make_events({"event_id": "E4", "result_id": "R4"}), lake, ranges=ranges, buckets=3)
    assert opened.count() == 2 and read_layer(spark, f"{lake}/silver").count() == 3


def test_a_full_run_does_not_hide_behind_versions(spark, tmp_path, ranges, make_events):
    runs.update_layers(spark, make_events({}), str(tmp_path), ranges=ranges)
    with pytest.raises(ValueError, match="update_layers"):
        runs.run_layers(spark, make_events({}), str(tmp_path), ranges=ranges)


def test_stream_keeps_the_layers(spark, tmp_path, ranges):
    stream = jobs.jsonl_stream(spark, json_lines(spark, tmp_path / "in", files=3), maxFilesPerTrigger="2")
    update = runs.layer_batches(str(tmp_path / "lake"), ranges=ranges, buckets=4)
    run_all(stream.writeStream.foreachBatch(update).option("checkpointLocation", str(tmp_path / "cp")))
    columns = ["event_id", "result_id", "value_numeric", "abnormal_flag"]
    kept, batch = read_layer(spark, str(tmp_path / "lake/silver")).select(*columns), inputs.lab_silver(spark, SF).select(*columns)
    assert kept.exceptAll(batch).isEmpty() and batch.exceptAll(kept).isEmpty()
