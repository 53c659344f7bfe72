import hashlib
import json

import pytest
from pyspark.sql import functions as F

from assaylake.functions import texts
from assaylake.operators import gold, silver
from assaylake.schemas import CASE_KEYS

LATER = "2026-01-02T00:00:00Z"


def rows(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


def test_latest_revision_wins(make_events, ranges):
    events = make_events({}, {"event_id": "EVT-2", "event_type": "LAB_RESULT_UPDATED", "value": "5.0", "modified_at": LATER},
                         drop=["reference_range", "abnormal_flag", "source_system", "origin_source"])
    result = silver.silver_lab_results(events, ranges)
    assert rows(result, "event_id", "value_numeric", "abnormal_flag", "is_latest") == [("EVT-2", 5.0, "N", True)]
    assert "reference_range" in result.columns and "cleaned_at" in result.columns


def test_types_and_keys_decide_what_is_left_out(make_events, ranges):
    events = make_events(
        {"event_id": "a", "event_type": " lab_result ", "result_id": "1"},
        {"event_id": "b", "event_type": "LAB_RESULT_VALIDATED", "result_id": "2"},
        {"event_id": "c", "patient_id": " ", "result_id": "3"},
        {"event_id": "d", "order_id": None, "result_id": "4"},
        {"event_id": "e", "specimen_id": "", "result_id": "5"},
        {"event_id": "f", "event_type": None, "result_id": "6"},
    )
    assert rows(silver.silver_lab_results(events, ranges), "event_id") == [("a",)]
    assert rows(silver.silver_rejects(events), "event_id", "reason") == [
        ("b", "event_type"), ("c", "patient_id"), ("d", "order_id"), ("e", "specimen_id"), ("f", "event_type"),
    ]
    assert rows(silver.silver_lab_results(events, ranges, include_validated=True), "event_id") == [("a",), ("b",)]


def test_missing_result_id_is_derived_and_blank_counts_as_missing(make_events, ranges):
    events = make_events({"event_id": "a", "result_id": None}, {"event_id": "b", "result_id": "  ", "test_code": "x"})
    expected = {
        "RES-" + hashlib.sha256(f"PAT-1|ORD-1|SPC-1|{code}|2026-01-01 00:00:00".encode()).hexdigest()
        for code in ("6690-2", "x")
    }
    assert {r.result_id for r in silver.silver_lab_results(events, ranges).collect()} == expected


def test_flag_uses_test_code_only_without_loinc(make_events, ranges):
    events = make_events(
        {"event_id": "a", "result_id": "1", "loinc_code": None},
        {"event_id": "b", "result_id": "2", "loinc_code": ""},
        {"event_id": "c", "result_id": "3", "loinc_code": "zzz"},
        {"event_id": "d", "result_id": "4", "value": "yellow", "abnormal_flag": "H"},
    )
    assert rows(silver.silver_lab_results(events, ranges), "event_id", "abnormal_flag", "value_text") == sorted([
        ("a", "L", None), ("b", "UNKNOWN", None), ("c", "UNKNOWN", None), ("d", "UNKNOWN", "yellow"),
    ], key=str)


def test_null_event_ids_collapse_unless_kept(make_events, ranges):
    events = make_events({"event_id": None, "result_id": "1"}, {"event_id": None, "result_id": "2", "modified_at": LATER})
    assert rows(silver.silver_lab_results(events, ranges), "result_id") == [("2",)]
    assert rows(silver.silver_lab_results(events, ranges, keep_null_event_ids=True), "result_id") == [("1",), ("2",)]


def test_null_times_lose_and_ties_are_fixed(make_events, ranges):
    events = make_events(
        {"event_id": "a", "modified_at": "bad", "result_datetime": None},
        {"event_id": "b"}, {"event_id": "c"},
        {"event_id": "c", "value": "4.5"},
    )
    for _ in range(3):
        shuffled = events.repartition(7, F.rand())
        assert rows(silver.silver_lab_results(shuffled, ranges), "event_id", "value") == [("c", "3.9")]


def many(spark, make_events, cases=4, results=25):
    return make_events(*[
        {"event_id": f"E{c}-{r}", "result_id": f"R{c}-{r:03}", "order_id": f"ORD-{c}", "value": str(r),
         "validation_status": "final" if r % 2 else "preliminary", "unit": None if r % 3 == 0 else 'u"\\'}
        for c in range(cases) for r in range(results)
    ])


def test_gold_case(make_events, ranges):
    context = gold.gold_report_context(silver.silver_lab_results(
        make_events({}, {"event_id": "EVT-2", "result_id": "RES-2", "value": "12", "validation_status": "preliminary"}), ranges))
    case = context.collect()[0]
    assert (case.results_count, case.abnormal_results_count, case.status) == (2, 2, "READY_FOR_AI")
    assert case.validation_status_summary == "FINAL,PRELIMINARY"
    assert [r.result_id for r in case.results] == ["RES-1", "RES-2"]
    items = [
        {"result_id": i, "test_code": "6690-2", "value_raw": v, "unit": "10*3/uL", "abnormal_flag": f, "validation_status": s,
         "modified_at": "2026-01-01 00:00:00"}
        for i, v, f, s in (("RES-1", "3.9", "L", "FINAL"), ("RES-2", "12", "H", "PRELIMINARY"))
    ]
    text = "PAT-1|ORD-1|SPC-1|" + json.dumps(items, separators=(",", ":"))
    assert case.context_hash == hashlib.sha256(text.encode()).hexdigest()


def test_gold_accepts_text_times(spark, make_events, ranges):
    result = silver.silver_lab_results(make_events({}), ranges)
    as_text = result.withColumns({c: F.col(c).cast("string") for c in ("result_datetime", "modified_at")})
    hashes = [gold.gold_report_context(s).first().context_hash for s in (result, as_text)]
    assert hashes[0] == hashes[1]


def test_hash_does_not_depend_on_row_order(spark, make_events, ranges):
    result = silver.silver_lab_results(many(spark, make_events), ranges)
    one = rows(gold.gold_report_context(result.coalesce(1)), *CASE_KEYS, "context_hash")
    assert one == rows(gold.gold_report_context(result.repartition(11, F.rand())), *CASE_KEYS, "context_hash")


def test_a_very_large_case_keeps_every_result(spark, make_events, ranges):
    count = 150_000
    one = make_events({}).drop("event_id", "result_id", "value")
    large = spark.range(0, count, 1, 8).crossJoin(one).withColumns({
        "event_id": F.format_string("E%07d", "id"), "result_id": F.format_string("R%07d", "id"),
        "value": F.when(F.col("id") % 3 == 0, "1").otherwise("7"),
    }).drop("id")
    context = gold.gold_report_context(silver.silver_lab_results(large, ranges)).cache()
    row = context.select(
        "results_count", F.size("results").alias("listed"), "context_hash", texts.draft_report().alias("draft"),
        texts.context_text().alias("prompt"), texts.chat_answer(F.lit("q")).alias("answer"),
    ).first()
    assert row.results_count == row.listed == count and None not in row
    assert f"- ... {count - 40} additional" in row.prompt and f"contains {count} result(s)" in row.answer
    assert gold.exploded_results(context).count() == count
    context.unpersist()


def test_flag_counts_add_up(spark, make_events, ranges):
    summary = gold.case_summaries(silver.silver_lab_results(many(spark, make_events), ranges))
    wrong = summary.filter("abnormal_results_count + normal_results_count + unknown_flag_results_count <> results_count")
    assert wrong.isEmpty()


def test_kpis_with_and_without_context(spark, make_events, ranges):
    result = silver.silver_lab_results(many(spark, make_events), ranges)
    expected = (100, 4, 4, 1, 100 - 4 * 8)
    for context in (None, gold.gold_report_context(result)):
        k = gold.dashboard_kpis(result, context).first()
        assert (k.total_results, k.ready_for_ai_cases, k.total_orders, k.total_patients, k.abnormal_results_count) == expected


@pytest.mark.parametrize("name", ["silver_latest", "gold_report_context", "apply_updates", "generate_drafts", "kafka_envelope"])
def test_no_python_in_the_plans(spark, name):
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_one_row_per_key_is_cut_before_the_shuffle(spark, make_events, ranges):
    plan = silver.silver_lab_results(make_events({}), ranges)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 4
