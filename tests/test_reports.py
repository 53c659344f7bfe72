import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from assaylake import fixed_values as fv
from assaylake.functions import texts
from assaylake.operators import cases, gold, reports, silver
from assaylake.operators.sizing import range_pieces, row_number_in_pieces, running_last

T1, T2, T3 = (datetime(2026, 1, d) for d in (1, 2, 3))


@pytest.fixture(scope="module")
def context(spark, make_events, ranges):
    events = make_events(
        {}, {"event_id": "E2", "result_id": "R2", "value": "7"},
        {"event_id": "E3", "result_id": "R3", "specimen_id": "SPC-2", "value": "yellow", "test_code": "zz", "loinc_code": None},
    )
    return gold.gold_report_context(silver.silver_lab_results(events, ranges)).cache()


def hash_of(context, specimen="SPC-1"):
    return context.filter(F.col("specimen_id") == specimen).first().context_hash


def frames(spark, context, stored_hash, status="AI_DRAFT", version=True, specimen="SPC-1"):
    report = spark.createDataFrame([("RPT", "PAT-1", "ORD-1", specimen, T1)],
                                   "report_id string, patient_id string, order_id string, specimen_id string, created_at timestamp")
    rows = [("V1", "RPT", 1, "older", "t1", "m", T1), ("V2", "RPT", 2, stored_hash, "t2", "m", T1)] if version else []
    versions = spark.createDataFrame(rows, "report_version_id string, report_id string, version_number int,"
                                     " source_context_hash string, report_text string, model_name string, created_at timestamp")
    changes = spark.createDataFrame([("RPT", T1, 1, "AI_DRAFT"), ("RPT", T2, 1, status)], "report_id string, at timestamp, seq long, status string")
    return report, versions, changes


def checked(spark, context, *args, **kwargs):
    report, versions, changes = frames(spark, context, *args, **kwargs)
    return reports.outdated_check(reports.reports_with_status(report, changes), versions, context)


def test_equal_hash_is_current_and_sticky_outdated_stays(spark, context):
    row = checked(spark, context, hash_of(context), "OUTDATED").first()
    assert (row.is_outdated, row.status, row.current_version) == (False, "OUTDATED", 2)


def test_changed_hash_marks_outdated(spark, context):
    row = checked(spark, context, "hash-1", "BIOLOGIST_VALIDATED").first()
    assert (row.is_outdated, row.status, row.stored_source_context_hash) == (True, "OUTDATED", "hash-1")


def test_no_version_is_outdated_with_empty_hashes_and_kept_status(spark, context):
    row = checked(spark, context, "", "REJECTED", version=False).first()
    assert (row.is_outdated, row.status, row.stored_source_context_hash, row.current_context_hash) == (True, "REJECTED", "", "")


def test_vanished_case_is_an_error_not_a_staleness(spark, context):
    frame = checked(spark, context, "h", specimen="gone")
    row = frame.first()
    assert (row.case_found, row.is_outdated, row.status) == (False, None, "AI_DRAFT")
    for gate in (reports.validate_gate(frame), reports.chat_gate(frame), reports.export_gate(frame, F.lit("FINAL_PDF"))):
        assert gate.first().reason == fv.MSG_CASE_MISSING % ("PAT-1", "ORD-1", "gone")


GATES = {  # status: (validate, strict validate, chat, final export, draft export)
    "AI_DRAFT": (True, True, True, False, True),
    "BIOLOGIST_VALIDATED": (True, False, True, True, True),
    "REJECTED": (True, False, True, False, False),
    "OUTDATED": (True, False, False, False, False),
}


@pytest.mark.parametrize("status", GATES)
def test_gates_by_status(spark, context, status):
    frame = checked(spark, context, hash_of(context), status)
    got = (
        reports.validate_gate(frame), reports.validate_gate(frame, strict=True), reports.chat_gate(frame),
        reports.export_gate(frame, F.lit("FINAL_PDF")), reports.export_gate(frame, F.lit("DRAFT_PDF")),
    )
    assert tuple(g.first().allowed for g in got) == GATES[status]


def test_gate_reasons(spark, context):
    stale = checked(spark, context, "other")
    assert reports.validate_gate(stale).first().reason == fv.MSG_VALIDATE_OUTDATED
    assert reports.export_gate(stale, F.lit("FINAL_PDF")).first().reason == fv.MSG_EXPORT_OUTDATED
    none = checked(spark, context, "", version=False)
    assert reports.chat_gate(none).first().reason == "No report version exists for report: RPT"
    rejected = checked(spark, context, hash_of(context), "REJECTED")
    assert reports.export_gate(rejected, F.lit("FINAL_PDF")).first().reason == fv.MSG_FINAL_REJECTED


def test_drafts_reuse_the_report_and_count_on(spark, context):
    report, versions, _ = frames(spark, context, "h")
    drafts = {r.specimen_id: r for r in reports.generate_drafts(context, report, versions, F.lit(T3)).collect()}
    old, new = drafts["SPC-1"], drafts["SPC-2"]
    assert (old.report_id, old.version_number, old.is_new_report, old.status) == ("RPT", 3, False, "AI_DRAFT")
    assert (new.version_number, new.is_new_report, new.model_name) == (1, True, "mock_medgemma")
    assert old.source_context_hash == hash_of(context) and new.report_id.startswith("RPT-")
    again = reports.generate_drafts(context, report, versions, F.lit(T3)).filter("specimen_id = 'SPC-2'").first()
    assert again.report_version_id == new.report_version_id
    assert reports.new_reports(reports.generate_drafts(context, report, versions, F.lit(T3))).count() == 1
    next_one = reports.regenerate_drafts(report, versions, context, F.lit(T3)).collect()
    assert [(r.report_id, r.version_number) for r in next_one] == [("RPT", 3)]


def test_draft_text(context):
    text = context.filter("specimen_id = 'SPC-1'").select(texts.draft_report().alias("t")).first().t
    assert "Result window: 2026-01-01T00:00:00 to 2026-01-01T00:00:00" in text
    assert "summarizes 2 laboratory result(s)" in text and "includes 1 abnormal, 1 normal, and 0 result(s)" in text
    assert "- Leukocytes (6690-2): 3.9 10*3/uL | flag=L | status=FINAL" in text
    other = context.filter("specimen_id = 'SPC-2'").select(texts.draft_report().alias("t")).first().t
    assert other.count(fv.DRAFT_NO_RESULTS) == 2


def test_long_lists_are_counted_out(spark, make_events, ranges):
    events = make_events(*[{"event_id": f"E{i}", "result_id": f"R{i:03}", "value": "1" if i < 50 else "7"} for i in range(60)])
    case = gold.gold_report_context(silver.silver_lab_results(events, ranges))
    row = case.select(texts.draft_report().alias("d"), texts.context_text().alias("p"), texts.chat_answer(F.lit("why?")).alias("a")).first()
    assert "- ... 42 additional results not shown" in row.d and "- ... 5 additional results not shown" in row.d
    assert row.p.count("\n- Leuko") == 40 and row.p.endswith("- ... 20 additional result(s) omitted for prompt compactness.")
    assert "contains 60 result(s), including 50 abnormal result(s), 10 normal" in row.a and "Question: why?" in row.a


def test_prompt_line(context):
    text = context.filter("specimen_id = 'SPC-2'").select(texts.context_text().alias("t")).first().t
    assert text.splitlines()[9:] == [
        "results:",
        "- Leukocytes | loinc= | value=yellow; text=yellow | unit=10*3/uL | reference_range= | flag=UNKNOWN |"
        " status=FINAL | datetime=2026-01-01T00:00:00",
    ]


def test_lookup_and_search(spark, context):
    asked = spark.createDataFrame(
        [("PAT-1", "ORD-1", "SPC-1"), ("PAT-1", "ORD-1", None), ("PAT-1", "ORD-9", None), ("PAT-1", "ORD-1", "x")],
        "patient_id string, order_id string, specimen_id string",
    )
    errors = {(r.order_id, r.specimen_id): r.error for r in cases.case_lookup(context, asked).collect()}
    assert errors[("ORD-1", "SPC-1")] is None and errors[("ORD-1", None)] == fv.MSG_CASE_AMBIGUOUS
    assert errors[("ORD-9", None)] == fv.MSG_CASE_MISSING % ("PAT-1", "ORD-9", "None")
    assert errors[("ORD-1", "x")] is not None
    assert cases.case_search(context, " ORD-1 spc-2 ready").count() == 1 and cases.case_search(context, " ").count() == 2
    assert cases.next_ready_case(context).first().specimen_id == "SPC-1"


def test_case_json_has_no_nan(spark, context):
    broken = context.withColumn("results", F.transform("results", lambda r: r.withField("value_numeric", F.lit(float("nan")))))
    case = json.loads(cases.case_json(broken).filter("specimen_id = 'SPC-1'").first().case_json)
    assert case["results"][0]["value_numeric"] is None and case["results"][0]["reference_range"] is None
    assert case["results"][0]["modified_at"] == "2026-01-01T00:00:00" and case["results_count"] == 2


def test_response_gate(spark):
    rows = [("remote_medgemma", True, "m", "t"), (None, True, "m", "t"), ("remote_medgemma", None, "m", "t"),
            ("remote_medgemma", True, "", "t"), ("remote_medgemma", True, "m", None), ("other", False, None, None)]
    frame = spark.createDataFrame(rows, "provider string, is_real_llm boolean, model_name string, answer string")
    gated = reports.response_gate(frame, "answer").collect()
    assert [r.reason for r in gated] == [
        None, fv.MSG_WRONG_PROVIDER, fv.MSG_NOT_REAL, fv.MSG_NO_MODEL, fv.MSG_NO_TEXT % "answer", fv.MSG_WRONG_PROVIDER,
    ]
    assert gated[0].stored_model_name == "remote_medgemma:m"


def test_numbers_in_pieces_equal_plain_numbers(spark):
    rows = spark.range(500).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("report_id"),
        F.when(F.col("id") % 50 != 0, F.timestamp_seconds(F.col("id") * 700 % 90000)).alias("at"),
        "id",
    )
    for piece in (None, F.lit(0), F.date_trunc("hour", F.col("at"))):
        numbered = row_number_in_pieces(rows, ["report_id"], ["at", "id"], "n", piece)
        assert numbered.exceptAll(rows.selectExpr("*", "row_number() over (partition by report_id order by at, id) as n")).isEmpty()
    rows = rows.withColumn("at", F.col("at").cast("string"))
    numbered = row_number_in_pieces(rows, ["report_id"], ["at", "id"], "n")
    expected = rows.selectExpr("*", "row_number() over (partition by report_id order by at, id) as n")
    assert numbered.exceptAll(expected).isEmpty() and numbered.count() == 500


def test_one_key_with_one_time_is_spread(spark):
    """Nearly all rows have one key and one time: pieces stay even, numbers and running values stay right."""
    rows = spark.range(20_000).selectExpr(
        "if(id % 50 = 0, concat('r', id), 'hot') as key", "timestamp'2026-01-01' as at", "id",
        "if(id % 7 = 0, cast(id as string), null) as a", "if(id = 3, 'x', null) as b",
    )
    small = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(small, "false")  # Spark would put this little into one range
    sizes = [r["count"] for r in range_pieces(rows, ["key"], ["at"]).groupBy("_piece").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 3 * sum(sizes) / len(sizes)
    numbered = row_number_in_pieces(rows, ["key"], ["at", "id"], "n")
    assert numbered.exceptAll(rows.selectExpr("*", "cast(row_number() over (partition by key order by at, id) as int) as n")).isEmpty()
    assert numbered.count() == 20_000
    run = running_last(rows, ["key"], ["at", "id"], ["a", "b"])
    plain = rows.selectExpr("key", "at", "id", *[f"last({c}, true) over (partition by key order by at, id) as {c}" for c in "ab"])
    assert run.select(*plain.columns).exceptAll(plain).isEmpty() and run.count() == 20_000
    spark.conf.set(small, "true")


def test_equal_rows_get_numbers_of_their_own(spark):
    rows = spark.createDataFrame([(None, None)] * 300 + [("k", 1)] * 5, "key string, at long").repartition(4)
    found = row_number_in_pieces(rows, ["key"], ["at"], "n").collect()
    assert sorted(r.n for r in found if r.key is None) == list(range(1, 301)) and sorted(r.n for r in found if r.key) == [1, 2, 3, 4, 5]


def test_latest_export_and_validation(spark):
    exports = spark.createDataFrame(
        [("e1", "r", "GENERATED", T1), ("e2", "r", "FAILED", T3), ("e3", "r", "GENERATED", T2)],
        "export_id string, report_id string, export_status string, generated_at timestamp",
    )
    assert [r.export_id for r in reports.latest_exports(exports).collect()] == ["e3"]
    actions = spark.createDataFrame([("r", "VALIDATED", "a", T1), ("r", "REJECTED", "b", T3)],
                                    "report_id string, action string, comment string, created_at timestamp")
    assert [r.comment for r in reports.latest_validations(actions).collect()] == ["a"]
    other = spark.createDataFrame([("r", "COMMENTED", None, T3.replace(day=4)), ("r", None, None, T3.replace(day=5))], actions.schema)
    folded = reports.current_status(reports.action_status_changes(actions.unionByName(other))).first()
    assert folded.status == "REJECTED" and folded.updated_at == T3


def test_messages_without_a_session_stay(spark):
    messages = spark.createDataFrame([("r1", "user", "a", 1, T1), ("r2", "user", "b", 1, T1), (None, "user", "c", 1, T1)],
                                     "report_id string, role string, message string, message_seq int, created_at timestamp")
    sessions = spark.createDataFrame([("r1", "s1")], "report_id string, chat_session_id string")
    found = {r.message: (r.chat_session_id, r.error) for r in reports.chat_history(messages, sessions).collect()}
    missing = "Chat session not found for report_id="
    assert found == {"a": ("s1", None), "b": (None, missing + "r2"), "c": (None, missing)}
