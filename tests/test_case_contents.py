"""Hashes, texts and dossier lines of cases without nested lists, against the nested ones."""

import pytest
from pyspark.sql import functions as F

from assaylake.functions import texts
from assaylake.operators import case_contents, gold, reports, silver
from assaylake.schemas import CASE_KEYS

AT = "2026-01-01 00:00:00"


@pytest.fixture(scope="module")
def rows(spark, make_events, ranges):
    """One case of 400 results and small ones: quotes, line breaks, other scripts, null fields, a case of one result."""
    hot = [{"event_id": f"H{i}", "result_id": f"R{i:04d}", "value": str(i % 15), "patient_id": "PAT-HOT"} for i in range(400)]
    odd = [
        {"event_id": "O1", "result_id": "O1", "value": None, "unit": None, "patient_id": "PAT-2"},
        {"event_id": "O2", "result_id": 'O"2', "value": 'say "x"\n\t\\ é 中', "unit": "", "patient_id": "PAT-2"},
        {"event_id": "O3", "result_id": "O3", "patient_id": "PAT|3", "order_id": "ORD|1", "modified_at": None, "result_datetime": "bad"},
        {"event_id": "O4", "result_id": "O4", "patient_id": "PAT-4", "test_code": "none", "loinc_code": None, "test_name": ""},
    ]
    return silver.silver_lab_results(make_events(*hot, *odd), ranges, cleaned_at=F.lit(AT).cast("timestamp")).cache()


@pytest.fixture(scope="module")
def nested(rows):
    return gold.gold_report_context(rows, generated_at=F.lit(AT).cast("timestamp")).cache()


def same(left, right):
    names = sorted(left.columns)
    assert sorted(right.columns) == names
    found, wanted = (sorted(map(tuple, df.select(*names).collect()), key=repr) for df in (left, right))
    assert found == wanted and found


def test_contexts_equal_the_nested_ones(rows, nested):
    same(case_contents.case_contexts(rows, generated_at=F.lit(AT).cast("timestamp")), nested.drop("results"))


@pytest.mark.parametrize("batch", ["1", "7", "10000"])
def test_hash_runs_over_batches(spark, rows, nested, batch):
    known = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        same(case_contents.content_hashes(rows), nested.select(*CASE_KEYS, "context_hash"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", known)


def test_texts_equal_the_nested_ones(rows, nested):
    contexts = case_contents.case_contexts(rows)
    drafted = case_contents.with_context_texts(case_contents.with_draft_reports(contexts, rows), rows)
    wanted = nested.select(*CASE_KEYS, texts.draft_report().alias("report_text"), texts.context_text().alias("context_text"))
    same(drafted.select(*CASE_KEYS, "report_text", "context_text"), wanted)
    hot = drafted.where("patient_id = 'PAT-HOT'").first()
    assert "360 additional result(s)" in hot.context_text and hot.context_text.count("\n- ") == 41


def test_flag_counts(rows, nested):
    same(case_contents.case_flag_split(rows), nested.select(*CASE_KEYS, *[c.alias(n) for n, c in texts.flag_split().items()]))


def test_no_case(rows):
    none = rows.limit(0)
    contexts = case_contents.case_contexts(none)
    assert case_contents.with_context_texts(case_contents.with_draft_reports(contexts, none), none).count() == 0


def test_plans_gather_no_list(rows):
    contexts = case_contents.case_contexts(rows)
    drafted = case_contents.with_context_texts(case_contents.with_draft_reports(contexts, rows), rows)
    assert "collect_list" not in drafted._jdf.queryExecution().executedPlan().toString()


def test_dossier_lines_equal_the_nested_ones(spark, rows, nested):
    known = nested.select(F.concat(F.lit("REP-"), "patient_id").alias("report_id"), *CASE_KEYS)
    exports = known.where("patient_id <> 'PAT-4'").select(F.concat(F.lit("EXP-"), "report_id").alias("export_id"), "report_id")
    exports = exports.union(exports.select(F.concat("export_id", F.lit("-again")), "report_id"))  # a report is exported twice
    exports = exports.union(spark.createDataFrame([("EXP-0", "REP-gone")], exports.schema))
    lines = reports.dossier_lines(exports, known, rows)
    wanted = exports.join(known, "report_id").join(nested, CASE_KEYS).select(
        "export_id", F.posexplode(F.transform("results", reports.result_line)).alias("at", "result_line")
    )
    same(lines.select("export_id", "place", "result_line"), wanted.select("export_id", (F.col("at") + 1).alias("place"), "result_line"))


def test_gates_and_drafts_take_contexts_without_lists(spark, rows):
    contexts = case_contents.with_draft_reports(case_contents.case_contexts(rows), rows)
    known = spark.createDataFrame([], "report_id string, patient_id string, order_id string, specimen_id string, created_at timestamp")
    versions = spark.createDataFrame([], "report_id string, report_version_id string, version_number int, source_context_hash string")
    drafts = reports.generate_drafts(contexts, known, versions, F.lit(AT).cast("timestamp"), text=lambda: F.col("report_text"))
    assert drafts.count() == contexts.count() and drafts.where("report_text is null or version_number <> 1").count() == 0
