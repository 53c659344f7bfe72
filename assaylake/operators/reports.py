"""Report versions, staleness, gates and the append-only records around them.

Nothing is updated in place: versions, status changes, actions, exports and messages are appended,
and every "current" value is derived from them. Ids come from the content, so a retried task
writes the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from ..functions import ids, texts
from ..functions.values import first_match
from ..schemas import CASE_KEYS, RESULT_FIELDS
from .gold import case_results
from .silver import first_row
from .sizing import row_number_in_pieces

VERSION_COLUMNS = ["report_version_id", "version_number", "source_context_hash", "report_text", "model_name"]


# --- Current state ---------------------------------------------------------------------------


def latest_versions(versions: DataFrame) -> DataFrame:
    """The highest version of every report."""
    return first_row(versions, ["report_id"], [F.col("version_number").desc(), F.col("report_version_id").desc()])


def current_status(changes: DataFrame) -> DataFrame:
    """Status per report after its last change; ``changes`` has report_id, at, seq, status."""
    order = F.struct("at", "seq")
    return changes.groupBy("report_id").agg(
        F.max_by("status", order).alias("status"), F.max("at").alias("updated_at")
    )


def reports_with_status(reports: DataFrame, changes: DataFrame) -> DataFrame:
    """Reports with their folded status; a report without changes is still a draft."""
    return reports.join(current_status(changes), "report_id", "left").withColumns(
        {"status": F.coalesce("status", F.lit(fv.AI_DRAFT)), "updated_at": F.coalesce("updated_at", "created_at")}
    )


def reports_with_latest_version(reports: DataFrame, versions: DataFrame) -> DataFrame:
    """Every report with the columns of its highest version (null without one)."""
    columns = [c for c in VERSION_COLUMNS if c in versions.columns]
    newest = latest_versions(versions).select("report_id", *columns)
    return reports.join(newest, "report_id", "left").withColumn(
        "current_version", F.coalesce("version_number", F.lit(0))
    )


def report_list(reports: DataFrame, versions: DataFrame) -> DataFrame:
    """Reports with their latest version, newest report first."""
    return reports_with_latest_version(reports, versions).orderBy(F.col("created_at").desc(), "report_id")


def case_existing_report(context: DataFrame, reports: DataFrame) -> DataFrame:
    """Every case with its report, the earliest one when there are several."""
    first = reports.groupBy(*CASE_KEYS).agg(F.min_by("report_id", F.struct("created_at", "report_id")).alias("report_id"))
    return context.join(first, CASE_KEYS, "left")


# --- Staleness and gates ---------------------------------------------------------------------


def outdated_check(reports: DataFrame, versions: DataFrame, context: DataFrame) -> DataFrame:
    """Compare the stored hash of every report with the current one of its case.

    ``reports`` carries the folded ``status``. A report without a version is outdated, with empty
    hashes and its status kept. ``case_found`` is false, and ``is_outdated`` null, when a report
    with a version has no case any more. Otherwise different hashes make the status OUTDATED;
    equal hashes never clear it.
    """
    current = context.select(*CASE_KEYS, F.col("context_hash").alias("_current"))
    checked = reports_with_latest_version(reports, versions).join(current, CASE_KEYS, "left")
    no_version = F.col("version_number").isNull()
    stale = F.col("source_context_hash") != F.col("_current")
    return checked.withColumns(
        {
            "stored_source_context_hash": F.when(no_version, "").otherwise(F.col("source_context_hash")),
            "current_context_hash": F.when(no_version, "").otherwise(F.col("_current")),
            "is_outdated": F.when(no_version, True).otherwise(stale),
            "case_found": no_version | F.col("_current").isNotNull(),
            "status": F.when(stale, fv.OUTDATED).otherwise(F.col("status")),
        }
    ).drop("_current")


def _case_missing_text() -> Column:
    return F.format_string(fv.MSG_CASE_MISSING, *[F.col(k) for k in CASE_KEYS])


def _case_missing() -> tuple[Column, Column]:
    return ~F.col("case_found"), _case_missing_text()


def _gate(checked: DataFrame, reason: Column) -> DataFrame:
    return checked.withColumn("reason", reason).withColumn("allowed", F.col("reason").isNull())


def validate_gate(checked: DataFrame, *, strict: bool = False) -> DataFrame:
    """May each checked report be validated? Blocked only while its hash differs.

    ``strict`` also blocks OUTDATED, REJECTED and already validated reports.
    """
    cases = [_case_missing(), (F.col("is_outdated"), fv.MSG_VALIDATE_OUTDATED)]
    if strict:
        status = F.col("status")
        cases += [
            (status == fv.OUTDATED, fv.MSG_VALIDATE_OUTDATED),
            (status == fv.REJECTED, "Report is REJECTED."),
            (status == fv.BIOLOGIST_VALIDATED, "Report is already validated."),
        ]
    return _gate(checked, first_match(cases, None))


def chat_gate(checked: DataFrame) -> DataFrame:
    """May questions be asked: a version exists and the report is not outdated."""
    return _gate(
        checked,
        first_match(
            [
                (F.col("version_number").isNull(), F.format_string(fv.MSG_CHAT_NO_VERSION, F.col("report_id"))),
                _case_missing(),
                (F.col("is_outdated") | (F.col("status") == fv.OUTDATED), fv.MSG_CHAT_OUTDATED),
            ],
            None,
        ),
    )


def export_gate(checked: DataFrame, export_type: Column) -> DataFrame:
    """May each report be exported as this type, and if not, the first reason."""
    status = F.col("status")
    final = export_type == fv.FINAL_PDF
    return _gate(
        checked.withColumn("export_type", export_type),
        first_match(
            [
                _case_missing(),
                (F.col("is_outdated") | (status == fv.OUTDATED), fv.MSG_EXPORT_OUTDATED),
                (F.col("version_number").isNull(), fv.MSG_EXPORT_NO_VERSION),
                (final & (status == fv.AI_DRAFT), fv.MSG_FINAL_DRAFT),
                (final & (status == fv.REJECTED), fv.MSG_FINAL_REJECTED),
                (final & (status != fv.BIOLOGIST_VALIDATED), fv.MSG_FINAL_OTHER),
                ((export_type == fv.DRAFT_PDF) & status.isin(fv.REJECTED, fv.OUTDATED), fv.MSG_DRAFT_BLOCKED),
            ],
            None,
        ),
    )


def report_actions(reports_latest: DataFrame) -> DataFrame:
    """Which actions a user may take on each report (with ``status`` and ``current_version``)."""
    closed = F.col("status").isin(fv.OUTDATED, fv.REJECTED, fv.BIOLOGIST_VALIDATED)
    return reports_latest.withColumns(
        {
            "can_validate": ~closed,
            "can_reject": ~closed,
            "can_chat": (F.col("current_version") > 0) & (F.col("status") != fv.OUTDATED),
            "can_export": F.col("status") == fv.BIOLOGIST_VALIDATED,
        }
    )


# --- New versions ----------------------------------------------------------------------------


def report_id_for_case() -> Column:
    return ids.stable_id("RPT", F.concat_ws("|", *CASE_KEYS))


def version_numbers(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """Number a set of generation requests per report, after the highest stored version.

    ``requests``: report_id, requested_at, request_id. Requests of one report are numbered in time
    order.
    """
    numbered = row_number_in_pieces(requests, ["report_id"], ["requested_at", "request_id"], "_n")
    top = stored.groupBy("report_id").agg(F.max("version_number").alias("_top"))
    return (
        numbered.join(top, "report_id", "left")
        .withColumn("version_number", (F.coalesce("_top", F.lit(0)) + F.col("_n")).cast("int"))
        .drop("_n", "_top")
    )


def _new_versions(selected: DataFrame, versions: DataFrame, created_at: Column, model: Column) -> DataFrame:
    top = versions.groupBy("report_id").agg(F.max("version_number").alias("_top"))
    numbered = selected.join(top, "report_id", "left").withColumn(
        "version_number", (F.coalesce("_top", F.lit(0)) + 1).cast("int")
    )
    return numbered.select(
        ids.stable_id("RPV", F.concat_ws("|", "report_id", F.col("version_number").cast("string"))).alias("report_version_id"),
        "report_id",
        *CASE_KEYS,
        "version_number",
        F.col("context_hash").alias("source_context_hash"),
        "report_text",
        model.alias("model_name"),
        F.lit(fv.AI_DRAFT).alias("status"),
        created_at.alias("created_at"),
        *[c for c in ("is_new_report", "error") if c in selected.columns],
    )


def generate_drafts(
    context: DataFrame,
    reports: DataFrame,
    versions: DataFrame,
    created_at: Column,
    *,
    text: Callable[..., Column] = texts.draft_report,
    model_name: Column | None = None,
) -> DataFrame:
    """A new draft version for every given case.

    The report of the case is reused; without one it is new (``is_new_report``) and its id follows
    from the case keys. ``text`` builds the draft column.
    """
    selected = case_existing_report(context, reports).withColumns(
        {"is_new_report": F.col("report_id").isNull(), "report_id": F.coalesce("report_id", report_id_for_case())}
    )
    model = F.lit(fv.TEMPLATE_PROVIDER) if model_name is None else model_name
    return _new_versions(selected.withColumn("report_text", text()), versions, created_at, model)


def regenerate_drafts(
    reports: DataFrame,
    versions: DataFrame,
    context: DataFrame,
    created_at: Column,
    *,
    text: Callable[..., Column] = texts.draft_report,
    model_name: Column | None = None,
) -> DataFrame:
    """The next version of every given report, from the current state of its case."""
    selected = context.join(reports.select("report_id", *CASE_KEYS), CASE_KEYS, "inner")
    model = F.lit(fv.TEMPLATE_PROVIDER) if model_name is None else model_name
    return _new_versions(selected.withColumn("report_text", text()), versions, created_at, model)


def reports_without_case(reports: DataFrame, context: DataFrame) -> DataFrame:
    return reports.join(context.select(*CASE_KEYS), CASE_KEYS, "left_anti")


def new_reports(drafts: DataFrame) -> DataFrame:
    """The report rows a set of drafts adds."""
    return drafts.filter("is_new_report").select("report_id", *CASE_KEYS, "created_at")


def draft_status_changes(drafts: DataFrame) -> DataFrame:
    return drafts.select("report_id", F.col("created_at").alias("at"), F.lit(0).cast("long").alias("seq"), "status")


def action_status_changes(actions: DataFrame) -> DataFrame:
    """Status changes from validate and reject actions; rejecting is always allowed, other actions change nothing."""
    return actions.filter(F.col("action").isin(fv.ACTION_VALIDATED, fv.ACTION_REJECTED)).select(
        "report_id",
        F.col("created_at").alias("at"),
        F.lit(1).cast("long").alias("seq"),
        F.when(F.col("action") == fv.ACTION_VALIDATED, fv.BIOLOGIST_VALIDATED).otherwise(fv.REJECTED).alias("status"),
    )


def response_gate(responses: DataFrame, text_field: str = "report_text") -> DataFrame:
    """Accept or refuse model responses, with the first failing rule."""

    def empty(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) == ""

    reason = first_match(
        [
            (~F.col("provider").eqNullSafe(F.lit(fv.REMOTE_PROVIDER)), fv.MSG_WRONG_PROVIDER),
            (~F.coalesce(F.col("is_real_llm"), F.lit(False)), fv.MSG_NOT_REAL),
            (empty("model_name"), fv.MSG_NO_MODEL),
            (empty(text_field), fv.MSG_NO_TEXT % text_field),
        ],
        None,
    )
    return responses.withColumn("reason", reason).withColumns(
        {
            "accepted": F.col("reason").isNull(),
            "stored_model_name": F.when(
                F.col("reason").isNull(), texts.storage_model_name(F.col("provider"), F.col("model_name"))
            ),
        }
    )


def response_versions(
    responses: DataFrame, reports: DataFrame, versions: DataFrame, context: DataFrame, created_at: Column
) -> DataFrame:
    """The next version of every report with an accepted model response: its text under its stored model name.

    ``responses`` has one row per report, as :func:`response_gate` takes them. Refused ones give no version;
    their reasons are in the gate's rows. An accepted one whose report or case is gone keeps its row, with an
    ``error`` and without version id, number and status.
    """
    accepted = response_gate(responses).filter("accepted").select("report_id", "report_text", "stored_model_name")
    keyed = accepted.join(reports.select("report_id", *CASE_KEYS, F.lit(True).alias("_known")), "report_id", "left")
    selected = keyed.join(context.select(*CASE_KEYS, "context_hash"), CASE_KEYS, "left")
    missing = F.format_string(fv.MSG_REPORT_MISSING, F.col("report_id"))
    error = F.when(F.col("_known").isNull(), missing).when(F.col("context_hash").isNull(), _case_missing_text())
    made = _new_versions(selected.withColumn("error", error), versions, created_at, F.col("stored_model_name"))
    good = F.col("error").isNull()
    return made.withColumns({c: F.when(good, F.col(c)) for c in ("report_version_id", "version_number", "status")})


# --- Exports ---------------------------------------------------------------------------------


def latest_exports(exports: DataFrame) -> DataFrame:
    """The newest generated export per report."""
    done = exports.filter(F.col("export_status") == fv.EXPORT_GENERATED)
    return first_row(done, ["report_id"], [F.col("generated_at").desc(), F.col("export_id").desc()])


def latest_validations(actions: DataFrame) -> DataFrame:
    """The newest VALIDATED action per report."""
    validated = actions.filter(F.col("action") == fv.ACTION_VALIDATED)
    return first_row(validated, ["report_id"], [F.col("created_at").desc(), F.col("comment").desc_nulls_last()])


def export_list(exports: DataFrame) -> DataFrame:
    return exports.orderBy(F.col("generated_at").desc(), "export_id")


def export_registry(attempts: DataFrame, versions: DataFrame) -> DataFrame:
    """Registry rows of export attempts, each attempt once.

    ``attempts``: report_id, export_type, generated_at, generated_by, file_size_bytes (null when
    the file could not be made), and ``allowed`` and ``reason`` when they went through
    :func:`export_gate`; attempts it forbids are refused with its reason. A failed attempt keeps the
    placeholder file name, and so does one without a version, which has an ``error``.
    """
    newest = latest_versions(versions).select("report_id", "report_version_id", "version_number", "source_context_hash")
    allowed = F.col("allowed") if "allowed" in attempts.columns else F.lit(True)
    reason = F.col("reason") if "reason" in attempts.columns else F.lit(None).cast("string")
    missing = F.col("version_number").isNull()
    made = F.col("file_size_bytes").isNotNull() & allowed & ~missing
    name = texts.export_filename(F.col("export_type"), F.col("report_id"), F.col("version_number"))
    return attempts.join(newest, "report_id", "left").select(
        ids.stable_id(
            "EXP", F.concat_ws("|", "report_id", "export_type", F.col("generated_at").cast("string"))
        ).alias("export_id"),
        "report_id",
        "report_version_id",
        F.when(made, name).otherwise("pending.pdf").alias("pdf_filename"),
        name.alias("requested_filename"),
        F.when(made, fv.EXPORT_GENERATED).otherwise(fv.EXPORT_FAILED).alias("export_status"),
        "source_context_hash",
        "generated_at",
        "generated_by",
        F.when(made, F.col("file_size_bytes")).alias("file_size_bytes"),
        "export_type",
        F.when(~allowed, reason).when(missing, fv.MSG_EXPORT_NO_VERSION).alias("error"),
    )


def result_line(item: Column) -> Column:
    """One row of the printed results table, cells separated by tabs."""
    cells = [
        item["test_name"],
        item["loinc_code"],
        item["value_raw"],
        item["unit"],
        item["reference_range"],
        item["abnormal_flag"],
        item["validation_status"],
        texts.time_text(item["result_datetime"]),
    ]
    return F.array_join(F.array(*cells), "\t", "")


def dossier_headers(
    exports: DataFrame, reports: DataFrame, versions: DataFrame, context: DataFrame, actions: DataFrame, *extra: Column
) -> DataFrame:
    """What a printed report shows besides its result lines, one row per export, also of one whose parts are gone (``error``).

    ``reports`` carries the folded status. Reports and cases are cut down to the exported ones first.
    ``extra`` are further columns of the case; without them the context needs no result list.
    """
    wanted = reports.join(exports.select("report_id").distinct(), "report_id", "left_semi")
    newest = latest_validations(actions).select(
        "report_id", F.col("created_at").alias("validation_date"), F.col("comment").alias("biologist_comment")
    )
    version = reports_with_latest_version(
        wanted, versions.join(wanted.select("report_id"), "report_id", "left_semi")
    ).drop("created_at", "updated_at")
    case = context.join(wanted.select(*CASE_KEYS).distinct(), CASE_KEYS, "left_semi").select(
        *CASE_KEYS,
        "context_hash",
        "results_count",
        "abnormal_results_count",
        "normal_results_count",
        "unknown_flag_results_count",
        "validation_status_summary",
        texts.time_text(F.col("first_result_datetime")).alias("first_result_datetime"),
        texts.time_text(F.col("last_result_datetime")).alias("last_result_datetime"),
        *extra,
    )
    return (
        exports.select("export_id", "report_id", "export_type", "generated_at")
        .join(version, "report_id", "left")
        .join(newest, "report_id", "left")
        .join(case, CASE_KEYS, "left")
        .withColumns(
            {
                "provider_used": F.when(F.col("version_number").isNotNull(), texts.provider_of(F.col("model_name"))),
                "error": first_match(
                    [
                        (F.col("status").isNull(), F.format_string(fv.MSG_REPORT_MISSING, F.col("report_id"))),
                        (F.col("context_hash").isNull(), _case_missing_text()),
                        (F.col("version_number").isNull(), fv.MSG_EXPORT_NO_VERSION),
                    ],
                    None,
                ),
            }
        )
    )


def dossier_lines(exports: DataFrame, reports: DataFrame, silver: DataFrame) -> DataFrame:
    """The result lines of every export as rows: ``export_id, report_id, place`` (from 1), ``result_id, result_line``.

    Places are numbered in pieces, so a case of any size is split over tasks; a consumer reads an export
    in the order of ``place``. Exports whose report or case is gone have no line.
    """
    asked = exports.select("export_id", "report_id").join(reports.select("report_id", *CASE_KEYS), "report_id")
    lines = case_results(silver).join(asked.select(*CASE_KEYS).distinct(), CASE_KEYS, "left_semi").select(
        *CASE_KEYS, "result_id", result_line(F.struct(*RESULT_FIELDS)).alias("result_line")
    )
    placed = row_number_in_pieces(lines, CASE_KEYS, ["result_id"], "place")
    return asked.join(placed, CASE_KEYS).select("export_id", "report_id", "place", "result_id", "result_line")


def export_dossier(
    exports: DataFrame, reports: DataFrame, versions: DataFrame, context: DataFrame, actions: DataFrame
) -> DataFrame:
    """:func:`dossier_headers` with the result lines of the nested context in each row.

    For cases of any size use :func:`dossier_headers` and :func:`dossier_lines`.
    """
    lines = F.transform("results", result_line).alias("result_lines")
    return dossier_headers(exports, reports, versions, context, actions, lines)


# --- Chat ------------------------------------------------------------------------------------


def new_chat_sessions(questions: DataFrame, sessions: DataFrame, created_at: Column) -> DataFrame:
    """One session per asked report that has none yet."""
    asked = questions.select("report_id", "patient_id", "order_id").distinct()
    return asked.join(sessions.select("report_id"), "report_id", "left_anti").select(
        ids.stable_id("CHS", F.col("report_id")).alias("chat_session_id"), "report_id", "patient_id", "order_id",
        created_at.alias("created_at"),
    )


def chat_answers(questions: DataFrame, reports: DataFrame, context: DataFrame) -> DataFrame:
    """The template answer to each question (report_id, question, ...) from the counts of its case.

    A question whose report or case is gone keeps its row, with a null answer and an ``error``.
    """
    asked = questions.join(reports.select("report_id", *CASE_KEYS), "report_id", "left")
    counts = context.select(
        *CASE_KEYS, "results_count", "abnormal_results_count", "normal_results_count", "unknown_flag_results_count"
    )
    found = F.col("results_count").isNotNull()
    return asked.join(counts, CASE_KEYS, "left").select(
        *questions.columns,
        *CASE_KEYS,
        F.when(found, texts.chat_answer(F.col("question"))).alias("answer"),
        first_match(
            [
                (F.col("patient_id").isNull(), F.format_string(fv.MSG_REPORT_MISSING, F.col("report_id"))),
                (~found, _case_missing_text()),
            ],
            None,
        ).alias("error"),
    )


def chat_transcript(answers: DataFrame) -> DataFrame:
    """A user row and an assistant row per answered question."""
    both = F.array(
        F.struct(F.lit(0).alias("part"), F.lit("user").alias("role"), F.col("question").alias("message")),
        F.struct(F.lit(1).alias("part"), F.lit("assistant").alias("role"), F.col("answer").alias("message")),
    )
    kept = [c for c in answers.columns if c not in ("question", "answer")]
    answers = answers.filter(F.col("answer").isNotNull())
    return answers.select(*kept, F.explode(both).alias("_m")).select(*kept, "_m.*")


SESSION_MISSING = "Chat session not found for report_id=%s"


def chat_history(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Messages with their session, oldest first per report; ties keep ``message_seq``.

    A message without a session keeps its row, with an ``error``.
    """
    found = messages.join(sessions.select("report_id", "chat_session_id"), "report_id", "left")
    error = F.when(F.col("chat_session_id").isNull(), F.format_string(SESSION_MISSING, F.coalesce("report_id", F.lit(""))))
    return found.withColumn("error", error).orderBy("report_id", "created_at", "message_seq")


# --- Audit -----------------------------------------------------------------------------------

AUDIT_COLUMNS = ["action", "entity_type", "entity_id", "patient_id", "order_id", "details_json", "created_at"]


def _audit(df: DataFrame, action: Column, entity_type: str, entity_id: str, details: Column) -> DataFrame:
    return df.select(
        action.alias("action"),
        F.lit(entity_type).alias("entity_type"),
        F.col(entity_id).alias("entity_id"),
        "patient_id",
        "order_id",
        details.alias("details_json"),
        F.col("created_at").cast("string").alias("created_at"),
    )


def audit_drafts(versions: DataFrame, action: str = "REPORT_GENERATED") -> DataFrame:
    details = texts.json_object(version=F.col("version_number").cast("string"))
    return _audit(versions, F.lit(action), "report", "report_id", details)


def audit_actions(actions: DataFrame) -> DataFrame:
    details = texts.json_object(comment=texts.json_text(F.col("comment")))
    return _audit(actions, F.concat(F.lit("REPORT_"), F.col("action")), "report", "report_id", details)


def audit_chat(questions: DataFrame) -> DataFrame:
    details = texts.json_object(question=texts.json_text(F.col("question")))
    return _audit(questions, F.lit("CHAT_QUESTION_ANSWERED"), "report", "report_id", details)


def audit_exports(registry: DataFrame) -> DataFrame:
    """Audit rows of registry rows that carry the case keys and, for failures, ``error``."""
    named = registry if "error" in registry.columns else registry.withColumn("error", F.lit(None).cast("string"))
    failed = F.col("export_status") == fv.EXPORT_FAILED
    fields = {
        n: texts.json_text(F.col(c))
        for n, c in {
            "report_id": "report_id",
            "report_version_id": "report_version_id",
            "export_id": "export_id",
            "pdf_filename": "requested_filename",
            "export_type": "export_type",
            "source_context_hash": "source_context_hash",
        }.items()
    }
    details = F.when(
        failed, texts.json_object(**fields, error=texts.json_text(F.coalesce("error", F.lit(""))))
    ).otherwise(texts.json_object(**fields))
    action = (
        F.when(failed, "PDF_GENERATION_FAILED")
        .when(F.col("export_type") == fv.DRAFT_PDF, "DRAFT_PDF_GENERATED")
        .otherwise("PDF_GENERATED")
    )
    return _audit(named.withColumn("created_at", F.col("generated_at")), action, "report_export", "export_id", details)


def audit_log(*parts: DataFrame) -> DataFrame:
    """All audit rows together."""
    log = parts[0].select(*AUDIT_COLUMNS)
    for part in parts[1:]:
        log = log.unionByName(part.select(*AUDIT_COLUMNS))
    return log
