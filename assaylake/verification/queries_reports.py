"""Registered queries over cases, reports, exports and chat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import fixed_values as fv
from ..functions import texts
from ..operators import case_contents, cases, gold, reports
from ..schemas import CASE_KEYS
from . import inputs
from .oracle_base import GOLD_CTE, SILVER_CTE
from .queries_events import uuid5_sql
from .registry import as_text, register

KEYS = "patient_id, order_id, specimen_id"


def now() -> Column:
    return F.lit("2026-03-01 00:00:00").cast("timestamp")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def filled(template: str, *slots: str) -> str:
    """SQL text that fills the ``%s`` slots of a fixed text."""
    parts = template.split("%s")
    pieces = [quoted(parts[0])]
    for slot, part in zip(slots, parts[1:]):
        pieces += [f"cast({slot} as varchar)", quoted(part)]
    return "(" + " || ".join(pieces) + ")"


# --- Cases -----------------------------------------------------------------------------------


@register("case_list", GOLD_CTE + f" select {KEYS}, status, results_count from gold")
def case_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.case_list(inputs.lab_gold(spark, sf_dir)).select(*CASE_KEYS, "status", "results_count")


@register(
    "case_lookup",
    GOLD_CTE
    + f""", requests as (
      select distinct patient_id, order_id, case when test_code = '718-7' then null else specimen_id end as specimen_id
      from lab),
    by_order as (
      select patient_id, order_id, count(*) as n, min(specimen_id) as s, min(context_hash) as h, min(status) as st
      from gold group by all),
    answered as (
      select r.patient_id, r.order_id, r.specimen_id,
        case when r.specimen_id is not null then g.specimen_id when o.n = 1 then o.s end as found_specimen_id,
        case when r.specimen_id is not null then g.context_hash when o.n = 1 then o.h end as context_hash,
        case when r.specimen_id is not null then g.status when o.n = 1 then o.st end as status,
        coalesce(case when r.specimen_id is not null then case when g.specimen_id is null then 0 else 1 end else o.n end, 0) as n
      from requests r
      left join gold g on g.patient_id = r.patient_id and g.order_id = r.order_id and g.specimen_id = r.specimen_id
      left join by_order o on o.patient_id = r.patient_id and o.order_id = r.order_id)
    select {KEYS}, found_specimen_id, context_hash, status,
      case when n = 0 then {filled(fv.MSG_CASE_MISSING, "patient_id", "order_id", "coalesce(specimen_id, 'None')")}
        when n > 1 then {quoted(fv.MSG_CASE_AMBIGUOUS)} end as error
    from answered""",
)
def case_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = (
        inputs.lab_events(spark, sf_dir)
        .select(
            "patient_id", "order_id", F.when(F.col("test_code") != "718-7", F.col("specimen_id")).alias("specimen_id")
        )
        .distinct()
    )
    return cases.case_lookup(inputs.lab_gold(spark, sf_dir), requests)


@register(
    "case_search",
    GOLD_CTE
    + f""" select {KEYS}, status from gold
      where lower(concat_ws(' ', patient_id, order_id, specimen_id, status)) like '%-1 ord-1%'""",
)
def case_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.case_search(inputs.lab_gold(spark, sf_dir), "  -1 ORD-1 ").select(*CASE_KEYS, "status")


@register(
    "next_ready_case",
    GOLD_CTE
    + f" select {KEYS}, status from gold order by case when status = 'READY_FOR_AI' then 0 else 1 end, {KEYS} limit 1",
)
def next_ready_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.next_ready_case(inputs.lab_gold(spark, sf_dir)).select(*CASE_KEYS, "status")


@register(
    "case_card",
    GOLD_CTE
    + f""" select {KEYS}, 'READY FOR AI' as status_label, results_count || ' result(s)' as results_text,
      abnormal_results_count || ' abnormal' as abnormal_text, normal_results_count || ' normal' as normal_text,
      unknown_flag_results_count || ' unknown' as unknown_text,
      left(context_hash,10) || '...' || right(context_hash,6) as short_hash,
      left(context_hash,16) || '...' || right(context_hash,8) as detail_hash from gold""",
)
def case_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.case_cards(inputs.lab_gold(spark, sf_dir))


@register(
    "case_flag_split",
    GOLD_CTE
    + f""" select {KEYS}, cast(abnormal_results_count as integer) as abnormal_count,
      cast(normal_results_count as integer) as normal_count, cast(unknown_flag_results_count as integer) as unknown_count
      from gold""",
)
def case_flag_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return case_contents.case_flag_split(inputs.lab_silver(spark, sf_dir))


@register("case_content_hash", GOLD_CTE + f" select {KEYS}, cast(results_count as bigint) as results_count, status, context_hash from gold")
def case_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.contexts_of(inputs.stored_silver(spark, sf_dir)).select(*CASE_KEYS, "results_count", "status", "context_hash")


ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S')"


@register(
    "results_table",
    SILVER_CTE
    + f""" select {KEYS}, result_id, coalesce(nullif(test_name,''),'Unknown test') as test_name,
      coalesce(nullif(loinc_code,''), nullif(test_code,''), 'N/A') as code, coalesce(value_raw,'') as value,
      coalesce(unit,'') as unit, coalesce(nullif(reference_range,''),'N/A') as reference_range, abnormal_flag as flag,
      case when abnormal_flag in ('H','L') then 'flag-abnormal' when abnormal_flag='N' then 'flag-normal'
        else 'flag-unknown' end as flag_class,
      validation_status as status, coalesce({ISO.format('result_datetime')}, '') as result_datetime from silver""",
)
def results_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.results_table(gold.case_results(inputs.lab_silver(spark, sf_dir)))


def _json_fields(*columns: str, times: tuple[str, ...] = ()) -> str:
    parts = []
    for c in columns:
        value = ISO.format(c) if c in times else c
        parts.append(f"""'"{c}":' || coalesce(to_json({value}), 'null')""")
    return " || ',' || ".join(parts)


@register(
    "case_json",
    GOLD_CTE
    + f""", lists as (
      select {KEYS}, '[' || string_agg('{{' || {_json_fields(*gold.RESULT_FIELDS, times=("result_datetime", "modified_at"))}
        || '}}', ',' order by result_id) || ']' as results_json from silver group by all)
    select {KEYS}, '{{' || {_json_fields(*gold.CONTEXT_COLUMNS[:9], times=("first_result_datetime", "last_result_datetime"))}
      || ',"validation_status_summary":' || to_json(validation_status_summary) || ',"results":' || results_json
      || ',' || {_json_fields("status", "context_hash")} || '}}' as case_json
    from gold join lists using ({KEYS})""",
)
def case_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.case_json(inputs.lab_gold(spark, sf_dir).drop("generated_at"))


# --- Texts -----------------------------------------------------------------------------------

RANKED = """, ranked as (
  select *, row_number() over (partition by patient_id, order_id, specimen_id order by result_id) as pos,
    case when abnormal_flag in ('H','L') then 'A' else abnormal_flag end as kind,
    row_number() over (partition by patient_id, order_id, specimen_id,
      case when abnormal_flag in ('H','L') then 'A' else abnormal_flag end order by result_id) as kind_pos
  from silver)"""

PROMPT_CTE = (
    RANKED
    + f""", prompt_lines as (
  select {KEYS}, string_agg('- ' || coalesce(test_name,'') || ' | loinc=' || coalesce(loinc_code,'') || ' | value=' ||
    concat_ws('; ', nullif(value_raw,''), 'numeric=' || cast(value_numeric as varchar), 'text=' || nullif(value_text,''))
    || ' | unit=' || coalesce(unit,'') || ' | reference_range=' || coalesce(reference_range,'') || ' | flag=' ||
    abnormal_flag || ' | status=' || coalesce(validation_status,'') || ' | datetime=' ||
    coalesce({ISO.format('result_datetime')}, ''), chr(10) order by pos) as lines
  from ranked where pos <= 40 group by all),
prompts as (
  select gold.*, concat_ws(chr(10), 'patient_id: ' || patient_id, 'order_id: ' || order_id,
    'specimen_id: ' || specimen_id, 'results_count: ' || results_count,
    'abnormal_results_count: ' || abnormal_results_count, 'normal_results_count: ' || normal_results_count,
    'unknown_flag_results_count: ' || unknown_flag_results_count,
    'validation_status_summary: ' || validation_status_summary, 'context_hash: ' || context_hash, 'results:', lines,
    case when results_count > 40 then
      '- ... ' || (results_count - 40) || ' additional result(s) omitted for prompt compactness.' end) as context_text
  from gold join prompt_lines using ({KEYS}))"""
)


@register(
    "prompt_text",
    GOLD_CTE + PROMPT_CTE + f" select {KEYS}, {quoted(fv.REPORT_INSTRUCTIONS)} || chr(10) || chr(10) || 'Gold context:' || chr(10) || context_text as prompt from prompts",
)
def prompt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    silver = inputs.stored_silver(spark, sf_dir)
    described = case_contents.with_context_texts(inputs.contexts_of(silver), silver)
    return described.select(*CASE_KEYS, texts.report_prompt(F.col("context_text")).alias("prompt"))


def _kind_lines(kind: str, limit: int) -> str:
    return f"""(select {KEYS}, string_agg('- ' || coalesce(nullif(test_name,''),'Unknown test') || ' (' ||
      coalesce(nullif(loinc_code,''), nullif(test_code,''), 'unknown') || '): ' || coalesce(value_raw,'None') || ' ' ||
      coalesce(unit,'') || ' | flag=' || abnormal_flag || ' | status=' || coalesce(nullif(validation_status,''),'UNKNOWN'),
      chr(10) order by pos) filter (kind_pos <= {limit}) ||
      case when count(*) > {limit} then chr(10) || '- ... ' || (count(*) - {limit}) ||
        ' additional results not shown in this draft section.' else '' end as lines
      from ranked where kind = '{kind}' group by {KEYS})"""


NONE_FOUND = quoted(fv.DRAFT_NO_RESULTS)
DRAFT_CTE = (
    RANKED
    + f""", drafts as (
  select gold.*, {filled(
      fv.DRAFT_TEXT, "patient_id", "order_id", "specimen_id",
      f"coalesce({ISO.format('first_result_datetime')}, 'None')", f"coalesce({ISO.format('last_result_datetime')}, 'None')",
      "results_count", "abnormal_results_count", "normal_results_count", "unknown_flag_results_count",
      f"coalesce(a.lines, {NONE_FOUND})", f"coalesce(n.lines, {NONE_FOUND})")} as report_text
  from gold left join {_kind_lines('A', 8)} a using ({KEYS}) left join {_kind_lines('N', 5)} n using ({KEYS}))"""
)


@register("draft_report_text", GOLD_CTE + DRAFT_CTE + f" select {KEYS}, report_text from drafts")
def draft_report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    silver = inputs.stored_silver(spark, sf_dir)
    return case_contents.with_draft_reports(gold.case_summaries(silver), silver).select(*CASE_KEYS, "report_text")


BUSY_GROUP = "(case when user_id % 3 = 0 then 'HOT' else cast(user_id // 20 as varchar) end)"


def _busy(sql: str) -> str:
    """The same over cases of very many results, one with a third of all, so that every limit of the texts is passed."""
    for old, new in (
        ("else 'PAT-' || cast(user_id as varchar) end", f"else 'PAT-' || {BUSY_GROUP} end"),
        ("'ORD-' || cast(user_id as varchar) || '-' || d as order_id", f"'ORD-' || {BUSY_GROUP} as order_id"),
        ("'SPC-' || cast(user_id as varchar) || '-' || d || '-' || cast(event_id%2 as varchar) as specimen_id", "'SPC-1' as specimen_id"),
        ("cast(null as varchar) as reference_range", "case when event_id%3=0 then '1 - 2' end as reference_range"),
    ):
        assert sql.count(old) == 1
        sql = sql.replace(old, new)
    return sql


@register(
    "busy_case_texts",
    _busy(GOLD_CTE + DRAFT_CTE + PROMPT_CTE.removeprefix(RANKED))
    + f""" select {KEYS}, cast(drafts.results_count as bigint) as results_count, report_text, context_text
      from drafts join prompts using ({KEYS})""",
)
def busy_case_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    silver = inputs.busy_silver(spark, sf_dir)
    drafted = case_contents.with_draft_reports(inputs.contexts_of(silver), silver)
    return case_contents.with_context_texts(drafted, silver).select(*CASE_KEYS, "results_count", "report_text", "context_text")


# --- Report tables in SQL --------------------------------------------------------------------


def _ts(day: int, hour: str, minute: str) -> str:
    return f"make_timestamp(2026, 1, {day}, {hour}, {minute}, 0.0)"


STORY_CTE = f""", story as (
  select gold.*, instr('0123456789abcdef', context_hash[1]) - 1 as n, 'RPT-' || left(context_hash,16) as report_id from gold),
reports as (select report_id, {KEYS}, {_ts(2, '0', 'n')} as created_at from story where n < 12),
versions as (
  select 'RPV-' || left(context_hash,16) || '-' || v as report_version_id, report_id, v as version_number,
    case when n in (1,4) or v < top then 'stale-' || context_hash else context_hash end as source_context_hash,
    'text of ' || report_id || ' v' || v as report_text,
    case when n % 2 = 0 then 'mock_medgemma' else 'remote_medgemma:model-a' end as model_name,
    {_ts(2, 'v', 'n')} as created_at
  from (select *, case when n % 3 = 0 then 2 else 1 end as top from story where n < 11),
    (values (1),(2)) as t(v) where v <= top),
changes as (
  select report_id, {_ts(2, 'h', 'n')} as at_time, seq, st as status
  from story join (values
      (null,1,1,'AI_DRAFT'),(2,2,2,'BIOLOGIST_VALIDATED'),(3,2,2,'BIOLOGIST_VALIDATED'),(8,2,2,'BIOLOGIST_VALIDATED'),
      (6,3,2,'BIOLOGIST_VALIDATED'),(6,3,3,'REJECTED'),(5,3,3,'REJECTED'),(7,4,4,'OUTDATED')) as t(k,h,seq,st)
    on (k is null and n < 11) or k = n),
actions as (
  select report_id, patient_id, order_id, action, comment, {_ts(2, 'h', 'n')} as created_at
  from story join (values
      (2,2,'VALIDATED',null),(3,2,'VALIDATED','first'),(3,3,'VALIDATED','second'),(5,3,'REJECTED','no'),
      (6,2,'VALIDATED','fine'),(6,3,'REJECTED','again'),(8,2,'VALIDATED','it is "ok" \\ yes')) as t(k,h,action,comment)
    on k = n),
exports as (
  select 'EXP-' || left(context_hash,16) || '-' || part as export_id, report_id, patient_id, order_id, export_type,
    export_status, {_ts(2, 'h', 'n')} as generated_at
  from story join (values
      (2,'a',5,'FINAL_PDF','GENERATED'),(3,'a',5,'FINAL_PDF','GENERATED'),(3,'b',6,'FINAL_PDF','GENERATED'),
      (8,'a',5,'FINAL_PDF','FAILED'),(9,'a',5,'DRAFT_PDF','GENERATED'),(5,'a',5,'FINAL_PDF','GENERATED'),
      (11,'a',5,'DRAFT_PDF','GENERATED'),(12,'a',5,'FINAL_PDF','GENERATED')) as t(k,part,h,export_type,export_status)
    on k = n),
statuses as (
  select report_id, status, max(at_time) over (partition by report_id) as updated_at from changes
  qualify row_number() over (partition by report_id order by at_time desc, seq desc) = 1),
newest as (
  select * from versions qualify row_number() over (partition by report_id order by version_number desc) = 1),
current_reports as (
  select r.*, coalesce(s.status,'AI_DRAFT') as status, coalesce(s.updated_at, r.created_at) as updated_at
  from reports r left join statuses s using (report_id)),
checked as (
  select r.report_id, r.patient_id, r.order_id, r.specimen_id, v.version_number, v.report_version_id,
    coalesce(v.source_context_hash, '') as stored_source_context_hash,
    case when v.report_id is null then '' else g.context_hash end as current_context_hash,
    coalesce(v.source_context_hash <> g.context_hash, true) as is_outdated,
    case when v.source_context_hash <> g.context_hash then 'OUTDATED' else r.status end as status
  from current_reports r left join newest v using (report_id) join gold g using ({KEYS}))"""
STORY = GOLD_CTE + STORY_CTE


def checked_reports(gold_cases: DataFrame) -> DataFrame:
    current = reports.reports_with_status(inputs.reports(gold_cases), inputs.status_changes(gold_cases))
    return reports.outdated_check(current, inputs.versions(gold_cases), gold_cases)


@register("lifecycle_fold", STORY + " select report_id, status, cast(updated_at as varchar) as updated_at from statuses")
def lifecycle_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_text(reports.current_status(inputs.status_changes(inputs.lab_gold(spark, sf_dir))), "updated_at")


@register(
    "reports_with_latest_version",
    STORY
    + """ select r.report_id, r.patient_id, coalesce(v.version_number,0) as current_version, v.report_version_id,
      v.source_context_hash, v.report_text, v.model_name from reports r left join newest v using (report_id)""",
)
def reports_with_latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold_cases = inputs.lab_gold(spark, sf_dir)
    latest = reports.reports_with_latest_version(inputs.reports(gold_cases), inputs.versions(gold_cases))
    return latest.select(
        "report_id", "patient_id", "current_version", "report_version_id", "source_context_hash", "report_text", "model_name"
    )


@register(
    "report_list",
    STORY
    + f""" select r.report_id, {KEYS}, r.status, cast(r.created_at as varchar) as created_at,
      coalesce(v.version_number,0) as current_version from current_reports r left join newest v using (report_id)""",
)
def report_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold_cases = inputs.lab_gold(spark, sf_dir)
    current = reports.reports_with_status(inputs.reports(gold_cases), inputs.status_changes(gold_cases))
    listed = reports.report_list(current, inputs.versions(gold_cases))
    return as_text(listed, "created_at").select("report_id", *CASE_KEYS, "status", "created_at", "current_version")


@register("case_existing_report", STORY + f" select {KEYS}, r.report_id from gold left join reports r using ({KEYS})")
def case_existing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold_cases = inputs.lab_gold(spark, sf_dir)
    return reports.case_existing_report(gold_cases, inputs.reports(gold_cases)).select(*CASE_KEYS, "report_id")


@register(
    "report_outdated_check",
    STORY + " select report_id, stored_source_context_hash, current_context_hash, is_outdated, status from checked",
)
def report_outdated_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked_reports(inputs.lab_gold(spark, sf_dir)).select(
        "report_id", "stored_source_context_hash", "current_context_hash", "is_outdated", "status"
    )


STRICT_SQL = f"""case when is_outdated or status = 'OUTDATED' then {quoted(fv.MSG_VALIDATE_OUTDATED)}
  when status = 'REJECTED' then 'Report is REJECTED.'
  when status = 'BIOLOGIST_VALIDATED' then 'Report is already validated.' end"""


@register(
    "validate_gate",
    STORY
    + f""" select report_id, not is_outdated as allowed,
      case when is_outdated then {quoted(fv.MSG_VALIDATE_OUTDATED)} end as reason, {STRICT_SQL} as strict_reason from checked""",
)
def validate_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = checked_reports(inputs.lab_gold(spark, sf_dir))
    strict = reports.validate_gate(checked, strict=True).withColumnRenamed("reason", "strict_reason").drop("allowed")
    return reports.validate_gate(strict).select("report_id", "allowed", "reason", "strict_reason")


@register(
    "chat_gate",
    STORY
    + f""" , g as (select report_id, case
        when version_number is null then {filled(fv.MSG_CHAT_NO_VERSION, "report_id")}
        when is_outdated or status = 'OUTDATED' then {quoted(fv.MSG_CHAT_OUTDATED)} end as reason from checked)
      select report_id, reason is null as allowed, reason from g""",
)
def chat_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.chat_gate(checked_reports(inputs.lab_gold(spark, sf_dir))).select("report_id", "allowed", "reason")


@register(
    "export_gate",
    STORY
    + f""" , g as (select report_id, export_type, case
        when is_outdated or status = 'OUTDATED' then {quoted(fv.MSG_EXPORT_OUTDATED)}
        when export_type = 'FINAL_PDF' and status = 'AI_DRAFT' then {quoted(fv.MSG_FINAL_DRAFT)}
        when export_type = 'FINAL_PDF' and status = 'REJECTED' then {quoted(fv.MSG_FINAL_REJECTED)}
        when export_type = 'DRAFT_PDF' and status = 'REJECTED' then {quoted(fv.MSG_DRAFT_BLOCKED)} end as reason
        from checked, (values ('FINAL_PDF'),('DRAFT_PDF')) as t(export_type))
      select report_id, export_type, reason is null as allowed, reason from g""",
)
def export_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = checked_reports(inputs.lab_gold(spark, sf_dir))
    both = checked.withColumn("wanted", F.explode(F.array(F.lit(fv.FINAL_PDF), F.lit(fv.DRAFT_PDF))))
    return reports.export_gate(both, F.col("wanted")).select("report_id", "export_type", "allowed", "reason")


@register(
    "report_actions",
    STORY
    + """ select r.report_id, r.status, r.status not in ('OUTDATED','REJECTED','BIOLOGIST_VALIDATED') as can_validate,
      r.status not in ('OUTDATED','REJECTED','BIOLOGIST_VALIDATED') as can_reject,
      v.report_id is not null and r.status <> 'OUTDATED' as can_chat, r.status = 'BIOLOGIST_VALIDATED' as can_export
      from current_reports r left join newest v using (report_id)""",
)
def report_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold_cases = inputs.lab_gold(spark, sf_dir)
    current = reports.reports_with_status(inputs.reports(gold_cases), inputs.status_changes(gold_cases))
    latest = reports.reports_with_latest_version(current, inputs.versions(gold_cases))
    return reports.report_actions(latest).select(
        "report_id", "status", "can_validate", "can_reject", "can_chat", "can_export"
    )


# --- Drafts ----------------------------------------------------------------------------------


@register(
    "generate_drafts",
    STORY
    + DRAFT_CTE
    + f""", picked as (
      select d.*, r.report_id is null as is_new_report,
        coalesce(r.report_id, {uuid5_sql('RPT', "d.patient_id || '|' || d.order_id || '|' || d.specimen_id")}) as report_id
      from drafts d left join reports r using ({KEYS})),
    numbered as (
      select p.*, coalesce(v.version_number, 0) + 1 as version_number
      from picked p left join newest v on v.report_id = p.report_id)
    select {uuid5_sql('RPV', "report_id || '|' || cast(version_number as varchar)")} as report_version_id, report_id, {KEYS},
      version_number, context_hash as source_context_hash, report_text, 'mock_medgemma' as model_name,
      'AI_DRAFT' as status, '2026-03-01 00:00:00' as created_at, is_new_report
    from numbered""",
)
def generate_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold_cases = inputs.lab_gold(spark, sf_dir)
    drafts = reports.generate_drafts(gold_cases, inputs.reports(gold_cases), inputs.versions(gold_cases), now())
    return as_text(drafts, "created_at")


@register(
    "regenerate_drafts",
    STORY
    + DRAFT_CTE
    + f""" select {uuid5_sql('RPV', "r.report_id || '|' || cast(coalesce(v.version_number,0) + 1 as varchar)")} as report_version_id,
      r.report_id, {KEYS}, coalesce(v.version_number,0) + 1 as version_number, d.context_hash as source_context_hash,
      d.report_text, 'mock_medgemma' as model_name, 'AI_DRAFT' as status, '2026-03-01 00:00:00' as created_at
      from reports r join drafts d using ({KEYS}) left join newest v on v.report_id = r.report_id""",
)
def regenerate_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold_cases = inputs.lab_gold(spark, sf_dir)
    drafts = reports.regenerate_drafts(inputs.reports(gold_cases), inputs.versions(gold_cases), gold_cases, now())
    return as_text(drafts, "created_at")


@register(
    "report_version_numbers",
    STORY
    + """, requests as (select report_id, modified_at as requested_at, result_id as request_id
        from silver join reports using (patient_id, order_id, specimen_id))
      select q.report_id, q.request_id, cast(q.requested_at as varchar) as requested_at,
        coalesce(v.version_number, 0) + row_number() over (partition by q.report_id
          order by q.requested_at nulls first, q.request_id) as version_number
      from requests q left join newest v on v.report_id = q.report_id""",
)
def report_version_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold_cases = inputs.lab_gold(spark, sf_dir)
    requests = (
        gold.exploded_results(gold_cases)
        .join(inputs.reports(gold_cases).drop("created_at"), CASE_KEYS)
        .select("report_id", F.col("modified_at").alias("requested_at"), F.col("result_id").alias("request_id"))
    )
    return as_text(reports.version_numbers(requests, inputs.versions(gold_cases)), "requested_at")


@register(
    "response_gate",
    STORY
    + f""", responses as (
      select report_id, n, case when n=0 then 'other' else 'remote_medgemma' end as provider, n<>4 as is_real_llm,
        case when n<>8 then 'model-a' end as model_name from story),
    g as (
      select report_id, model_name, case when n=0 then {quoted(fv.MSG_WRONG_PROVIDER)} when n=4 then {quoted(fv.MSG_NOT_REAL)}
        when n=8 then {quoted(fv.MSG_NO_MODEL)} when n=10 then {quoted(fv.MSG_NO_TEXT % 'report_text')} end as reason
      from responses)
    select report_id, reason is null as accepted, reason,
      case when reason is null then 'remote_medgemma:' || model_name end as stored_model_name from g""",
)
def response_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = reports.response_gate(inputs.responses(inputs.lab_gold(spark, sf_dir)))
    return gated.select("report_id", "accepted", "reason", "stored_model_name")


@register(
    "response_versions",
    STORY
    + f""" select case when r.report_id is not null then
        {uuid5_sql('RPV', "s.report_id || '|' || cast(coalesce(v.version_number,0) + 1 as varchar)")} end as report_version_id,
      s.report_id, r.patient_id, r.order_id, r.specimen_id,
      case when r.report_id is not null then coalesce(v.version_number,0) + 1 end as version_number,
      case when r.report_id is not null then s.context_hash end as source_context_hash,
      'text of ' || s.report_id as report_text, 'remote_medgemma:model-a' as model_name,
      case when r.report_id is not null then 'AI_DRAFT' end as status, '2026-03-01 00:00:00' as created_at,
      case when r.report_id is null then 'Report not found: ' || s.report_id end as error
      from story s left join reports r on r.report_id = s.report_id left join newest v on v.report_id = r.report_id
      where s.n not in (0, 4, 8, 10)""",
)
def response_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold_cases = inputs.lab_gold(spark, sf_dir)
    made = reports.response_versions(
        inputs.responses(gold_cases), inputs.reports(gold_cases), inputs.versions(gold_cases), gold_cases, now()
    )
    return as_text(made, "created_at")


@register(
    "model_provenance",
    STORY
    + """ select report_version_id, model_name,
      case when model_name like 'remote_medgemma:%' then 'remote_medgemma' when model_name = 'mock_medgemma' then model_name
        else 'unknown' end as provider_used from versions""",
)
def model_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = inputs.versions(inputs.lab_gold(spark, sf_dir))
    return stored.select(
        "report_version_id", "model_name", texts.provider_of(F.col("model_name")).alias("provider_used")
    )


# --- Exports ---------------------------------------------------------------------------------


@register(
    "latest_export",
    STORY
    + """ select report_id, export_id, cast(generated_at as varchar) as generated_at from exports
      where export_status = 'GENERATED'
      qualify row_number() over (partition by report_id order by generated_at desc, export_id desc) = 1""",
)
def latest_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = reports.latest_exports(inputs.exports(inputs.lab_gold(spark, sf_dir)))
    return as_text(newest, "generated_at").select("report_id", "export_id", "generated_at")


LATEST_VALIDATION = """(select * from actions where action = 'VALIDATED'
  qualify row_number() over (partition by report_id order by created_at desc) = 1)"""


@register(
    "latest_validation",
    STORY + f" select report_id, comment, cast(created_at as varchar) as created_at from {LATEST_VALIDATION}",
)
def latest_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = reports.latest_validations(inputs.actions(inputs.lab_gold(spark, sf_dir)))
    return as_text(newest, "created_at").select("report_id", "comment", "created_at")


FILENAME = "regexp_replace(lower(export_type) || '_' || report_id, '[^A-Za-z0-9_.-]+', '_', 'g') || '_v' || version_number || '.pdf'"
REGISTRY_CTE = f""", attempts as (
  select e.*, v.report_version_id, v.version_number, v.source_context_hash,
    case when c.is_outdated or c.status = 'OUTDATED' then {quoted(fv.MSG_EXPORT_OUTDATED)}
      when export_type = 'FINAL_PDF' and c.status = 'AI_DRAFT' then {quoted(fv.MSG_FINAL_DRAFT)}
      when export_type = 'FINAL_PDF' and c.status = 'REJECTED' then {quoted(fv.MSG_FINAL_REJECTED)}
      when v.report_id is null then {quoted(fv.MSG_EXPORT_NO_VERSION)} end as error
  from exports e left join newest v on v.report_id = e.report_id left join checked c on c.report_id = e.report_id),
registry as (
  select {uuid5_sql('EXP', "report_id || '|' || export_type || '|' || cast(generated_at as varchar)")} as export_id,
    report_id, patient_id, order_id, report_version_id, source_context_hash, export_type, generated_at, error,
    case when error is null and export_status = 'GENERATED' then 'GENERATED' else 'FAILED' end as export_status,
    case when error is null and export_status = 'GENERATED' then length(report_id) * 100 end as file_size_bytes,
    lower(export_type) || '_' || report_id || '_v' || version_number || '.pdf' as requested_filename
  from attempts)"""


def gated_registry(gold_cases: DataFrame) -> DataFrame:
    checked = checked_reports(gold_cases).select(
        "report_id", "specimen_id", "case_found", "is_outdated", "status", "version_number"
    )
    attempts = inputs.export_attempts(gold_cases).join(checked, "report_id", "left")
    gated = reports.export_gate(attempts, F.col("export_type")).drop("version_number")
    return reports.export_registry(gated, inputs.versions(gold_cases))


@register(
    "export_registry",
    STORY
    + REGISTRY_CTE
    + """ select export_id, report_id, report_version_id,
      case when export_status = 'GENERATED' then requested_filename else 'pending.pdf' end as pdf_filename,
      requested_filename, export_status, source_context_hash, cast(generated_at as varchar) as generated_at,
      'local-biologist' as generated_by, file_size_bytes, export_type, error from registry""",
)
def export_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_text(gated_registry(inputs.lab_gold(spark, sf_dir)), "generated_at")


@register(
    "export_list",
    STORY
    + """ select export_id, report_id, export_type, export_status, cast(generated_at as varchar) as generated_at
      from exports order by generated_at desc, export_id""",
)
def export_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = reports.export_list(inputs.exports(inputs.lab_gold(spark, sf_dir)))
    return as_text(listed, "generated_at").select("export_id", "report_id", "export_type", "export_status", "generated_at")


@register(
    "export_filename",
    STORY
    + f""" select report_version_id, {FILENAME} as pdf_filename
      from (select report_version_id, 'FINAL_PDF' as export_type, patient_id || ' / ' || r.report_id as report_id, version_number
            from versions join reports r using (report_id))""",
)
def export_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold_cases = inputs.lab_gold(spark, sf_dir)
    rows = inputs.versions(gold_cases).join(inputs.reports(gold_cases).drop("created_at"), "report_id")
    odd_name = F.concat("patient_id", F.lit(" / "), "report_id")
    return rows.select(
        "report_version_id",
        texts.export_filename(F.lit(fv.FINAL_PDF), odd_name, F.col("version_number")).alias("pdf_filename"),
    )


@register(
    "export_dossier",
    STORY
    + f""", lines as (
      select {KEYS}, string_agg(coalesce(test_name,'') || chr(9) || coalesce(loinc_code,'') || chr(9) ||
        coalesce(value_raw,'') || chr(9) || coalesce(unit,'') || chr(9) || coalesce(reference_range,'') || chr(9) ||
        abnormal_flag || chr(9) || coalesce(validation_status,'') || chr(9) ||
        coalesce({ISO.format('result_datetime')},''), chr(10) order by result_id) as result_lines
      from silver group by all)
    select e.export_id, e.report_id, e.export_type, cast(e.generated_at as varchar) as generated_at, {KEYS}, r.status,
      v.version_number, v.source_context_hash, v.report_text, v.model_name,
      case when v.model_name like 'remote%' then 'remote_medgemma' when v.model_name is not null then 'mock_medgemma' end as provider_used,
      a.comment as biologist_comment, cast(a.created_at as varchar) as validation_date, g.context_hash, g.results_count,
      g.validation_status_summary, {ISO.format('g.first_result_datetime')} as first_result_datetime,
      {ISO.format('g.last_result_datetime')} as last_result_datetime, l.result_lines,
      case when r.report_id is null then {filled(fv.MSG_REPORT_MISSING, "e.report_id")}
        when g.patient_id is null then {filled(fv.MSG_CASE_MISSING, "r.patient_id", "r.order_id", "r.specimen_id")}
        when v.report_id is null then {quoted(fv.MSG_EXPORT_NO_VERSION)} end as error
    from exports e left join current_reports r on r.report_id = e.report_id left join newest v on v.report_id = e.report_id
      left join {LATEST_VALIDATION} a on a.report_id = e.report_id
      left join (select * from story where n <> 9) g on g.patient_id = r.patient_id and g.order_id = r.order_id and g.specimen_id = r.specimen_id
      left join lines l on l.patient_id = g.patient_id and l.order_id = g.order_id and l.specimen_id = g.specimen_id""".replace(
        f"{KEYS}, r.status", "r.patient_id, r.order_id, r.specimen_id, r.status"
    ),
)
def export_dossier(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold_cases = inputs.lab_gold(spark, sf_dir)
    current = reports.reports_with_status(inputs.reports(gold_cases), inputs.status_changes(gold_cases))
    remaining = inputs.with_scenario(gold_cases).filter("n <> 9").select(*gold_cases.columns)  # some cases are gone
    dossier = reports.export_dossier(
        inputs.exports(gold_cases), current, inputs.versions(gold_cases), remaining, inputs.actions(gold_cases)
    )
    return (
        as_text(dossier, "generated_at", "validation_date")
        .withColumn("result_lines", F.array_join("result_lines", "\n"))
        .select(
            "export_id", "report_id", "export_type", "generated_at", *CASE_KEYS, "status", "version_number",
            "source_context_hash", "report_text", "model_name", "provider_used", "biologist_comment", "validation_date",
            "context_hash", "results_count", "validation_status_summary", "first_result_datetime", "last_result_datetime",
            "result_lines", "error",
        )
    )


@register(
    "export_dossier_lines",
    STORY
    + f""" select e.export_id, e.report_id,
      cast(row_number() over (partition by e.export_id order by s.result_id) as integer) as place, s.result_id,
      coalesce(test_name,'') || chr(9) || coalesce(loinc_code,'') || chr(9) || coalesce(value_raw,'') || chr(9) ||
        coalesce(unit,'') || chr(9) || coalesce(reference_range,'') || chr(9) || abnormal_flag || chr(9) ||
        coalesce(validation_status,'') || chr(9) || coalesce({ISO.format('result_datetime')},'') as result_line
    from exports e join reports r on r.report_id = e.report_id
      join silver s on s.patient_id = r.patient_id and s.order_id = r.order_id and s.specimen_id = r.specimen_id""",
)
def export_dossier_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold_cases = inputs.lab_gold(spark, sf_dir)
    return reports.dossier_lines(inputs.exports(gold_cases), inputs.reports(gold_cases), inputs.stored_silver(spark, sf_dir))


# --- Chat ------------------------------------------------------------------------------------

CHAT_CTE = f""", talks as (
  select c.*, coalesce(f.report_id, (select min(report_id) from reports)) as report_id from conversations c
  left join (select patient_id, min(report_id) as report_id from reports group by all) f
    on f.patient_id = 'PAT-' || cast(c.conv_id as varchar)),
answers as (
  select t.report_id, t.turn, t.text as question, {_ts(3, '0', 't.turn')} as created_at, r.patient_id, r.order_id,
    {filled(fv.ANSWER_TEXT, "t.text", "g.results_count", "g.abnormal_results_count", "g.normal_results_count",
            "g.unknown_flag_results_count")} as answer
  from talks t join reports r on r.report_id = t.report_id
    join gold g on g.patient_id = r.patient_id and g.order_id = r.order_id and g.specimen_id = r.specimen_id
  where t.role = 'user')"""


def answered(spark: SparkSession, sf_dir: str, gold_cases: DataFrame) -> DataFrame:
    asked = inputs.questions(spark, sf_dir, gold_cases)
    return reports.chat_answers(asked, inputs.reports(gold_cases), gold_cases)


@register("draft_chat_answer", STORY + CHAT_CTE + " select report_id, turn as message_seq, question, answer from answers")
def draft_chat_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answered(spark, sf_dir, inputs.lab_gold(spark, sf_dir)).select(
        "report_id", "message_seq", "question", "answer"
    )


@register(
    "chat_prompt_text",
    STORY
    + PROMPT_CTE
    + CHAT_CTE
    + f""" select a.report_id, a.turn as message_seq, {quoted(fv.CHAT_INSTRUCTIONS)} || chr(10) || chr(10) ||
      'Generated report:' || chr(10) || v.report_text || chr(10) || chr(10) || 'Gold context:' || chr(10) || p.context_text ||
      chr(10) || chr(10) || 'Question:' || chr(10) || a.question as prompt
      from answers a join newest v on v.report_id = a.report_id join reports r on r.report_id = a.report_id
      join prompts p on p.patient_id = r.patient_id and p.order_id = r.order_id and p.specimen_id = r.specimen_id""",
)
def chat_prompt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold_cases = inputs.lab_gold(spark, sf_dir)
    latest = reports.latest_versions(inputs.versions(gold_cases)).select("report_id", "report_text")
    asked = inputs.questions(spark, sf_dir, gold_cases).join(latest, "report_id")
    silver = inputs.stored_silver(spark, sf_dir)
    described = case_contents.with_context_texts(inputs.contexts_of(silver), silver)
    in_context = asked.join(inputs.reports(gold_cases).drop("created_at"), "report_id").join(described, CASE_KEYS)
    prompt = texts.chat_prompt(F.col("report_text"), F.col("question"), F.col("context_text"))
    return in_context.select("report_id", "message_seq", prompt.alias("prompt"))


@register(
    "chat_transcript",
    STORY
    + CHAT_CTE
    + """ select report_id, turn as message_seq, 0 as part, 'user' as role, question as message from answers
      union all select report_id, turn, 1, 'assistant', answer from answers""",
)
def chat_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.chat_transcript(answered(spark, sf_dir, inputs.lab_gold(spark, sf_dir))).select(
        "report_id", "message_seq", "part", "role", "message"
    )


@register(
    "chat_history",
    STORY
    + CHAT_CTE
    + f""" select report_id, 'CHS-' || report_id as chat_session_id, role, text as message, turn as message_seq,
      cast({_ts(3, '0', 'turn')} as varchar) as created_at, cast(null as varchar) as error from talks""",
)
def chat_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold_cases = inputs.lab_gold(spark, sf_dir)
    history = reports.chat_history(
        inputs.chat_messages(spark, sf_dir, gold_cases), inputs.sessions(spark, sf_dir, gold_cases)
    )
    return as_text(history, "created_at").select(
        "report_id", "chat_session_id", "role", "message", "message_seq", "created_at", "error"
    )


@register(
    "chat_sessions",
    STORY
    + CHAT_CTE
    + f""" select distinct {uuid5_sql('CHS', 'report_id')} as chat_session_id, report_id, patient_id, order_id,
      '2026-03-01 00:00:00' as created_at from answers where report_id not in (
        select report_id from talks where role = 'system')""",
)
def chat_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold_cases = inputs.lab_gold(spark, sf_dir)
    messages = inputs.chat_messages(spark, sf_dir, gold_cases)
    open_sessions = messages.filter(F.col("role") == "system").select("report_id")
    return as_text(
        reports.new_chat_sessions(answered(spark, sf_dir, gold_cases), open_sessions, now()), "created_at"
    )


@register(
    "audit_log",
    STORY
    + REGISTRY_CTE
    + CHAT_CTE
    + """ select 'REPORT_GENERATED' as action, 'report' as entity_type, v.report_id as entity_id, r.patient_id, r.order_id,
        '{"version": ' || v.version_number || '}' as details_json, cast(v.created_at as varchar) as created_at
      from versions v join reports r on r.report_id = v.report_id
      union all
      select 'REPORT_REGENERATED', 'report', r.report_id, r.patient_id, r.order_id,
        '{"version": ' || (coalesce(v.version_number, 0) + 1) || '}', '2026-03-01 00:00:00'
      from reports r left join newest v on v.report_id = r.report_id
      union all
      select 'REPORT_' || action, 'report', report_id, patient_id, order_id,
        '{"comment": ' || coalesce(to_json(comment), 'null') || '}', cast(created_at as varchar) from actions
      union all
      select 'CHAT_QUESTION_ANSWERED', 'report', report_id, patient_id, order_id,
        '{"question": ' || to_json(question) || '}', cast(created_at as varchar) from answers
      union all
      select case when export_status = 'FAILED' then 'PDF_GENERATION_FAILED' when export_type = 'DRAFT_PDF'
          then 'DRAFT_PDF_GENERATED' else 'PDF_GENERATED' end, 'report_export', export_id, patient_id, order_id,
        '{' || case when export_status = 'FAILED' then '"error": ' || to_json(coalesce(error, 'disk full')) || ', ' else '' end ||
        '"export_id": "' || export_id || '", "export_type": "' || export_type || '", "pdf_filename": ' ||
        coalesce(to_json(requested_filename), 'null') || ', "report_id": "' || report_id || '", "report_version_id": ' ||
        coalesce(to_json(report_version_id), 'null') || ', "source_context_hash": ' ||
        coalesce(to_json(source_context_hash), 'null') || '}', cast(generated_at as varchar) from registry""",
)
def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold_cases = inputs.lab_gold(spark, sf_dir)
    keyed = inputs.reports(gold_cases).select("report_id", "patient_id", "order_id")
    stored = inputs.versions(gold_cases).join(keyed, "report_id")
    exported = inputs.export_attempts(gold_cases).select("report_id", "patient_id", "order_id").distinct()
    registry = (
        gated_registry(gold_cases)
        .join(exported, "report_id")
        .withColumn("error", F.when(F.col("export_status") == fv.EXPORT_FAILED, F.coalesce("error", F.lit("disk full"))))
    )
    again = reports.regenerate_drafts(
        inputs.reports(gold_cases), inputs.versions(gold_cases), gold_cases, now(), text=lambda: F.lit("")
    )
    return reports.audit_log(
        reports.audit_drafts(stored),
        reports.audit_drafts(again, "REPORT_REGENERATED"),
        reports.audit_actions(inputs.actions(gold_cases)),
        reports.audit_chat(answered(spark, sf_dir, gold_cases)),
        reports.audit_exports(registry),
    )
