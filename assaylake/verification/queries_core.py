"""Registered queries over events, Silver and Gold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import ids
from ..operators import gold, silver
from ..schemas import CASE_KEYS
from ..sources import ranges
from ..streaming import jobs
from . import inputs
from .oracle_base import DEDUP_CTE, GOLD_CTE, LAB_CTE, SILVER_CTE, TYPED_CTE
from .registry import as_text, register

@register(
    "event_dedup",
    DEDUP_CTE
    + """ select event_id, event_type, patient_id, order_id, specimen_id, value,
      cast(modified_at as varchar) as modified_at from unique_events""",
)
def event_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted = silver.accepted_events(inputs.lab_events(spark, sf_dir))
    rows = silver.dedup_events(accepted)
    return as_text(rows, "modified_at").select(
        "event_id", "event_type", *CASE_KEYS, "value", "modified_at"
    )


SILVER_OUT = [
    "event_id", "event_type", *CASE_KEYS, "test_code", "loinc_code", "test_name", "value", "value_raw",
    "value_numeric", "value_text", "unit", "reference_range", "abnormal_flag", "validation_status",
    "result_datetime", "result_id", "modified_at",
]


SILVER_SQL = (
    SILVER_CTE
    + """ select event_id, event_type, patient_id, order_id, specimen_id, test_code, loinc_code, test_name, value,
      value_raw, value_numeric, value_text, unit, reference_range, abnormal_flag, validation_status,
      cast(result_datetime as varchar) as result_datetime, result_id, cast(modified_at as varchar) as modified_at
      from silver"""
)


@register("silver_latest", SILVER_SQL)
def silver_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_text(inputs.lab_silver(spark, sf_dir), "result_datetime", "modified_at").select(*SILVER_OUT)


@register("latest_state", SILVER_SQL)
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the streaming state holds after all events, on a batch frame."""
    state = jobs.latest_state(inputs.lab_events(spark, sf_dir))
    rows = jobs.silver_from_state(state, ranges.range_table(spark))
    return as_text(rows, "result_datetime", "modified_at").select(*SILVER_OUT)


@register(
    "silver_rejects",
    TYPED_CTE
    + """ select event_id, event_type, patient_id, order_id, specimen_id,
      case when event_type not in ('LAB_RESULT_CREATED','LAB_RESULT_UPDATED','LAB_RESULT') then 'event_type'
        when trim(patient_id) = '' then 'patient_id' when trim(order_id) = '' then 'order_id'
        when trim(specimen_id) = '' then 'specimen_id' end as reason
      from typed where reason is not null""",
)
def silver_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejects = silver.silver_rejects(inputs.lab_events(spark, sf_dir))
    return rejects.select("event_id", "event_type", *CASE_KEYS, "reason")


@register(
    "parse_numeric",
    LAB_CTE
    + """, n as (select seq, value,
        try_cast(nullif(regexp_extract(value, '[-+]?(?:\\d+(?:\\.\\d*)?|\\.\\d+)'),'') as double) as value_numeric
      from lab)
      select seq, value, value_numeric, case when value_numeric is null then value end as value_text from n""",
)
def parse_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = silver.with_values(inputs.lab_events(spark, sf_dir))
    return rows.select("seq", "value", "value_numeric", "value_text")


@register(
    "parse_timestamps",
    TYPED_CTE
    + """ select seq, cast(result_datetime as varchar) as result_datetime,
      cast(modified_at as varchar) as modified_at from typed""",
)
def parse_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = silver.typed_events(inputs.lab_events(spark, sf_dir))
    return as_text(typed, "result_datetime", "modified_at").select("seq", "result_datetime", "modified_at")


@register(
    "abnormal_flag",
    SILVER_CTE
    + """ select l.seq, l.loinc_code, l.test_code, l.value_numeric,
      case when l.value_numeric is null or r.code is null then 'UNKNOWN' when l.value_numeric < r.low then 'L'
        when l.value_numeric > r.high then 'H' else 'N' end as abnormal_flag
      from (select *, try_cast(nullif(regexp_extract(value, '[-+]?(?:\\d+(?:\\.\\d*)?|\\.\\d+)'),'') as double)
              as value_numeric from lab) l
      left join ranges r on r.code = coalesce(l.loinc_code, l.test_code)""",
)
def abnormal_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = silver.with_values(inputs.lab_events(spark, sf_dir))
    flagged = silver.with_flags(rows, inputs.ranges.range_table(spark))
    return flagged.select("seq", "loinc_code", "test_code", "value_numeric", "abnormal_flag")


@register(
    "derive_result_id",
    TYPED_CTE
    + """ select seq, case when trim(result_id) <> '' then result_id
      else 'RES-' || sha256(concat_ws('|', patient_id, order_id, specimen_id, test_code, cast(result_datetime as varchar)))
      end as result_id from typed""",
)
def derive_result_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = silver.typed_events(inputs.lab_events(spark, sf_dir))
    return typed.select("seq", ids.silver_result_id(F.col("result_id"), F.col("result_datetime")).alias("result_id"))


@register(
    "derive_result_id_raw",
    LAB_CTE
    + """ select seq, 'RES-' || sha256(coalesce(patient_id,'') || '|' || coalesce(order_id,'') || '|' ||
      coalesce(specimen_id,'') || '|' || coalesce(test_code,'') || '|' || coalesce(result_datetime,'')) as result_id
      from lab""",
)
def derive_result_id_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.lab_events(spark, sf_dir).select("seq", ids.raw_result_id().alias("result_id"))


GOLD_COUNTS = (
    "patient_id, order_id, specimen_id, results_count, abnormal_results_count, normal_results_count,"
    " unknown_flag_results_count"
)


@register(
    "gold_report_context",
    GOLD_CTE
    + f""" select {GOLD_COUNTS}, cast(first_result_datetime as varchar) as first_result_datetime,
      cast(last_result_datetime as varchar) as last_result_datetime, validation_status_summary,
      hash_json as results_json, status, context_hash from gold""",
)
def gold_report_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = inputs.lab_gold(spark, sf_dir)
    return as_text(context, "first_result_datetime", "last_result_datetime").withColumn(
        "results_json", F.to_json(F.transform("results", ids.hashed_result))
    ).drop("results", "generated_at")


@register("gold_flag_counts", GOLD_CTE + f" select {GOLD_COUNTS} from gold")
def gold_flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.case_summaries(inputs.lab_silver(spark, sf_dir)).select(
        *CASE_KEYS, "results_count", "abnormal_results_count", "normal_results_count", "unknown_flag_results_count"
    )


@register(
    "gold_results_array",
    SILVER_CTE
    + """ select patient_id, order_id, specimen_id,
      cast(row_number() over (partition by patient_id, order_id, specimen_id order by result_id) - 1 as integer) as position,
      result_id, test_code, loinc_code, test_name, value_raw, value_numeric, value_text, unit, reference_range,
      abnormal_flag, validation_status, cast(result_datetime as varchar) as result_datetime,
      cast(modified_at as varchar) as modified_at from silver""",
)
def gold_results_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_text(gold.exploded_results(inputs.lab_gold(spark, sf_dir)), "result_datetime", "modified_at")


@register(
    "validation_status_summary",
    GOLD_CTE + " select patient_id, order_id, specimen_id, validation_status_summary from gold",
)
def validation_status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.case_summaries(inputs.lab_silver(spark, sf_dir)).select(*CASE_KEYS, "validation_status_summary")


@register("context_hash", GOLD_CTE + " select patient_id, order_id, specimen_id, context_hash from gold")
def context_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.lab_gold(spark, sf_dir).select(*CASE_KEYS, "context_hash")


@register(
    "set_hash",
    SILVER_CTE
    + """ select patient_id, order_id, specimen_id, sha256('[' || string_agg('{' ||
      '"abnormal_flag":' || coalesce(to_json(abnormal_flag),'null') ||
      ',"modified_at":' || to_json(coalesce(cast(modified_at as varchar),'None')) ||
      ',"order_id":' || to_json(order_id) || ',"patient_id":' || to_json(patient_id) ||
      ',"result_id":' || to_json(result_id) || ',"specimen_id":' || to_json(specimen_id) ||
      ',"test_code":' || to_json(test_code) || ',"unit":' || coalesce(to_json(unit),'null') ||
      ',"validation_status":' || to_json(validation_status) || ',"value_raw":' || coalesce(to_json(value_raw),'null') ||
      '}', ',' order by result_id) || ']') as set_hash
      from silver group by all""",
)
def set_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = inputs.lab_gold(spark, sf_dir)

    def with_keys(item):
        return F.struct(*[F.col(k).alias(k) for k in CASE_KEYS], *[item[f].alias(f) for f in gold.RESULT_FIELDS])

    return context.select(*CASE_KEYS, ids.set_hash(F.transform("results", with_keys)).alias("set_hash"))


@register(
    "dashboard_kpis",
    GOLD_CTE
    + """ select count(distinct patient_id) as total_patients, count(distinct order_id) as total_orders,
      count(distinct result_id) as total_results, (select count(*) from gold) as ready_for_ai_cases,
      count(*) filter (abnormal_flag in ('H','L')) as abnormal_results_count from silver""",
)
def dashboard_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.dashboard_kpis(inputs.lab_silver(spark, sf_dir)).drop("generated_at")
