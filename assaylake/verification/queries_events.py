"""Registered queries over the event log, the topics and the clinical extract."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..checkpoints import shared_folder
from ..functions import ids
from ..operators import bus, events, extracts
from ..schemas import CASE_KEYS, EVENT_COLUMNS, NORMALIZED_COLUMNS
from ..sources import log_ranges
from ..streaming.cursor import Cursor, changes_after
from . import inputs
from .oracle_base import GOLD_CTE, LAB_CTE
from .registry import as_text, register

RAW_ID = """'RES-' || sha256(coalesce(patient_id,'') || '|' || coalesce(order_id,'') || '|' ||
      coalesce(specimen_id,'') || '|' || coalesce(test_code,'') || '|' || coalesce(result_datetime,''))"""

# Normalised log: defaults filled, rows with times that do not parse left out.
LOG_CTE = (
    LAB_CTE
    + f""", normal as (
  select * replace (coalesce(result_id, {RAW_ID}) as result_id, coalesce(modified_at, result_datetime) as modified_at),
    'GLIMS_SIM' as source_system, 'SYNTHEA' as origin_source
  from lab),
log as (
  select * replace (try_cast(replace(result_datetime,'Z','') as timestamp) as result_datetime,
                    try_cast(replace(modified_at,'Z','') as timestamp) as modified_at)
  from normal
  where try_cast(replace(result_datetime,'Z','') as timestamp) is not null
    and try_cast(replace(modified_at,'Z','') as timestamp) is not null)"""
)
EVENT_OUT = ["seq", "event_id", "event_type", *CASE_KEYS, "result_id", "value", "validation_status", "modified_at"]
EVENT_SQL = (
    "seq, event_id, event_type, patient_id, order_id, specimen_id, result_id, value, validation_status,"
    " cast(modified_at as varchar) as modified_at"
)


def event_rows(df: DataFrame) -> DataFrame:
    return as_text(df, "modified_at").select(*EVENT_OUT)


@register("normalize_event", LOG_CTE + " select " + ", ".join([*EVENT_COLUMNS, "seq"]) + " from normal")
def normalize_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.normalize_events(inputs.raw_events(spark, sf_dir))


@register(
    "invalid_events",
    LOG_CTE
    + """ select seq, event_id, case
      when try_cast(replace(result_datetime,'Z','') as timestamp) is null then 'result_datetime'
      when try_cast(replace(modified_at,'Z','') as timestamp) is null then 'modified_at' end as reason
      from normal where reason is not null""",
)
def invalid_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.invalid_events(inputs.raw_events(spark, sf_dir)).select("seq", "event_id", "reason")


@register(
    "patient_summaries",
    LOG_CTE
    + """ select patient_id, count(distinct order_id) as orders_count, count(distinct result_id) as results_count
      from log group by all""",
)
def patient_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.patient_summaries(inputs.event_log(spark, sf_dir))


@register(
    "order_summaries",
    LOG_CTE
    + """ select patient_id, order_id, specimen_id, count(distinct result_id) as results_count,
      cast(min(result_datetime) as varchar) as first_result_datetime,
      cast(max(result_datetime) as varchar) as last_result_datetime from log group by all""",
)
def order_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_text(
        events.order_summaries(inputs.event_log(spark, sf_dir)), "first_result_datetime", "last_result_datetime"
    )


# Patients, orders and results that are asked for: those with an update somewhere in the log.
UPDATED = "select distinct {} from log where upper(trim(event_type)) = 'LAB_RESULT_UPDATED'"


def updated(log: DataFrame, key: str) -> DataFrame:
    return log.filter(F.upper(F.trim("event_type")) == "LAB_RESULT_UPDATED").select(key).distinct()


@register(
    "patient_results",
    LOG_CTE + f" select {EVENT_SQL} from log where patient_id in ({UPDATED.format('patient_id')})",
)
def patient_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = inputs.event_log(spark, sf_dir)
    found = events.events_for(log, updated(log, "patient_id"), "patient_id")
    return event_rows(found.orderBy("patient_id", "modified_at", "seq"))


@register(
    "order_results",
    LOG_CTE + f" select {EVENT_SQL} from log where order_id in ({UPDATED.format('order_id')})",
)
def order_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = inputs.event_log(spark, sf_dir)
    found = events.events_for(log, updated(log, "order_id"), "order_id")
    return event_rows(found.orderBy("order_id", "modified_at", "seq"))


@register(
    "results_modified_after",
    LOG_CTE + f" select {EVENT_SQL} from log where modified_at > timestamp '2024-01-10 00:00:00'",
)
def results_modified_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_rows(events.search_events(inputs.event_log(spark, sf_dir), modified_after="2024-01-10T00:00:00Z"))


@register(
    "results_page",
    LOG_CTE
    + f""" select {EVENT_SQL} from (select * from log where modified_at > timestamp '2024-01-10 00:00:00'
      order by modified_at, seq limit 1000)""",
)
def results_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = inputs.event_log(spark, sf_dir)
    return event_rows(events.search_events(log, modified_after="2024-01-10T00:00:00Z", limit=1000))


@register(
    "unknown_patients",
    LOG_CTE
    + """ select distinct 'PAT-' || cast(c_custkey as varchar) as patient_id from customer
      where 'PAT-' || cast(c_custkey as varchar) not in (select patient_id from log)""",
)
def unknown_patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    requested = inputs.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("PAT-"), F.col("c_custkey").cast("string")).alias("patient_id")
    )
    return events.unknown_keys(inputs.event_log(spark, sf_dir), requested, "patient_id")


@register(
    "result_history",
    LOG_CTE + f" select {EVENT_SQL} from log where result_id in ({UPDATED.format('result_id')})",
)
def result_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = inputs.event_log(spark, sf_dir)
    return event_rows(events.result_history(log, updated(log, "result_id")))


LATEST_ARRIVAL = """arrived as (
  select * from log qualify row_number() over (partition by result_id order by seq desc) = 1)"""


@register("latest_by_arrival", LOG_CTE + ",\n" + LATEST_ARRIVAL + f" select {EVENT_SQL} from arrived")
def latest_by_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_rows(events.latest_by_arrival(inputs.event_log(spark, sf_dir)))


CHANGED_SQL = """event_id, event_type, patient_id, order_id, specimen_id, test_code, loinc_code, result_id, value, unit,
      reference_range, abnormal_flag, validation_status, cast(result_datetime as varchar) as result_datetime,
      cast(modified_at as varchar) as modified_at"""
CHANGED_OUT = [
    "event_id", "event_type", *CASE_KEYS, "test_code", "loinc_code", "result_id", "value", "unit", "reference_range",
    "abnormal_flag", "validation_status", "result_datetime", "modified_at",
]


@register(
    "apply_updates",
    LOG_CTE
    + ",\n"
    + LATEST_ARRIVAL
    + f""", changes as (
      select result_id, 'UPD-' || event_id || '-' || cast(seq as varchar) as change_id, seq as change_seq,
        modified_at + interval 400 day as changed_at,
        case when event_type like '%updated%' then 'corrected ' || value end as new_value,
        case when seq % 2 = 0 then 'g/L' end as new_unit,
        case when validation_status = 'final' then 'FINAL' end as new_status
      from log),
    folded as (
      select result_id, change_id, changed_at,
        last_value(new_value ignore nulls) over w as new_value, last_value(new_unit ignore nulls) over w as new_unit,
        last_value(new_status ignore nulls) over w as new_status
      from changes window w as (partition by result_id order by changed_at, change_seq
                                rows between unbounded preceding and current row))
    select {CHANGED_SQL} from (
      select a.* replace (f.change_id as event_id, 'LAB_RESULT_UPDATED' as event_type, f.changed_at as modified_at,
        coalesce(f.new_value, a.value) as value, coalesce(f.new_unit, a.unit) as unit,
        coalesce(f.new_status, a.validation_status) as validation_status)
      from arrived a join folded f on a.result_id = f.result_id)""",
)
def apply_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = inputs.event_log(spark, sf_dir)
    changes = log.select(
        "result_id",
        F.concat(F.lit("UPD-"), "event_id", F.lit("-"), F.col("seq").cast("string")).alias("event_id"),
        F.col("seq").alias("change_seq"),
        (F.col("modified_at") + F.expr("interval 400 days")).alias("modified_at"),
        F.when(F.col("event_type").contains("updated"), F.concat(F.lit("corrected "), "value")).alias("value"),
        F.when(F.col("seq") % 2 == 0, "g/L").alias("unit"),
        F.when(F.col("validation_status") == "final", "FINAL").alias("validation_status"),
    )
    return as_text(events.apply_updates(log, changes), "result_datetime", "modified_at").select(*CHANGED_OUT)


@register(
    "apply_validations",
    LOG_CTE
    + ",\n"
    + LATEST_ARRIVAL
    + f""" select {CHANGED_SQL} from (
      select a.* replace ('VAL-' || a.result_id as event_id, 'LAB_RESULT_VALIDATED' as event_type,
        'FINAL' as validation_status, timestamp '2026-02-01 00:00:00' as modified_at)
      from arrived a where result_id in ({UPDATED.format('result_id')}))""",
)
def apply_validations(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = inputs.event_log(spark, sf_dir)
    requests = updated(log, "result_id").select(
        "result_id", F.concat(F.lit("VAL-"), "result_id").alias("event_id"), F.lit("2026-02-01 00:00:00").alias("modified_at")
    )
    return as_text(events.apply_validations(log, requests), "result_datetime", "modified_at").select(*CHANGED_OUT)


@register(
    "layer_counts",
    GOLD_CTE
    + """ select 'events' as layer, count(*) as records from lab union all select 'silver', count(*) from silver
      union all select 'gold', count(*) from gold""",
)
def layer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.layer_counts(
        events=inputs.lab_events(spark, sf_dir),
        silver=inputs.lab_silver(spark, sf_dir),
        gold=inputs.lab_gold(spark, sf_dir),
    )


def _json_field(name: str) -> str:
    return f"""'"{name}":' || coalesce(to_json({name}), 'null')"""


EVENT_JSON = "'{' || " + " || ',' || ".join(_json_field(c) for c in EVENT_COLUMNS) + " || '}'"
TOPIC_SQL = """case when upper(event_type) like '%PATIENT%' then 'glims.patient'
      when upper(event_type) like '%ORDER%' then 'glims.order' when upper(event_type) like '%SPECIMEN%' then 'glims.specimen'
      when upper(event_type) like '%VALIDATED%' or upper(event_type) like '%VALIDATION%' then 'glims.validation'
      else 'glims.result' end"""
SOURCED = ", sourced as (select *, 'GLIMS_SIM' as source_system, 'SYNTHEA' as origin_source from lab)"
KEY_SQL = "coalesce(nullif(result_id,''), nullif(event_id,''), '')"


@register(
    "sample_first_n",
    LAB_CTE
    + SOURCED
    + f""" select seq, {EVENT_JSON} as value from sourced where event_id not like '%7' order by seq limit 100""",
)
def sample_first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = inputs.kafka_messages(spark, sf_dir).select(F.col("offset").alias("seq"), "value")
    return events.sample_lines(lines, ["seq"])


@register("topic_routing", LAB_CTE + f" select seq, event_type, {TOPIC_SQL} as topic from lab")
def topic_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.lab_events(spark, sf_dir).select("seq", "event_type", bus.topic_of(F.col("event_type")).alias("topic"))


@register(
    "kafka_envelope",
    LAB_CTE + SOURCED + f" select seq, {KEY_SQL} as key, {EVENT_JSON} as value, {TOPIC_SQL} as topic from sourced",
)
def kafka_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bus.envelopes(inputs.raw_events(spark, sf_dir), carry=["seq"])


@register(
    "publish_report",
    LAB_CTE
    + f""", routed as (select {TOPIC_SQL} as topic from lab)
      select count(*) as published_count, string_agg(distinct topic, ',' order by topic) as topics_used from routed""",
)
def publish_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = bus.publish_report(bus.envelopes(inputs.raw_events(spark, sf_dir)))
    return report.withColumn("topics_used", F.array_join("topics_used", ","))


MESSAGES = (
    SOURCED
    + f""", messages as (
      select seq as "offset", {TOPIC_SQL} as topic,
        case when event_id like '%7' then 'no json ' || event_id else {EVENT_JSON} end as value,
        case when event_id like '%7' then '{{"raw_message":"no json ' || event_id || '"}}' else {EVENT_JSON} end as message
      from sourced)"""
)


@register("topic_messages", LAB_CTE + MESSAGES + ' select "offset", topic, message from messages')
def topic_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bus.topic_messages(inputs.kafka_messages(spark, sf_dir)).select("offset", "topic", "message")


@register(
    "topic_peek",
    LAB_CTE
    + MESSAGES
    + """ select "offset", topic, message from messages where topic = 'glims.result' order by "offset" limit 10""",
)
def topic_peek(spark: SparkSession, sf_dir: str) -> DataFrame:
    peek = bus.topic_peek(inputs.kafka_messages(spark, sf_dir), "glims.result", 10)
    return peek.select("offset", "topic", "message")


@register(
    "parsed_messages",
    LAB_CTE
    + SOURCED
    + f""" select {', '.join(f"case when event_id like '%7' then null else {c} end as {c}" for c in EVENT_COLUMNS)},
      {TOPIC_SQL} as kafka_topic, 0 as kafka_partition, seq as kafka_offset from sourced""",
)
def parsed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bus.parsed_events(inputs.kafka_messages(spark, sf_dir))


CHANGES_PAGE_SQL = (
    LOG_CTE
    + f""", edge as (select modified_at as m, event_id as i, seq as s from log where event_id like '%7'
        order by modified_at, event_id, seq limit 1)
      select {EVENT_SQL} from (
        select log.* from log, edge
        where modified_at > m or (modified_at = m and (event_id > i or (event_id = i and seq > s)))
        order by modified_at, event_id, seq limit 1000)"""
)


def _edge(log: DataFrame) -> Cursor:
    """The first of two copies of one event."""
    edge = log.filter(F.col("event_id").endswith("7")).orderBy("modified_at", "event_id", "seq").first()
    return Cursor(edge["modified_at"], edge["event_id"], edge["seq"])


@register("changes_page", CHANGES_PAGE_SQL)
def changes_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page after the first of two copies of one event."""
    log = inputs.event_log(spark, sf_dir)
    return event_rows(changes_after(log, _edge(log), limit=1000))


@register("changes_page_by_range", CHANGES_PAGE_SQL)
def changes_page_by_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same page from a log stored in ranges, of which it opens a few."""
    log, folder = inputs.event_log(spark, sf_dir), f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    log_ranges.write_ranges(log, folder, rows_per_range=2_000)
    return event_rows(log_ranges.page_after(spark, folder, _edge(log), 1000))


@register(
    "append_events",
    LOG_CTE
    + f""" select {EVENT_SQL} from log
      union all
      select seq + 1000000000, 'AGAIN-' || event_id, event_type, patient_id, order_id, specimen_id, result_id, value,
        validation_status, cast(modified_at as varchar) from log where event_type = 'LAB_RESULT_VALIDATED'""",
)
def append_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = inputs.event_log(spark, sf_dir)
    again = log.filter("event_type = 'LAB_RESULT_VALIDATED'").withColumns(
        {"event_id": F.concat(F.lit("AGAIN-"), F.col("event_id")), "seq": F.col("seq") + 1_000_000_000}
    )
    return event_rows(events.append_events(log, again))


# --- Clinical extract ------------------------------------------------------------------------

OBS_CTE = """with obs as (
  select case when o_orderstatus='P' then 'visitor-' || cast(o_custkey as varchar) else cast(o_custkey as varchar) end
      as patient,
    cast(o_orderkey as varchar) as encounter,
    case when o_orderpriority='4-NOT SPECIFIED' then ' ' else o_orderpriority end as code,
    'Test ' || o_orderpriority as description, cast(o_totalprice as varchar) as value,
    substr(cast(o_orderdate as varchar),1,10) as date,
    case o_orderpriority when '1-URGENT' then 'Laboratory results' when '2-HIGH' then ' LAB '
      when '3-MEDIUM' then 'labour' else 'laboratory' end as category
  from orders),
labs as (
  select * from obs where trim(value) <> '' and trim(code) <> ''
    and (lower(category) like '%laboratory%' or lower(trim(category)) = 'lab')),
patients as (select cast(c_custkey as varchar) as id from customer)"""


@register("lab_predicate", OBS_CTE + " select encounter, patient, code, value from labs")
def lab_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.extract_observations(spark, sf_dir)
    return rows.filter(extracts.lab_predicate(rows)).selectExpr(
        "ENCOUNTER as encounter", "PATIENT as patient", "CODE as code", "VALUE as value"
    )


@register("obs_known_patient", OBS_CTE + " select encounter, patient from labs where patient in (select id from patients)")
def obs_known_patient(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.extract_observations(spark, sf_dir)
    known = extracts.known_patient_observations(
        rows.filter(extracts.lab_predicate(rows)), inputs.extract_patients(spark, sf_dir)
    )
    return known.selectExpr("ENCOUNTER as encounter", "PATIENT as patient")


@register(
    "obs_unknown_patient",
    OBS_CTE + " select encounter, patient from labs where patient not in (select id from patients)",
)
def obs_unknown_patient(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.extract_observations(spark, sf_dir)
    unknown = extracts.unknown_patient_observations(
        rows.filter(extracts.lab_predicate(rows)), inputs.extract_patients(spark, sf_dir)
    )
    return unknown.selectExpr("ENCOUNTER as encounter", "PATIENT as patient")


NAMESPACE_HEX = "edfd8fc027fe4dd0934504878fc56d09"


def uuid5_sql(prefix: str, text: str) -> str:
    """DuckDB text for the version-5 UUID of ``text`` in the fixed namespace."""
    digest = f"sha1(unhex('{NAMESPACE_HEX}') || encode({text}))"
    return (
        f"(select '{prefix}-' || substr(h,1,8) || '-' || substr(h,9,4) || '-5' || substr(h,14,3) || '-' ||"
        f" substr('89ab89ab89ab89ab', instr('0123456789abcdef', substr(h,17,1)), 1) || substr(h,18,3) || '-' ||"
        f" substr(h,21,12) from (select {digest} as h))"
    )


def _pad_hex(byte: int) -> str:
    key = inputs.SECRET.encode().ljust(64, b"\0")
    return bytes(b ^ byte for b in key).hex()


HMAC_SQL = (
    "'PAT-' || sha256(unhex('" + _pad_hex(0x5C) + "') || unhex(sha256(unhex('" + _pad_hex(0x36) + "') || encode({}))))"
)


@register("pseudonymize", f"select c_custkey, {HMAC_SQL.format('cast(c_custkey as varchar)')} as patient_id from customer")
def pseudonymize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.table(spark, sf_dir, "customer")
    return rows.select("c_custkey", ids.pseudonym(F.col("c_custkey").cast("string"), inputs.SECRET).alias("patient_id"))


ORDER_TEXT = "case when o_orderstatus='O' then 'SYNTHEA|' || cast(o_orderkey as varchar) || '|order' else cast(o_custkey as varchar) end"
SPECIMEN_TEXT = f"case when o_orderstatus='F' then o_orderpriority else {ORDER_TEXT} || '|specimen' end"


@register(
    "stable_ids",
    f"""select o_orderkey, {uuid5_sql('EVT', "'SYNTHEA|' || cast(o_orderkey as varchar)")} as event_id,
      {uuid5_sql('ORD', ORDER_TEXT)} as order_id, {uuid5_sql('SPC', SPECIMEN_TEXT)} as specimen_id from orders""",
)
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.col("o_orderkey").cast("string").alias("source_observation_id"),
        F.when(F.col("o_orderstatus") == "O", "").otherwise(F.col("o_custkey").cast("string")).alias("source_order_id"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("source_specimen_id"),
    )
    return extracts.with_stable_ids(rows).select("o_orderkey", "event_id", "order_id", "specimen_id")


@register(
    "reference_tail",
    """select c_custkey, regexp_extract(rtrim(case when c_nationkey % 5 = 0 then c_name
        when c_nationkey % 5 = 1 then 'Patient/' || c_name || '//' else 'urn/Patient/' || c_name end, '/'), '[^/]*$') as tail
      from customer""",
)
def reference_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference = (
        F.when(F.col("c_nationkey") % 5 == 0, F.col("c_name"))
        .when(F.col("c_nationkey") % 5 == 1, F.concat(F.lit("Patient/"), "c_name", F.lit("//")))
        .otherwise(F.concat(F.lit("urn/Patient/"), "c_name"))
    )
    return inputs.table(spark, sf_dir, "customer").select("c_custkey", extracts.reference_tail(reference).alias("tail"))


@register(
    "extract_events",
    OBS_CTE
    + f""", kept as (
      select *, encounter as source_order,
        sha256(concat_ws('|', patient, encounter, code, date, category, description, 'U', value, patient, '0')) as obs_id
      from labs where patient in (select id from patients))
      select {uuid5_sql('EVT', "'SYNTHEA|' || obs_id")} as event_id, 'GLIMS_SIM' as source_system,
        'SYNTHEA' as origin_source, 'LAB_RESULT_CREATED' as event_type, {HMAC_SQL.format('patient')} as patient_id,
        {uuid5_sql('ORD', 'encounter')} as order_id, {uuid5_sql('SPC', "encounter || '|specimen'")} as specimen_id,
        trim(code) as test_code, trim(code) as loinc_code, trim(description) as test_name, trim(value) as value, 'U' as unit,
        cast(null as varchar) as reference_range, cast(null as varchar) as abnormal_flag, 'FINAL' as validation_status,
        date || 'T00:00:00' as result_datetime
      from kept""",
)
def extract_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extracts.normalized_csv(inputs.extract_observations(spark, sf_dir), inputs.extract_patients(spark, sf_dir))
    return extracts.lab_events(rows, inputs.SECRET)


# --- FHIR ------------------------------------------------------------------------------------

FHIR_CTE = """with labs as (
  select o_orderkey as k, *,
    case when o_orderkey % 13 > 0 then 'obs-' || o_orderkey end as source_observation_id,
    case when o_orderkey % 19 > 0 then cast(o_custkey as varchar) end as source_patient_id
  from orders where o_orderkey % 11 > 0 and o_orderpriority in ('1-URGENT', '2-HIGH', '5-LOW')),
shaped as (
  select source_patient_id, source_observation_id,
    case when k % 2 = 1 then cast(k as varchar) end as source_order_id,
    case when k % 3 = 0 then 'SP-' || k end as source_specimen_id,
    case when k % 2 = 0 then '718-7' else 'L-' || o_orderpriority end as test_code,
    case when k % 2 = 0 then '718-7' end as loinc_code,
    case when k % 2 = 0 then 'Hemoglobin' when k % 3 = 0 then 'Test ' || o_orderpriority else 'L-' || o_orderpriority end as test_name,
    case k % 4 when 0 then cast(o_totalprice as varchar) when 3 then case when k % 7 > 0 then 'seen' end else 'text ' || k end as value,
    case when k % 8 = 4 then 'g' when k % 4 = 0 then 'mg/dL' end as unit,
    case k % 3 when 0 then '1-2' when 1 then '1.5 - 3 g' end as reference_range,
    case when k % 5 = 0 then 'H' end as abnormal_flag,
    case o_orderstatus when 'O' then 'PRELIMINARY' else 'FINAL' end as validation_status,
    case when k % 17 > 0 then substr(cast(o_orderdate as varchar),1,10) when k % 2 = 0 then '2024-02-03T04:05:06Z' end as result_datetime
  from labs),
checked as (
  select *, case when source_patient_id is null then 'source_patient_id' when source_observation_id is null then 'source_observation_id'
    when value is null then 'value' when result_datetime is null then 'result_datetime' end as missing from shaped)"""
TIME_TEXT = "case when length(result_datetime) = 10 then result_datetime || 'T00:00:00' else result_datetime end"
NORMALIZED = ", ".join(NORMALIZED_COLUMNS)


@register("fhir_lab_predicate", FHIR_CTE + " select source_observation_id, source_patient_id from labs")
def fhir_lab_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    labs = inputs.fhir_resources(spark, sf_dir).filter(extracts.lab_resource_predicate())
    return labs.selectExpr("nullif(trim(id), '') as source_observation_id", "split_part(subject.reference, '/', 2) as source_patient_id")


@register("fhir_normalized", FHIR_CTE + f" select * exclude (missing) replace ({TIME_TEXT} as result_datetime) from checked where missing is null")
def fhir_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracts.normalized_fhir(inputs.fhir_resources(spark, sf_dir))


@register(
    "fhir_events",
    FHIR_CTE
    + f""", keyed as (
      select *, 'SYNTHEA|' || source_observation_id as observation,
        coalesce(source_order_id, 'SYNTHEA|' || source_observation_id || '|order') as order_key
      from checked where missing is null)
    select {uuid5_sql('EVT', 'observation')} as event_id, 'GLIMS_SIM' as source_system, 'SYNTHEA' as origin_source,
      'LAB_RESULT_CREATED' as event_type, {HMAC_SQL.format('source_patient_id')} as patient_id,
      {uuid5_sql('ORD', 'order_key')} as order_id,
      {uuid5_sql('SPC', "coalesce(source_specimen_id, order_key || '|specimen')")} as specimen_id, test_code, loinc_code,
      test_name, value, unit, reference_range, abnormal_flag, validation_status, {TIME_TEXT} as result_datetime
    from keyed""",
)
def fhir_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracts.lab_events(extracts.normalized_fhir(inputs.fhir_resources(spark, sf_dir)), inputs.SECRET)


@register(
    "incomplete_rows",
    FHIR_CTE
    + OBS_CTE.replace("with obs as", ", obs as").replace("labs as", "csv_labs as")
    + f""" select {NORMALIZED}, missing from checked where missing is not null
      union all
      select patient, sha256(concat_ws('|', patient, encounter, code, 'no date', category, description, 'U', value, patient, '0')),
        encounter, null, trim(code), trim(code), description, value, 'U', null, null, 'FINAL', 'no date', 'result_datetime'
      from csv_labs where encounter like '%3' and patient in (select id from patients)""",
)
def incomplete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reject feed of both readers."""
    fhir = extracts.shaped_fhir(inputs.fhir_resources(spark, sf_dir))
    csv = extracts.shaped_csv(inputs.undated_observations(spark, sf_dir), inputs.extract_patients(spark, sf_dir))
    return extracts.incomplete_rows(fhir).unionByName(extracts.incomplete_rows(csv))
