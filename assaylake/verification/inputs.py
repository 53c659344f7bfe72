"""Lab inputs that Spark derives from the given parquet tables, each from whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import fixed_values as fv
from ..checkpoints import stored
from ..operators import bus, case_contents, events, gold, silver
from ..schemas import CASE_KEYS, EVENT_COLUMNS
from ..sources import ranges

SECRET = "test-secret-0123456789-0123456789-abc"  # test only
DAY_ONE = "2026-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lab_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as lab-result events with dirty types, keys, ids, times and values.

    Every event becomes a lab event; those whose id ends in 7 arrive twice.
    """
    base = table(spark, sf_dir, "events").selectExpr(
        "*",
        "substr(cast(ts as string), 1, 10) as d",
        "concat(replace(substr(cast(ts as string), 1, 19), ' ', 'T'), 'Z') as t",
        """case event_type when 'click' then '2345-7' when 'view' then '718-7'
           when 'error' then '6690-2' when 'signup' then '777-3' else '99999-9' end as code""",
        "case when event_id % 10 = 7 then array(0, 1) else array(0) end as copies",
    )
    return base.select("*", F.explode("copies").alias("copy")).selectExpr(
        "concat('EVT-', cast(event_id as string)) as event_id",
        """case when event_id % 20 = 1 then ' lab_result_updated ' when event_id % 20 = 18 then 'ORDER_CREATED'
           when event_id % 20 = 19 then 'LAB_RESULT_VALIDATED' else 'LAB_RESULT_CREATED' end as event_type""",
        "case when event_id % 97 = 0 then '  ' else concat('PAT-', cast(user_id as string)) end as patient_id",
        "concat('ORD-', cast(user_id as string), '-', d) as order_id",
        "concat('SPC-', cast(user_id as string), '-', d, '-', cast(event_id % 2 as string)) as specimen_id",
        "code as test_code",
        "case when event_type = 'signup' then cast(null as string) else code end as loinc_code",
        "event_type as test_name",
        """case when event_id % 10 = 7 then 'yellow'
           when event_id % 10 = 3 then concat('> ', cast(value as string), ' mg/dL')
           else cast(value as string) end as value""",
        "'mg/dL' as unit",
        "cast(null as string) as reference_range",
        "cast(null as string) as abnormal_flag",
        "case when event_id % 4 = 0 then ' preliminary' else 'final' end as validation_status",
        "case when event_id % 101 = 0 then 'bad' else t end as result_datetime",
        """case when event_id % 3 = 0 then cast(null as string) when event_id % 3 = 1 then ''
           else concat('RES-', cast(user_id as string), '-', code, '-', d) end as result_id""",
        "case when event_id % 5 = 0 then cast(null as string) else t end as modified_at",
        "event_id * 2 + copy as seq",
    )


def _silver_of(lab: DataFrame) -> DataFrame:
    at = F.lit(DAY_ONE).cast("timestamp")
    return silver.silver_lab_results(lab, ranges.range_table(lab.sparkSession), cleaned_at=at)


def lab_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _silver_of(lab_events(spark, sf_dir))


def lab_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.gold_report_context(lab_silver(spark, sf_dir), generated_at=F.lit(DAY_ONE).cast("timestamp"))


def contexts_of(silver_rows: DataFrame) -> DataFrame:
    """Contexts without result lists."""
    return case_contents.case_contexts(silver_rows, generated_at=F.lit(DAY_ONE).cast("timestamp"))


def stored_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver as a stored layer, for queries that read it more than once."""
    return stored(lab_silver(spark, sf_dir))


def busy_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lab results in cases of twenty users each, a third of them all in one case; some have a reference range."""
    lab = lab_events(spark, sf_dir)
    user = F.split_part(F.col("order_id"), F.lit("-"), F.lit(2)).cast("long")
    group = F.when(user % 3 == 0, "HOT").otherwise(F.floor(user / 20).cast("string"))
    number = F.split_part(F.col("event_id"), F.lit("-"), F.lit(2)).cast("long")
    merged = lab.withColumns(
        {
            "patient_id": F.when(F.trim("patient_id") == "", F.col("patient_id")).otherwise(F.concat(F.lit("PAT-"), group)),
            "order_id": F.concat(F.lit("ORD-"), group),
            "specimen_id": F.lit("SPC-1"),
            "reference_range": F.when(number % 3 == 0, "1 - 2"),
        }
    )
    return stored(_silver_of(merged))


# --- Event log -------------------------------------------------------------------------------


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lab events as a valid, typed log."""
    sourced = lab_events(spark, sf_dir).withColumns(
        {"source_system": F.lit(fv.SOURCE_SYSTEM), "origin_source": F.lit(fv.ORIGIN_SOURCE)}
    )
    return events.event_log(sourced)


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lab events with all 18 text columns and their arrival number."""
    return lab_events(spark, sf_dir).withColumns(
        {"source_system": F.lit(fv.SOURCE_SYSTEM), "origin_source": F.lit(fv.ORIGIN_SOURCE)}
    ).select(*EVENT_COLUMNS, "seq")


def kafka_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as topic messages; those with text values are broken JSON."""
    sent = bus.envelopes(raw_events(spark, sf_dir), carry=["event_id", "seq"])
    return sent.select(
        F.when(F.col("event_id").endswith("7"), F.concat(F.lit("no json "), F.col("event_id")))
        .otherwise(F.col("value"))
        .alias("value"),
        "topic",
        F.lit(0).alias("partition"),
        F.col("seq").alias("offset"),
    )


# --- Clinical extract ------------------------------------------------------------------------


def extract_patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("Id"))


def extract_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as observations: pending orders come from patients the extract does not list."""
    return table(spark, sf_dir, "orders").selectExpr(
        "case when o_orderstatus = 'P' then concat('visitor-', cast(o_custkey as string))"
        " else cast(o_custkey as string) end as PATIENT",
        "cast(o_orderkey as string) as ENCOUNTER",
        "case when o_orderpriority = '4-NOT SPECIFIED' then ' ' else o_orderpriority end as CODE",
        "concat('Test ', o_orderpriority) as DESCRIPTION",
        "cast(o_totalprice as string) as VALUE",
        "'U' as UNITS",
        "substr(cast(o_orderdate as string), 1, 10) as DATE",
        "case o_orderpriority when '1-URGENT' then 'Laboratory results' when '2-HIGH' then ' LAB '"
        " when '3-MEDIUM' then 'labour' else 'laboratory' end as CATEGORY",
    )


def fhir_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as FHIR resources: several codings, all kinds of values and ranges, and missing parts."""
    coding = "named_struct('system', {}, 'code', {}, 'display', {})"
    local = coding.format("'http://local'", "concat('L-', o_orderpriority)", "cast(null as string)")
    loinc = coding.format("'http://loinc.org'", "'718-7'", "' Hemoglobin'")
    categories = "transform({}, c -> named_struct('coding', array(named_struct('code', c))))"
    quantity = "named_struct('value', {}, 'unit', {}, 'code', {})"
    nothing = "cast(null as string)"
    return table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey")).selectExpr(
        "case when k % 11 = 0 then 'DiagnosticReport' else 'Observation' end as resourceType",
        "case when k % 13 = 0 then '  ' else concat('obs-', k) end as id",
        "case o_orderstatus when 'F' then 'final' when 'O' then 'preliminary' end as status",
        "case when k % 17 = 0 then '' else substr(cast(o_orderdate as string), 1, 10) end as effectiveDateTime",
        "case when k % 17 = 0 and k % 2 = 0 then '2024-02-03T04:05:06Z' end as issued",
        f"""case o_orderpriority when '1-URGENT' then {categories.format("array('laboratory')")}
            when '2-HIGH' then {categories.format("array('vital-signs', 'lab')")}
            when '3-MEDIUM' then {categories.format("array('labour')")}
            when '5-LOW' then array(named_struct('coding', array(named_struct('code', 'laboratory')))) end as category""",
        f"""named_struct('text', case when k % 3 = 0 then concat('Test ', o_orderpriority) else '' end, 'coding',
            case when k % 2 = 0 then array({local}, {loinc}) else array({local}) end) as code""",
        "named_struct('reference', case when k % 19 > 0 then concat('Patient/', o_custkey) end) as subject",
        "case when k % 2 = 1 then array(named_struct('reference', concat('ServiceRequest/', k, '/'))) end as basedOn",
        "case when k % 3 = 0 then named_struct('reference', concat('SP-', k)) end as specimen",
        f"""case k % 4 when 0 then {quantity.format("cast(o_totalprice as string)", "case when k % 8 = 4 then '' else 'mg/dL' end", "'g'")}
            when 1 then {quantity.format(nothing, nothing, nothing)} end as valueQuantity""",
        "case when k % 4 in (1, 2) then concat('text ', k) end as valueString",
        "case when k % 4 = 3 then named_struct('text', case when k % 7 > 0 then 'seen' end) end as valueCodeableConcept",
        f"""case k % 3 when 0 then array(named_struct('text', '1-2', 'low', cast(null as struct<value: string, unit: string>),
                'high', cast(null as struct<value: string, unit: string>)))
            when 1 then array(named_struct('text', {nothing}, 'low', named_struct('value', '1.50', 'unit', 'g'),
                'high', named_struct('value', '3', 'unit', {nothing}))) end as referenceRange""",
        "case when k % 5 = 0 then array(named_struct('coding', array(named_struct('code', ''), named_struct('code', 'H')))) end"
        " as interpretation",
    )


def undated_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observations, some with a date that cannot be read."""
    odd = F.when(F.col("ENCOUNTER").endswith("3"), "no date").otherwise(F.col("DATE"))
    return extract_observations(spark, sf_dir).withColumn("DATE", odd)


# --- Report tables, from every case ----------------------------------------------------------


def with_scenario(cases: DataFrame) -> DataFrame:
    """Give every case one of 16 life stories, by the first digit of its content hash."""
    return cases.withColumns(
        {
            "n": F.instr(F.lit("0123456789abcdef"), F.substring("context_hash", 1, 1)) - 1,
            "report_id": F.concat(F.lit("RPT-"), F.substring("context_hash", 1, 16)),
        }
    )


def _at(day: int, hour, minute) -> Column:
    return F.make_timestamp(F.lit(2026), F.lit(1), F.lit(day), _col(hour), _col(minute), F.lit(0))


def _col(value) -> Column:
    return F.lit(value) if isinstance(value, int) else value


def reports(cases: DataFrame) -> DataFrame:
    """Stories 12 to 15 have no report yet."""
    return with_scenario(cases).filter("n < 12").select("report_id", *CASE_KEYS, _at(2, 0, F.col("n")).alias("created_at"))


def versions(cases: DataFrame) -> DataFrame:
    """Story 11 has a report without version; 0, 3, 6, 9 have two; 1 and 4 are stale."""
    story = with_scenario(cases).filter("n < 11").withColumn("top", F.when(F.col("n") % 3 == 0, 2).otherwise(1))
    rows = story.withColumn("version_number", F.explode(F.sequence(F.lit(1), F.col("top"))))
    return rows.select(
        F.concat(F.lit("RPV-"), F.substring("context_hash", 1, 16), F.lit("-"), F.col("version_number")).alias("report_version_id"),
        "report_id",
        "version_number",
        F.when(F.col("n").isin(1, 4) | (F.col("version_number") < F.col("top")), F.concat(F.lit("stale-"), "context_hash"))
        .otherwise(F.col("context_hash"))
        .alias("source_context_hash"),
        F.concat(F.lit("text of "), "report_id", F.lit(" v"), F.col("version_number")).alias("report_text"),
        F.when(F.col("n") % 2 == 0, fv.TEMPLATE_PROVIDER).otherwise(fv.REMOTE_PROVIDER + ":model-a").alias("model_name"),
        _at(2, F.col("version_number"), F.col("n")).alias("created_at"),
    )


def _story_rows(cases: DataFrame, rows: dict[int, list[tuple]], schema: str) -> DataFrame:
    """Rows listed per story number, for every case of that story."""
    spark = cases.sparkSession
    listed = spark.createDataFrame([(n, *r) for n, rs in rows.items() for r in rs], "n int, " + schema)
    return with_scenario(cases).select("n", "report_id", *CASE_KEYS, "context_hash").join(F.broadcast(listed), "n")


def status_changes(cases: DataFrame) -> DataFrame:
    rows = {n: [(1, 1, "AI_DRAFT")] for n in range(11)}
    for n in (2, 3, 8):
        rows[n].append((2, 2, "BIOLOGIST_VALIDATED"))
    rows[6] += [(3, 2, "BIOLOGIST_VALIDATED"), (3, 3, "REJECTED")]  # same time, later in sequence
    rows[5].append((3, 3, "REJECTED"))
    rows[7].append((4, 4, "OUTDATED"))
    return _story_rows(cases, rows, "hour int, seq long, status string").select(
        "report_id", _at(2, F.col("hour"), F.col("n")).alias("at"), "seq", "status"
    )


def actions(cases: DataFrame) -> DataFrame:
    rows = {
        2: [(2, "VALIDATED", None)],
        3: [(2, "VALIDATED", "first"), (3, "VALIDATED", "second")],
        5: [(3, "REJECTED", "no")],
        6: [(2, "VALIDATED", "fine"), (3, "REJECTED", "again")],
        8: [(2, "VALIDATED", 'it is "ok" \\ yes')],
    }
    return _story_rows(cases, rows, "hour int, action string, comment string").select(
        "report_id", "patient_id", "order_id", "action", "comment", _at(2, F.col("hour"), F.col("n")).alias("created_at")
    )


def exports(cases: DataFrame) -> DataFrame:
    rows = {
        2: [("a", 5, "FINAL_PDF", "GENERATED")],
        3: [("a", 5, "FINAL_PDF", "GENERATED"), ("b", 6, "FINAL_PDF", "GENERATED")],
        8: [("a", 5, "FINAL_PDF", "FAILED")],
        9: [("a", 5, "DRAFT_PDF", "GENERATED")],
        5: [("a", 5, "FINAL_PDF", "GENERATED")],  # rejected
        11: [("a", 5, "DRAFT_PDF", "GENERATED")],  # no version
        12: [("a", 5, "FINAL_PDF", "GENERATED")],  # no report
    }
    return _story_rows(cases, rows, "part string, hour int, export_type string, export_status string").select(
        F.concat(F.lit("EXP-"), F.substring("context_hash", 1, 16), F.lit("-"), "part").alias("export_id"),
        "report_id",
        "patient_id",
        "order_id",
        "export_type",
        "export_status",
        _at(2, F.col("hour"), F.col("n")).alias("generated_at"),
    )


def export_attempts(cases: DataFrame) -> DataFrame:
    return exports(cases).select(
        "report_id",
        "patient_id",
        "order_id",
        "export_type",
        "generated_at",
        F.lit("local-biologist").alias("generated_by"),
        F.when(F.col("export_status") == "GENERATED", F.length("report_id") * 100).alias("file_size_bytes"),
    )


def responses(cases: DataFrame) -> DataFrame:
    n = F.col("n")
    return with_scenario(cases).select(
        "report_id",
        F.when(n == 0, "other").otherwise(fv.REMOTE_PROVIDER).alias("provider"),
        (n != 4).alias("is_real_llm"),
        F.when(n != 8, "model-a").alias("model_name"),
        F.when(n == 10, "").otherwise(F.concat(F.lit("text of "), "report_id")).alias("report_text"),
    )


def conversations(spark: SparkSession, sf_dir: str, cases: DataFrame) -> DataFrame:
    """Each conversation belongs to the first report of the patient with its number, or to the first of all."""
    known = reports(cases)
    first = known.groupBy("patient_id").agg(F.min("report_id").alias("own_report"))
    talks = table(spark, sf_dir, "conversations").withColumn(
        "patient_id", F.concat(F.lit("PAT-"), F.col("conv_id").cast("string"))
    )
    any_report = known.agg(F.min("report_id")).scalar()
    return talks.join(first, "patient_id", "left").withColumn("report_id", F.coalesce("own_report", any_report))


def chat_messages(spark: SparkSession, sf_dir: str, cases: DataFrame) -> DataFrame:
    return conversations(spark, sf_dir, cases).select(
        "report_id",
        "role",
        F.col("text").alias("message"),
        F.col("turn").alias("message_seq"),
        _at(3, 0, F.col("turn").cast("int")).alias("created_at"),
    )


def questions(spark: SparkSession, sf_dir: str, cases: DataFrame) -> DataFrame:
    """The user turns, as questions to the report."""
    return (
        conversations(spark, sf_dir, cases)
        .filter("role = 'user'")
        .select(
            "report_id",
            F.col("text").alias("question"),
            F.col("turn").alias("message_seq"),
            _at(3, 0, F.col("turn").cast("int")).alias("created_at"),
        )
    )


def sessions(spark: SparkSession, sf_dir: str, cases: DataFrame) -> DataFrame:
    asked = conversations(spark, sf_dir, cases).select("report_id").distinct()
    return asked.withColumn("chat_session_id", F.concat(F.lit("CHS-"), "report_id"))
