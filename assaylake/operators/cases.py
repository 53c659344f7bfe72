"""Case list, lookup, search and card fields over the Gold contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from ..functions import values
from ..schemas import CASE_KEYS


def case_list(context: DataFrame) -> DataFrame:
    return context.orderBy(*CASE_KEYS)


def _found(context: DataFrame) -> list[Column]:
    return [F.col("specimen_id"), F.col("context_hash"), F.col("status")]


def case_lookup(context: DataFrame, requests: DataFrame) -> DataFrame:
    """Look up a set of (patient, order, optional specimen) requests.

    Gives the request with ``found_specimen_id``, ``context_hash``, ``status`` and ``error``
    (no such case, or several specimens and none named). Cases are counted per order first, so an
    order with very many specimens adds one row, not pairs.
    """
    wanted = requests.select(*CASE_KEYS)
    named = wanted.filter(F.col("specimen_id").isNotNull())
    by_specimen = context.select(
        *CASE_KEYS, F.col("specimen_id").alias("found_specimen_id"), "context_hash", "status"
    )
    exact = named.join(by_specimen, CASE_KEYS, "left").withColumn("_matches", F.when(F.col("context_hash").isNotNull(), 1).otherwise(0))
    by_order = context.groupBy("patient_id", "order_id").agg(
        F.count("*").alias("_matches"), F.min(F.struct(*_found(context))).alias("_one")
    )
    open_requests = wanted.filter(F.col("specimen_id").isNull())
    single = open_requests.join(by_order, ["patient_id", "order_id"], "left").select(
        *CASE_KEYS,
        *[F.when(F.col("_matches") == 1, F.col("_one")[n]).alias(a) for n, a in
          (("specimen_id", "found_specimen_id"), ("context_hash", "context_hash"), ("status", "status"))],
        F.coalesce("_matches", F.lit(0)).alias("_matches"),
    )
    missing = F.format_string(
        fv.MSG_CASE_MISSING, *[F.coalesce(F.col(k), F.lit("None")) for k in CASE_KEYS]
    )
    error = F.when(F.col("_matches") == 0, missing).when(F.col("_matches") > 1, fv.MSG_CASE_AMBIGUOUS)
    return exact.unionByName(single).withColumn("error", error).drop("_matches")


def case_search(context: DataFrame, term: str) -> DataFrame:
    """Cases whose keys and status, joined by spaces, contain the term; a blank term keeps all."""
    needle = term.strip().lower()
    if not needle:
        return context
    parts = [F.coalesce(F.col(c), F.lit("")) for c in (*CASE_KEYS, "status")]
    return context.filter(F.lower(F.concat_ws(" ", *parts)).contains(needle))


def next_ready_case(context: DataFrame) -> DataFrame:
    """The first case that is ready, else the first case."""
    return context.orderBy(F.col("status") != fv.READY_FOR_AI, *CASE_KEYS).limit(1)


def shortened(text: Column, head: int, tail: int) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", "N/A").otherwise(
        F.concat(F.substring(text, 1, head), F.lit("..."), F.right(text, F.lit(tail)))
    )


def status_label(status: Column) -> Column:
    code = F.coalesce(F.nullif(status, F.lit("")), F.lit("UNKNOWN"))
    return values.first_match([(code == key, text) for key, text in fv.STATUS_LABELS.items()], code)


def flag_class(flag: Column) -> Column:
    return (
        F.when(flag.isin(fv.FLAG_HIGH, fv.FLAG_LOW), "flag-abnormal")
        .when(flag == fv.FLAG_NORMAL, "flag-normal")
        .otherwise("flag-unknown")
    )


def case_cards(context: DataFrame) -> DataFrame:
    """Card fields of every case: label, short hashes and counts."""
    return context.select(
        *CASE_KEYS,
        status_label(F.col("status")).alias("status_label"),
        F.format_string("%s result(s)", F.col("results_count")).alias("results_text"),
        F.format_string("%s abnormal", F.col("abnormal_results_count")).alias("abnormal_text"),
        F.format_string("%s normal", F.col("normal_results_count")).alias("normal_text"),
        F.format_string("%s unknown", F.col("unknown_flag_results_count")).alias("unknown_text"),
        shortened(F.col("context_hash"), 10, 6).alias("short_hash"),
        shortened(F.col("context_hash"), 16, 8).alias("detail_hash"),
    )


def results_table(rows: DataFrame) -> DataFrame:
    """Display fields of flat result rows, with the defaults shown for missing parts."""

    def shown(name: str, default: str) -> Column:
        return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(default))

    return rows.select(
        *CASE_KEYS,
        "result_id",
        shown("test_name", "Unknown test").alias("test_name"),
        F.coalesce(F.nullif(F.col("loinc_code"), F.lit("")), F.nullif(F.col("test_code"), F.lit("")), F.lit("N/A")).alias("code"),
        F.coalesce(F.col("value_raw"), values.float_text(F.col("value_numeric")), F.col("value_text"), F.lit("")).alias("value"),
        shown("unit", "").alias("unit"),
        shown("reference_range", "N/A").alias("reference_range"),
        shown("abnormal_flag", "UNKNOWN").alias("flag"),
        flag_class(F.col("abnormal_flag")).alias("flag_class"),
        shown("validation_status", "UNKNOWN").alias("status"),
        F.coalesce(values.iso_text(F.col("result_datetime").cast("timestamp")), F.lit("")).alias("result_datetime"),
    )


def case_json(context: DataFrame) -> DataFrame:
    """Every case as one JSON text: ISO times, no NaN, nulls written."""

    def safe(col: Column, kind: str) -> Column:
        if kind == "timestamp":
            return values.iso_text(col)
        return F.when(~F.isnan(col), col) if kind in ("double", "float") else col

    fields = context.schema["results"].dataType.elementType.fields
    results = F.transform(
        "results", lambda r: F.struct(*[safe(r[f.name], f.dataType.typeName()).alias(f.name) for f in fields])
    )
    columns = [
        (results if f.name == "results" else safe(F.col(f.name), f.dataType.typeName())).alias(f.name)
        for f in context.schema.fields
    ]
    return context.select(*CASE_KEYS, F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("case_json"))
