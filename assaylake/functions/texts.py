"""Prompt, draft and answer texts built from a case context with array functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed_values as fv
from .values import bind, float_text, iso_text


def _clean(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def _shown(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit("None"))


def _or(col: Column, default: str) -> Column:
    return F.coalesce(F.nullif(col, F.lit("")), F.lit(default))


def time_text(ts: Column) -> Column:
    return iso_text(ts.cast("timestamp"))


def prompt_line(item: Column) -> Column:
    number = item["value_numeric"]
    value = F.array_join(
        F.filter(
            F.array(
                _clean(item["value_raw"]),
                F.coalesce(F.concat(F.lit("numeric="), float_text(number)), F.lit("")),
                F.when(F.length(item["value_text"]) > 0, F.concat(F.lit("text="), item["value_text"])).otherwise(""),
            ),
            lambda part: part != "",
        ),
        "; ",
    )
    return F.concat(
        F.lit("- "),
        _clean(item["test_name"]),
        F.lit(" | loinc="),
        _clean(item["loinc_code"]),
        F.lit(" | value="),
        value,
        F.lit(" | unit="),
        _clean(item["unit"]),
        F.lit(" | reference_range="),
        _clean(item["reference_range"]),
        F.lit(" | flag="),
        _clean(item["abnormal_flag"]),
        F.lit(" | status="),
        _clean(item["validation_status"]),
        F.lit(" | datetime="),
        F.coalesce(time_text(item["result_datetime"]), F.lit("")),
    )


PROMPT_HEADERS = [
    "patient_id",
    "order_id",
    "specimen_id",
    "results_count",
    "abnormal_results_count",
    "normal_results_count",
    "unknown_flag_results_count",
    "validation_status_summary",
    "context_hash",
]


def context_text(max_results: int = fv.PROMPT_RESULT_LINES, lines: Column | None = None) -> Column:
    """A case as compact prompt text: nine header lines, then one line per result.

    Result lines come from the nested ``results``, or are given as one text (null: none) for a case
    without them.
    """
    headers = [*[F.concat(F.lit(h + ": "), _clean(F.col(h))) for h in PROMPT_HEADERS], F.lit("results:")]
    more = (F.size("results") if lines is None else F.col("results_count")) - max_results
    omitted = F.when(more > 0, F.format_string(fv.PROMPT_MORE_RESULTS, more))
    if lines is not None:
        return F.array_join(F.array(*headers, lines, omitted), "\n")
    shown = F.transform(F.slice(F.col("results"), 1, max_results), prompt_line)
    return F.array_join(F.concat(F.array(*headers), shown, F.array(omitted)), "\n")


def report_prompt(context: Column | None = None) -> Column:
    """The prompt for a report; ``context`` is the text of the case where it is built already."""
    return F.concat(F.lit(fv.REPORT_INSTRUCTIONS + "\n\nGold context:\n"), context_text() if context is None else context)


def chat_prompt(report_text: Column, question: Column, context: Column | None = None) -> Column:
    return F.concat(
        F.lit(fv.CHAT_INSTRUCTIONS + "\n\nGenerated report:\n"),
        report_text,
        F.lit("\n\nGold context:\n"),
        context_text() if context is None else context,
        F.lit("\n\nQuestion:\n"),
        question,
    )


def with_flag(*flags: str) -> Column:
    return F.filter("results", lambda r: r["abnormal_flag"].isin(*flags))


def flag_split() -> dict[str, Column]:
    """How many results of the list carry each kind of flag."""
    return {
        "abnormal_count": F.size(with_flag(fv.FLAG_HIGH, fv.FLAG_LOW)),
        "normal_count": F.size(with_flag(fv.FLAG_NORMAL)),
        "unknown_count": F.size(with_flag(fv.FLAG_UNKNOWN)),
    }


def draft_line(item: Column) -> Column:
    return F.trim(
        F.concat(
            F.lit("- "),
            _or(item["test_name"], "Unknown test"),
            F.lit(" ("),
            F.coalesce(F.nullif(item["loinc_code"], F.lit("")), F.nullif(item["test_code"], F.lit("")), F.lit("unknown")),
            F.lit("): "),
            _shown(item["value_raw"]),
            F.lit(" "),
            _or(item["unit"], ""),
            F.lit(" | flag="),
            _or(item["abnormal_flag"], "UNKNOWN"),
            F.lit(" | status="),
            _or(item["validation_status"], "UNKNOWN"),
        )
    )


def _section(shown: Column, count: Column, limit: int) -> Column:
    more = count - limit
    rest = F.when(more > 0, F.concat(F.lit("\n"), F.format_string(fv.DRAFT_MORE_RESULTS, more))).otherwise("")
    return F.when(count == 0, fv.DRAFT_NO_RESULTS).otherwise(F.concat(shown, rest))


def _nested_section(chosen: Column, limit: int) -> Column:
    def section(results: Column) -> Column:
        shown = F.array_join(F.transform(F.slice(results, 1, limit), draft_line), "\n")
        return _section(shown, F.size(results), limit)

    return bind(chosen, section)


def draft_report(abnormal_lines: Column | None = None, normal_lines: Column | None = None) -> Column:
    """The template draft of a case, from its nested ``results`` or from the first lines of each kind as texts."""
    if abnormal_lines is None or normal_lines is None:
        abnormal = _nested_section(with_flag(fv.FLAG_HIGH, fv.FLAG_LOW), fv.DRAFT_ABNORMAL_LINES)
        normal = _nested_section(with_flag(fv.FLAG_NORMAL), fv.DRAFT_NORMAL_LINES)
    else:
        abnormal = _section(abnormal_lines, F.col("abnormal_results_count"), fv.DRAFT_ABNORMAL_LINES)
        normal = _section(normal_lines, F.col("normal_results_count"), fv.DRAFT_NORMAL_LINES)
    return F.format_string(
        fv.DRAFT_TEXT,
        _shown(F.col("patient_id")),
        _shown(F.col("order_id")),
        _shown(F.col("specimen_id")),
        _shown(time_text(F.col("first_result_datetime"))),
        _shown(time_text(F.col("last_result_datetime"))),
        F.col("results_count"),
        F.col("abnormal_results_count"),
        F.col("normal_results_count"),
        F.col("unknown_flag_results_count"),
        abnormal,
        normal,
    )


def chat_answer(question: Column) -> Column:
    """The template answer of a case to a question."""
    counts = ("results_count", "abnormal_results_count", "normal_results_count", "unknown_flag_results_count")
    return F.format_string(fv.ANSWER_TEXT, question, *[F.col(c) for c in counts])


def storage_model_name(provider: Column, model_name: Column) -> Column:
    """Model label to store: remote models carry their provider in front."""
    return F.when(
        provider == fv.REMOTE_PROVIDER, F.concat(F.lit(fv.REMOTE_PROVIDER + ":"), model_name)
    ).otherwise(model_name)


def provider_of(stored_model_name: Column) -> Column:
    return (
        F.when(stored_model_name.startswith(fv.REMOTE_PROVIDER + ":"), fv.REMOTE_PROVIDER)
        .when(stored_model_name == fv.TEMPLATE_PROVIDER, fv.TEMPLATE_PROVIDER)
        .otherwise("unknown")
    )


def safe_filename(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9_.-]+", "_")


def export_filename(export_type: Column, report_id: Column, version: Column) -> Column:
    return F.concat(
        safe_filename(F.lower(export_type)), F.lit("_"), safe_filename(report_id), F.lit("_v"), version.cast("string"), F.lit(".pdf")
    )


def json_text(value: Column) -> Column:
    """A string as a JSON value, null as ``null``."""
    listed = F.to_json(F.array(value.cast("string")))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def json_object(**fields: Column) -> Column:
    """A JSON object with its names in text order; values are JSON texts already."""
    parts = [F.concat(F.lit(f'"{name}": '), fields[name]) for name in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
