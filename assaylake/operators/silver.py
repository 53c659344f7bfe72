"""Typed events to the cleaned latest revision of every result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed_values as fv
from ..functions import ids, values
from ..schemas import CASE_KEYS, EVENT_COLUMNS


def with_event_columns(events: DataFrame) -> DataFrame:
    """Add the event columns the input lacks, as null text."""
    missing = {c: F.lit(None).cast("string") for c in EVENT_COLUMNS if c not in events.columns}
    return events.withColumns(missing) if missing else events


def typed_events(events: DataFrame) -> DataFrame:
    """Trim and upper-case the codes, parse the times, default ``modified_at``."""
    result_time = values.parse_time(F.col("result_datetime"))
    return with_event_columns(events).withColumns(
        {
            "event_type": values.upper_trim(F.col("event_type")),
            "validation_status": values.upper_trim(F.col("validation_status")),
            "result_datetime": result_time,
            "modified_at": F.coalesce(values.parse_time(F.col("modified_at")), result_time),
        }
    )


def accepted_types(include_validated: bool = False) -> list[str]:
    return [*fv.SILVER_EVENT_TYPES, *([fv.EVENT_VALIDATED] if include_validated else [])]


def reject_reason(types: Sequence[str]) -> Column:
    """First rule an event fails (its column name), or null for an accepted event."""
    wrong_type = F.col("event_type").isNull() | ~F.col("event_type").isin(*types)
    blank_keys = [(values.blank(F.col(key)), key) for key in CASE_KEYS]
    return values.first_match([(wrong_type, "event_type"), *blank_keys], None)


def silver_rejects(events: DataFrame, *, include_validated: bool = False) -> DataFrame:
    """Events Silver leaves out because of their type or a blank key, with the reason."""
    return (
        typed_events(events)
        .withColumn("reason", reject_reason(accepted_types(include_validated)))
        .filter(F.col("reason").isNotNull())
    )


def accepted_events(events: DataFrame, *, include_validated: bool = False) -> DataFrame:
    """Typed events of an accepted type with all case keys, ready for the two reductions."""
    accepted = F.col("event_type").isin(*accepted_types(include_validated))
    for key in CASE_KEYS:
        # The null test alone reaches the file scan.
        accepted = accepted & F.col(key).isNotNull() & (F.length(F.trim(F.col(key))) > 0)
    return with_copy_order(typed_events(events).filter(accepted))


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rows: int) -> DataFrame:
    """The first few rows per key.

    Spark turns ``row_number <= rows`` into a group limit before the shuffle, so each map task
    sends at most that many rows per key: a key with very many rows stays cheap.
    """
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rank") <= rows).drop("_rank")


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return first_rows(df, keys, order, 1)


COPY_ORDER = "_copy_order"


def with_copy_order(events: DataFrame) -> DataFrame:
    """Add a hash over all event columns.

    It fixes the choice among unequal copies that tie on everything else, and lets narrow queries
    carry eight bytes through the shuffles instead of every column.
    """
    return events.withColumn(COPY_ORDER, F.xxhash64(*[F.col(c) for c in EVENT_COLUMNS]))


def dedup_events(accepted: DataFrame, *, keep_null_event_ids: bool = False) -> DataFrame:
    """One row per event id: newest ``modified_at``, then lowest ``value``, then the copy order.

    Null event ids form one group and collapse to one row, unless they are to be kept.
    """
    order = [F.col("modified_at").desc_nulls_last(), F.col("value").asc_nulls_last(), F.col(COPY_ORDER)]
    if not keep_null_event_ids:
        return first_row(accepted, ["event_id"], order)
    unique = first_row(accepted.filter(F.col("event_id").isNotNull()), ["event_id"], order)
    return unique.unionByName(accepted.filter(F.col("event_id").isNull()))


def latest_results(unique_events: DataFrame) -> DataFrame:
    """The newest revision per result id; equal times go to the highest event id."""
    keyed = unique_events.withColumn("result_id", ids.silver_result_id(F.col("result_id"), F.col("result_datetime")))
    order = [F.col("modified_at").desc_nulls_last(), F.col("event_id").desc_nulls_last(), F.col(COPY_ORDER)]
    return first_row(keyed, ["result_id"], order).drop(COPY_ORDER)


def newest_results(rows: DataFrame) -> DataFrame:
    """The newest of several Silver rows per result id, by the rule of :func:`latest_results`."""
    order = [F.col("modified_at").desc_nulls_last(), F.col("event_id").desc_nulls_last(), F.col("value").asc_nulls_last()]
    return first_row(rows, ["result_id"], order)


def with_values(rows: DataFrame) -> DataFrame:
    """``value_raw``, ``value_numeric`` and, where there is no number, ``value_text``."""
    raw = F.col("value").cast("string")
    number = values.parse_numeric(raw)
    return rows.withColumns(
        {"value_raw": raw, "value_numeric": number, "value_text": F.when(number.isNull(), raw)}
    )


def with_flags(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Set ``abnormal_flag`` from the range of the LOINC code, or of the test code without one.

    An empty LOINC code does not fall back. A table from
    :func:`assaylake.sources.ranges.range_table` has a known size, so Spark broadcasts it by itself
    as long as it is small.
    """
    bounds = ranges.select(F.col("code").alias("_code"), F.col("low").alias("_low"), F.col("high").alias("_high"))
    code = F.coalesce(F.col("loinc_code"), F.col("test_code"))
    joined = rows.join(bounds, code == F.col("_code"), "left")
    flag = values.range_flag(F.col("value_numeric"), F.col("_code").isNotNull(), F.col("_low"), F.col("_high"))
    return joined.withColumn("abnormal_flag", flag).drop("_code", "_low", "_high")


def silver_lab_results(
    events: DataFrame,
    ranges: DataFrame,
    *,
    include_validated: bool = False,
    keep_null_event_ids: bool = False,
    cleaned_at: Column | None = None,
) -> DataFrame:
    """Cleaned latest result per ``result_id``.

    Values and flags are added after both reductions: they depend on one row only, and the
    shuffles then carry just the event columns.
    """
    accepted = accepted_events(events, include_validated=include_validated)
    latest = latest_results(dedup_events(accepted, keep_null_event_ids=keep_null_event_ids))
    return with_flags(with_values(latest), ranges).withColumns(
        {"is_latest": F.lit(True), "cleaned_at": F.current_timestamp() if cleaned_at is None else cleaned_at}
    )
