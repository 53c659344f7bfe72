"""Read models over the event log, and the set-level changes appended to it."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from ..functions import ids, values
from ..schemas import CASE_KEYS, EVENT_COLUMNS, OPTIONAL_EVENT_COLUMNS, SchemaMismatch
from .silver import first_row
from .sizing import running_last

DEFAULTED_COLUMNS = ["result_id", "modified_at"]
PATCH_FIELDS = ["value", "unit", "reference_range", "abnormal_flag", "validation_status", "result_datetime"]


class UnknownKey(LookupError):
    """A requested patient or order has no event."""


def normalize_events(events: DataFrame, carry: Sequence[str] = ("seq",)) -> DataFrame:
    """The 18 event columns, strictly: unexpected columns are an error, two are defaulted.

    ``carry`` names arrival columns that ride along. ``result_id`` defaults to the id over the raw
    text and ``modified_at`` to ``result_datetime``; a blank id is kept.
    """
    carry = [c for c in carry if c in events.columns]
    extra = [c for c in events.columns if c not in EVENT_COLUMNS and c not in carry]
    needed = [c for c in EVENT_COLUMNS if c not in [*OPTIONAL_EVENT_COLUMNS, *DEFAULTED_COLUMNS]]
    missing = [c for c in needed if c not in events.columns]
    if extra or missing:
        raise SchemaMismatch(f"missing columns {missing}, unexpected columns {extra}")
    absent = [c for c in EVENT_COLUMNS if c not in events.columns]
    filled = events.withColumns({c: F.lit(None).cast("string") for c in absent}) if absent else events
    return filled.withColumns(
        {
            "result_id": F.coalesce(F.col("result_id"), ids.raw_result_id()),
            "modified_at": F.coalesce(F.col("modified_at"), F.col("result_datetime")),
        }
    ).select(*EVENT_COLUMNS, *carry)


def invalid_event_reason() -> Column:
    """First required field of a normalised event that is null, or a time that does not parse."""
    required = [c for c in EVENT_COLUMNS if c not in OPTIONAL_EVENT_COLUMNS]
    times = ("result_datetime", "modified_at")
    return values.first_match(
        [((values.parse_time(F.col(c)) if c in times else F.col(c)).isNull(), c) for c in required], None
    )


def event_log(events: DataFrame, carry: Sequence[str] = ("seq",)) -> DataFrame:
    """Valid events with typed times: the frame every read model takes."""
    normal = normalize_events(events, carry).filter(invalid_event_reason().isNull())
    return normal.withColumns(
        {c: values.parse_time(F.col(c)) for c in ("result_datetime", "modified_at")}
    )


def invalid_events(events: DataFrame, carry: Sequence[str] = ("seq",)) -> DataFrame:
    """The complement of :func:`event_log`, with the field at fault."""
    marked = normalize_events(events, carry).withColumn("reason", invalid_event_reason())
    return marked.filter(F.col("reason").isNotNull())


def _utc(value: datetime | str) -> Column:
    if isinstance(value, datetime):
        aware = value if value.tzinfo else value.replace(tzinfo=timezone.utc)
        return F.lit(aware.astimezone(timezone.utc).isoformat()).cast("timestamp")
    return F.lit(value).cast("timestamp")


def search_events(
    log: DataFrame,
    *,
    patient_id: str | None = None,
    order_id: str | None = None,
    modified_after: datetime | str | None = None,
    limit: int | None = None,
    seq: str = "seq",
) -> DataFrame:
    """Events by patient, order and change time (strictly later), oldest change first.

    An empty id is no filter. Ties keep arrival order.
    """
    found = log
    if patient_id:
        found = found.filter(F.col("patient_id") == patient_id)
    if order_id:
        found = found.filter(F.col("order_id") == order_id)
    if modified_after is not None:
        found = found.filter(F.col("modified_at") > _utc(modified_after))
    found = found.orderBy("modified_at", seq)
    return found if limit is None else found.limit(limit)


def check_known(log: DataFrame, *, patient_id: str | None = None, order_id: str | None = None) -> None:
    """Raise when a given patient or order has no event."""
    for name, wanted in (("patient_id", patient_id), ("order_id", order_id)):
        if wanted and log.filter(F.col(name) == wanted).limit(1).isEmpty():
            raise UnknownKey(f"no event with {name} {wanted}")


def events_for(log: DataFrame, requested: DataFrame, key: str) -> DataFrame:
    """All events of the requested keys (a set of patients, orders or results)."""
    return log.join(requested.select(key), key, "left_semi")


def unknown_keys(log: DataFrame, requested: DataFrame, key: str) -> DataFrame:
    """Requested keys without any event."""
    return requested.join(log.select(key), key, "left_anti")


def result_history(log: DataFrame, requested: DataFrame, seq: str = "seq") -> DataFrame:
    """Every event of the requested results in arrival order."""
    return events_for(log, requested, "result_id").orderBy("result_id", seq)


def latest_by_arrival(log: DataFrame, seq: str = "seq") -> DataFrame:
    """The last event that arrived per result, whatever its ``modified_at``."""
    return first_row(log, ["result_id"], [F.col(seq).desc_nulls_last()])


def patient_summaries(log: DataFrame) -> DataFrame:
    """Distinct orders and results per patient over all events."""
    return log.groupBy("patient_id").agg(
        F.count_distinct("order_id").alias("orders_count"), F.count_distinct("result_id").alias("results_count")
    )


def order_summaries(log: DataFrame) -> DataFrame:
    """Distinct results and time span per (patient, order, specimen), earliest first per patient."""
    return (
        log.groupBy(*CASE_KEYS)
        .agg(
            F.count_distinct("result_id").alias("results_count"),
            F.min("result_datetime").alias("first_result_datetime"),
            F.max("result_datetime").alias("last_result_datetime"),
        )
        .orderBy("patient_id", "first_result_datetime", "order_id", "specimen_id")
    )


def append_events(log: DataFrame, new_events: DataFrame) -> DataFrame:
    return log.unionByName(new_events.select(*log.columns))


def apply_updates(log: DataFrame, changes: DataFrame, seq: str = "seq") -> DataFrame:
    """Events for a set of value changes.

    ``changes``: result_id, event_id, modified_at, a unique ``change_seq`` rising with it, and any
    of the six patch fields (null = keep). Each change copies the last event of its result, with
    the change and the earlier changes of the same set applied. Unknown results are left to
    :func:`unknown_keys`.
    """
    given = [f for f in PATCH_FIELDS if f in changes.columns]
    folded = running_last(
        changes.select("result_id", "event_id", "modified_at", "change_seq", *given),
        ["result_id"],
        ["modified_at", "change_seq"],
        given,
    )
    patch = folded.select(
        "result_id",
        F.col("event_id").alias("_event_id"),
        F.col("modified_at").alias("_modified_at"),
        F.col("change_seq").alias("_change_seq"),
        *[F.col(f).alias("_" + f) for f in given],
    )
    last = latest_by_arrival(log, seq)
    replaced = {f: F.coalesce(F.col("_" + f).cast(log.schema[f].dataType), F.col(f)) for f in given}
    return (
        last.join(patch, "result_id")
        .withColumns(
            {
                **replaced,
                "event_id": F.col("_event_id"),
                "event_type": F.lit(fv.EVENT_UPDATED),
                "modified_at": F.col("_modified_at").cast(log.schema["modified_at"].dataType),
                "change_seq": F.col("_change_seq"),
            }
        )
        .select(*EVENT_COLUMNS, "change_seq")
    )


def apply_validations(log: DataFrame, requests: DataFrame, seq: str = "seq") -> DataFrame:
    """Validation events: the last event of each requested result, made FINAL.

    ``requests``: result_id, event_id, modified_at.
    """
    wanted = requests.select(
        "result_id", F.col("event_id").alias("_event_id"), F.col("modified_at").alias("_modified_at")
    )
    return (
        latest_by_arrival(log, seq)
        .join(wanted, "result_id")
        .withColumns(
            {
                "event_id": F.col("_event_id"),
                "event_type": F.lit(fv.EVENT_VALIDATED),
                "validation_status": F.lit("FINAL"),
                "modified_at": F.col("_modified_at").cast(log.schema["modified_at"].dataType),
            }
        )
        .select(*EVENT_COLUMNS)
    )


def layer_counts(**layers: DataFrame) -> DataFrame:
    """Row count of every named layer."""
    counts = [df.agg(F.count("*").alias("records")).select(F.lit(n).alias("layer"), "records") for n, df in layers.items()]
    total = counts[0]
    for other in counts[1:]:
        total = total.unionByName(other)
    return total


def sample_lines(lines: DataFrame, order: Sequence[str], limit: int = fv.SAMPLE_ROWS) -> DataFrame:
    """First ``limit`` lines, in file order, that hold a JSON object; ``lines`` has a ``value`` column."""
    return lines.filter(is_json_object(F.col("value"))).orderBy(*order).limit(limit)


def is_json_object(text: Column) -> Column:
    kind = F.schema_of_variant(F.try_parse_json(text))
    return F.coalesce(kind.startswith("OBJECT"), F.lit(False))
