"""Column lists and StructTypes of the layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T

EVENT_COLUMNS = [
    "event_id",
    "source_system",
    "origin_source",
    "event_type",
    "patient_id",
    "order_id",
    "specimen_id",
    "test_code",
    "loinc_code",
    "test_name",
    "value",
    "unit",
    "reference_range",
    "abnormal_flag",
    "validation_status",
    "result_datetime",
    "result_id",
    "modified_at",
]
PUBLIC_EVENT_COLUMNS = [c for c in EVENT_COLUMNS if c not in ("result_id", "modified_at")]
OPTIONAL_EVENT_COLUMNS = ["loinc_code", "unit", "reference_range", "abnormal_flag"]
KAFKA_COLUMNS = ["kafka_topic", "kafka_partition", "kafka_offset"]
CASE_KEYS = ["patient_id", "order_id", "specimen_id"]

EVENT_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in EVENT_COLUMNS])

RESULT_FIELDS = [
    "result_id",
    "test_code",
    "loinc_code",
    "test_name",
    "value_raw",
    "value_numeric",
    "value_text",
    "unit",
    "reference_range",
    "abnormal_flag",
    "validation_status",
    "result_datetime",
    "modified_at",
]
HASHED_RESULT_FIELDS = [
    "result_id",
    "test_code",
    "value_raw",
    "unit",
    "abnormal_flag",
    "validation_status",
    "modified_at",
]

NORMALIZED_COLUMNS = [
    "source_patient_id",
    "source_observation_id",
    "source_order_id",
    "source_specimen_id",
    "test_code",
    "loinc_code",
    "test_name",
    "value",
    "unit",
    "reference_range",
    "abnormal_flag",
    "validation_status",
    "result_datetime",
]


class SchemaMismatch(ValueError):
    """A frame has missing or unexpected columns."""


def require_columns(df: DataFrame, required: list[str], *, exact: bool = False) -> DataFrame:
    """Fail while planning when columns are missing (or, with ``exact``, unexpected)."""
    missing = [c for c in required if c not in df.columns]
    extra = [c for c in df.columns if c not in required] if exact else []
    if missing or extra:
        raise SchemaMismatch(f"missing columns {missing}, unexpected columns {extra}")
    return df


def assert_no_source_ids(df: DataFrame) -> DataFrame:
    """Privacy check: internal ``source_*_id`` columns may not reach an output."""
    leaked = [c for c in df.columns if c.startswith("source_") and c != "source_system"]
    if leaked:
        raise SchemaMismatch(f"internal identifiers may not be written: {leaked}")
    return df
