"""Deterministic identifiers and content hashes, all computed inside the JVM."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, functions as F

from .. import fixed_values as fv
from ..schemas import HASHED_RESULT_FIELDS

_BLOCK = 64  # SHA-256 block size


class WeakSecret(ValueError):
    """The pseudonym secret is missing or too short."""


def _binary_literal(data: bytes) -> Column:
    return F.unhex(F.lit(data.hex()))


def hmac_sha256_hex(text: Column, secret: str) -> Column:
    """HMAC-SHA256 as lower-case hex, from two native SHA-256 calls."""
    key = secret.encode("utf-8")
    if len(key) > _BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(_BLOCK, b"\0")
    inner_pad = _binary_literal(bytes(b ^ 0x36 for b in key))
    outer_pad = _binary_literal(bytes(b ^ 0x5C for b in key))
    inner = F.sha2(F.concat(inner_pad, F.encode(text, "UTF-8")), 256)
    return F.sha2(F.concat(outer_pad, F.unhex(inner)), 256)


def pseudonym(patient_id: Column, secret: str) -> Column:
    """``PAT-`` + keyed hash. The secret must be long; it is never logged.

    The pads become plan literals: keep ``spark.sql.redaction.string.regex`` set
    (:func:`assaylake.session.configure` does).
    """
    if len(secret or "") < fv.MIN_SECRET_LENGTH:
        raise WeakSecret(f"the secret needs at least {fv.MIN_SECRET_LENGTH} characters")
    return F.concat(F.lit("PAT-"), hmac_sha256_hex(patient_id, secret))


def name_uuid(text: Column) -> Column:
    """Version-5 UUID of the text in the fixed namespace."""
    namespace = _binary_literal(uuid.UUID(fv.ID_NAMESPACE).bytes)
    digest = F.sha1(F.concat(namespace, F.encode(text, "UTF-8")))
    # The variant digit keeps two hash bits under the fixed top bits 10.
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") + 1, F.lit(1))
    return F.concat(
        F.substring(digest, 1, 8),
        F.lit("-"),
        F.substring(digest, 9, 4),
        F.lit("-5"),
        F.substring(digest, 14, 3),
        F.lit("-"),
        variant,
        F.substring(digest, 18, 3),
        F.lit("-"),
        F.substring(digest, 21, 12),
    )


def stable_id(prefix: str, text: Column) -> Column:
    return F.concat(F.lit(prefix + "-"), name_uuid(text))


def derived_result_id(*parts: Column) -> Column:
    """``RES-`` + SHA-256 of the non-null parts joined by ``|``."""
    return F.concat(F.lit("RES-"), F.sha2(F.concat_ws("|", *parts), 256))


def silver_result_id(result_id: Column, parsed_result_time: Column) -> Column:
    """The given id when it is not blank, else one derived from the typed event."""
    derived = derived_result_id(
        F.col("patient_id"),
        F.col("order_id"),
        F.col("specimen_id"),
        F.col("test_code"),
        parsed_result_time.cast("string"),
    )
    return F.when(F.length(F.trim(result_id)) > 0, result_id).otherwise(derived)


def raw_result_id() -> Column:
    """Result id over the raw event text; a missing part counts as empty text."""
    names = ("patient_id", "order_id", "specimen_id", "test_code", "result_datetime")
    return derived_result_id(*[F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names])


def order_key(order_id: Column, observation_key: Column) -> Column:
    return F.coalesce(F.nullif(order_id, F.lit("")), F.concat(observation_key, F.lit("|order")))


def specimen_key(specimen_id: Column, order: Column) -> Column:
    return F.coalesce(F.nullif(specimen_id, F.lit("")), F.concat(order, F.lit("|specimen")))


def hashed_result(item: Column) -> Column:
    """The fields of one result that count as content."""
    return F.struct(*[item[f].cast("string").alias(f) for f in HASHED_RESULT_FIELDS])


def context_hash(results: Column) -> Column:
    """Content hash of a case: its keys and its ordered results as JSON, null fields left out."""
    payload = F.to_json(F.transform(results, hashed_result))
    return F.sha2(F.concat_ws("|", "patient_id", "order_id", "specimen_id", payload), 256)


SET_HASH_FIELDS = [
    "abnormal_flag",
    "modified_at",
    "order_id",
    "patient_id",
    "result_id",
    "specimen_id",
    "test_code",
    "unit",
    "validation_status",
    "value_raw",
]


def set_hash(records: Column) -> Column:
    """Order-free hash of an array of result records, nulls written, names in text order.

    Records sort by their key columns, null keys as empty text. ``modified_at`` text is hashed
    as given, a null one as ``None``.
    """
    keys = ("patient_id", "order_id", "specimen_id", "result_id")

    def sortable(item: Column) -> Column:
        fields = [
            (F.coalesce(item[f].cast("string"), F.lit("None")) if f == "modified_at" else item[f].cast("string")).alias(f)
            for f in SET_HASH_FIELDS
        ]
        return F.struct(
            *[F.coalesce(item[k], F.lit("")).alias("sort_" + k) for k in keys], F.struct(*fields).alias("record")
        )

    ordered = F.array_sort(F.transform(records, sortable))
    payload = F.to_json(F.transform(ordered, lambda s: s["record"]), {"ignoreNullFields": "false"})
    return F.sha2(payload, 256)
