"""Session settings this library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Hashes cover timestamp text, so every session has to render timestamps in UTC.
REQUIRED = {"spark.sql.session.timeZone": "UTC"}

RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # HMAC pads are literals in the plan; mask 64-byte hex runs in plan text.
    "spark.sql.redaction.string.regex": "(?i)[0-9a-f]{128}",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session and give it back."""
    for key, value in {**RECOMMENDED, **REQUIRED}.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The cluster's shared checkpoint folder, when one is configured."""
    return spark.conf.get("spark.checkpoint.dir", None)
