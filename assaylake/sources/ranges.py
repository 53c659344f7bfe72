"""The reference-range dimension."""

from __future__ import annotations

import json
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .. import fixed_values as fv


def range_table(spark: SparkSession, rows=fv.REFERENCE_RANGES) -> DataFrame:
    """Ranges as a local table ``code, name, low, high, unit``, whose size the planner knows."""
    names = ["code", "name", "low", "high", "unit"]
    kinds = [pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string()]
    columns = list(zip(*rows)) or [()] * len(names)
    return spark.createDataFrame(pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names))


def _parse(text: str) -> dict[str, Any]:
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text) or {}


def load_ranges(spark: SparkSession, path: str) -> DataFrame:
    """Read a YAML (or JSON) file with a ``reference_ranges`` mapping of code to bounds."""
    text = "\n".join(row[0] for row in spark.read.text(path, wholetext=True).collect())
    entries = _parse(text).get("reference_ranges") or {}

    def number(value):
        return None if value is None else float(value)

    return range_table(
        spark,
        [
            (str(code), e.get("name"), number(e.get("low")), number(e.get("high")), e.get("unit"))
            for code, e in entries.items()
            if e
        ],
    )
