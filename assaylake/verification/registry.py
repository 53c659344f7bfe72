"""Where queries and their SQL counterparts are registered."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

QUERIES = {}
ORACLES = {}


def register(name: str, sql: str | None):
    """Keep the query under this name, with its DuckDB SQL when SQL can state it."""

    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return keep


def as_text(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("string") for n in names})
