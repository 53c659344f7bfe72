"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from . import queries_core, queries_events, queries_reports  # noqa: F401  (importing registers them)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
