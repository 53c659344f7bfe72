"""Polling for changes with a cursor that loses no event, equal copies included."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Row, functions as F


@dataclass(frozen=True)
class Cursor:
    """The last event seen: its change time, its id and its arrival number."""

    modified_at: datetime
    event_id: str = ""
    seq: int = -1


def changes_after(log: DataFrame, cursor: Cursor | None, limit: int | None = None) -> DataFrame:
    """Events after the cursor in (modified_at, event_id, seq) order.

    Copies of an event share time and id, so only the arrival number makes the order total; a page
    may end between two of them.
    """
    found = log
    if cursor is not None:
        later = F.col("modified_at") > F.lit(cursor.modified_at)
        same = F.col("modified_at") == F.lit(cursor.modified_at)
        after = (F.col("event_id") > cursor.event_id) | ((F.col("event_id") == cursor.event_id) & (F.col("seq") > cursor.seq))
        found = found.filter(later | (same & after))
    found = found.orderBy("modified_at", "event_id", "seq")
    return found if limit is None else found.limit(limit)


def poll(log: DataFrame, cursor: Cursor | None, limit: int) -> tuple[list[Row], Cursor | None]:
    """One page of at most ``limit`` events and where to go on; the given cursor when there is none."""
    page = changes_after(log, cursor, limit).collect()
    if not page:
        return [], cursor
    last = page[-1]
    return page, Cursor(last["modified_at"], last["event_id"], last["seq"])
