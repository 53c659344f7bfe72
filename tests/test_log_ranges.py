from datetime import datetime

import pytest
from pyspark.sql import functions as F

from assaylake.operators.events import search_events
from assaylake.sources import log_ranges
from assaylake.streaming.cursor import Cursor, changes_after
from assaylake.verification import inputs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    """A log with a third of its rows at one change time, in ranges of 100 rows."""
    folder = str(tmp_path_factory.mktemp("ranges"))
    rows = inputs.event_log(spark, SF)
    hot = rows.agg(F.max("modified_at")).first()[0]
    rows = rows.withColumn("modified_at", F.when(F.col("seq") % 3 == 0, F.lit(hot)).otherwise(F.col("modified_at"))).cache()
    log_ranges.write_ranges(rows, f"{folder}/log", 100)
    yield rows, f"{folder}/log", hot
    rows.unpersist()


def places(df):
    return [(r.modified_at, r.event_id, r.seq) for r in df.collect()]


def test_ranges_are_even_and_hold_every_row(spark, log):
    rows, path, _ = log
    index = spark.read.parquet(f"{path}/index").orderBy("range").collect()
    assert sum(e["rows"] for e in index) == rows.count() and max(e["rows"] for e in index) < 300
    assert all(tuple(a["last"]) < tuple(b["first"]) for a, b in zip(index, index[1:], strict=False))


def test_pages_follow_each_other_and_open_few_files(spark, log):
    rows, path, _ = log
    expected = places(changes_after(rows, None))
    found, cursor = [], None
    for _ in range(3):
        page = log_ranges.page_after(spark, path, cursor, 150)
        assert len(page.inputFiles()) <= 4
        found += places(page)
        cursor = Cursor(*found[-1])
    assert found == expected[:450]
    middle = expected[len(expected) // 2]
    assert places(log_ranges.page_after(spark, path, Cursor(*middle), 40)) == expected[len(expected) // 2 + 1 :][:40]
    assert places(log_ranges.page_after(spark, path, Cursor(*expected[-1]), 40)) == []


def test_search_by_change_time(spark, log):
    rows, path, hot = log
    times = [r[0] for r in rows.select("modified_at").distinct().orderBy("modified_at").collect()]
    for after in (datetime(1990, 1, 1), times[len(times) // 2], times[-2], hot):
        for limit in (1, 130):
            page = log_ranges.page_modified_after(spark, path, after, limit)
            assert places(page) == places(search_events(rows, modified_after=after, limit=limit))


def test_an_empty_log(spark, log, tmp_path):
    rows, _, _ = log
    log_ranges.write_ranges(rows.limit(0), str(tmp_path / "none"))
    assert places(log_ranges.page_after(spark, str(tmp_path / "none"), None, 5)) == []
