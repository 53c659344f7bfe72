import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from assaylake.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[*]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    configure(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def ranges(spark):
    from assaylake.sources.ranges import range_table

    return range_table(spark)


EVENT = {
    "event_id": "EVT-1",
    "source_system": "GLIMS_SIM",
    "origin_source": "SYNTHEA",
    "event_type": "LAB_RESULT_CREATED",
    "patient_id": "PAT-1",
    "order_id": "ORD-1",
    "specimen_id": "SPC-1",
    "test_code": "6690-2",
    "loinc_code": "6690-2",
    "test_name": "Leukocytes",
    "value": "3.9",
    "unit": "10*3/uL",
    "reference_range": None,
    "abnormal_flag": None,
    "validation_status": "FINAL",
    "result_datetime": "2026-01-01T00:00:00Z",
    "result_id": "RES-1",
    "modified_at": "2026-01-01T00:00:00Z",
}


@pytest.fixture(scope="session")
def make_events(spark):
    """Build an event frame from changes to one default event."""
    from assaylake.schemas import EVENT_COLUMNS

    def build(*changes, drop=(), seq=False):
        rows = [{**EVENT, **change} for change in changes]
        names = [c for c in EVENT_COLUMNS if c not in drop]
        data = [tuple(r[c] for c in names) + ((i,) if seq else ()) for i, r in enumerate(rows)]
        ddl = ", ".join(f"{c} string" for c in names) + (", seq long" if seq else "")
        return spark.createDataFrame(data, ddl)

    return build
