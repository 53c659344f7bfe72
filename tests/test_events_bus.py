from datetime import datetime

import pytest
from pyspark.sql import functions as F

from assaylake.operators import bus, events
from assaylake.schemas import SchemaMismatch
from assaylake.streaming.cursor import poll
from assaylake.verification import inputs

ROUTES = {
    "LAB_RESULT_CREATED": "glims.result", "LAB_RESULT_UPDATED": "glims.result", "LAB_RESULT": "glims.result",
    "UNKNOWN": "glims.result", "LAB_RESULT_VALIDATED": "glims.validation", "VALIDATION_UPDATED": "glims.validation",
    "PATIENT_CREATED": "glims.patient", "patient_updated": "glims.patient", "ORDER_CREATED": "glims.order",
    "ORDER_UPDATED": "glims.order", "SPECIMEN_CREATED": "glims.specimen", "SPECIMEN_UPDATED": "glims.specimen",
    None: "glims.result",
}


def test_routing(spark):
    frame = spark.createDataFrame([(k, v) for k, v in ROUTES.items()], "t string, expected string")
    assert frame.filter(bus.topic_of(F.col("t")) != F.col("expected")).isEmpty()


def test_envelope_key_and_explicit_nulls(make_events):
    sent = bus.envelopes(make_events({}, {"result_id": ""}, {"result_id": None, "event_id": None})).collect()
    assert [r.key for r in sent] == ["RES-1", "EVT-1", ""]
    assert '"reference_range":null' in sent[0].value


def test_publish_report(make_events):
    report = bus.publish_report(bus.envelopes(make_events({}, {"event_type": "ORDER_CREATED"}))).first()
    assert (report.published_count, report.topics_used) == (2, ["glims.order", "glims.result"])


def test_peek_wraps_what_is_not_json(spark):
    frame = spark.createDataFrame(
        [("{\"a\":1}", "t", 0, 2), ("plain \"x\"", "t", 0, 1), ("[1]", "t", 1, 0), ("{}", "other", 0, 0)],
        "value string, topic string, partition int, offset long",
    )
    peek = bus.topic_peek(frame, "t", 2).orderBy("offset").collect()
    assert [r.message for r in peek] == ['{"raw_message":"plain \\"x\\""}', '{"a":1}']


def test_normalize_is_strict_and_defaults(make_events, spark):
    normal = events.normalize_events(make_events({}, drop=["result_id", "modified_at", "unit"])).first()
    assert normal.modified_at == "2026-01-01T00:00:00Z" and normal.result_id.startswith("RES-") and normal.unit is None
    with pytest.raises(SchemaMismatch):
        events.normalize_events(make_events({}).withColumn("surprise", F.lit(1)))
    with pytest.raises(SchemaMismatch):
        events.normalize_events(make_events({}, drop=["value"]))


def log_of(make_events):
    return events.event_log(make_events(
        {"event_id": "a", "modified_at": "2026-01-03T00:00:00Z"},
        {"event_id": "b", "modified_at": "2026-01-02T00:00:00+02:00", "order_id": "ORD-2"},
        {"event_id": "c", "modified_at": "2026-01-02T00:00:00Z", "patient_id": "PAT-2", "result_id": "RES-2"},
        {"event_id": "d", "modified_at": "2026-01-02T00:00:00Z", "patient_id": "PAT-2", "result_id": "RES-2"},
        seq=True,
    ))


def ids_of(df):
    return [r.event_id for r in df.collect()]


def test_search(make_events):
    log = log_of(make_events)
    assert ids_of(events.search_events(log)) == ["b", "c", "d", "a"]
    assert ids_of(events.search_events(log, modified_after=datetime(2026, 1, 2))) == ["a"]
    assert ids_of(events.search_events(log, patient_id="PAT-1", order_id="")) == ["b", "a"]
    assert ids_of(events.search_events(log, order_id="ORD-1", limit=2)) == ["c", "d"]
    events.check_known(log, patient_id="PAT-1", order_id="ORD-2")
    with pytest.raises(events.UnknownKey):
        events.check_known(log, patient_id="nobody")


def test_arrival_order_beats_change_time(make_events):
    assert sorted(ids_of(events.latest_by_arrival(log_of(make_events)))) == ["b", "d"]


def test_invalid_events_name_the_field(make_events):
    bad = make_events({"result_datetime": "x"}, {"event_id": None}, {"value": None}, {}, seq=True)
    assert sorted(r.reason for r in events.invalid_events(bad).collect()) == ["event_id", "result_datetime", "value"]
    assert events.event_log(bad).count() == 1


def test_updates_build_on_each_other(spark, make_events):
    changes = spark.createDataFrame(
        [("RES-2", "u1", "2026-02-01 00:10:00", 1, "8", None), ("RES-2", "u2", "2026-02-01 00:20:00", 2, None, "g/L"),
         ("RES-2", "u3", "2026-02-02 00:00:00", 3, None, None), ("RES-9", "u4", "2026-02-01 00:00:00", 4, "1", None)],
        "result_id string, event_id string, modified_at string, change_seq long, value string, unit string",
    )
    log = log_of(make_events)
    new = events.apply_updates(log, changes).orderBy("event_id").collect()
    assert [(r.event_id, r.value, r.unit, r.event_type) for r in new] == [
        ("u1", "8", "10*3/uL", "LAB_RESULT_UPDATED"), ("u2", "8", "g/L", "LAB_RESULT_UPDATED"),
        ("u3", "8", "g/L", "LAB_RESULT_UPDATED"),
    ]
    assert [r.result_id for r in events.unknown_keys(log, changes, "result_id").collect()] == ["RES-9"]


def test_validation_and_append(spark, make_events):
    log = log_of(make_events)
    requests = spark.createDataFrame([("RES-1", "v1", "2026-02-01 00:00:00")], "result_id string, event_id string, modified_at string")
    new = events.apply_validations(log, requests)
    row = new.first()
    assert (row.event_type, row.validation_status, row.order_id) == ("LAB_RESULT_VALIDATED", "FINAL", "ORD-2")
    assert events.append_events(log.drop("seq"), new).count() == 5


def test_cursor_loses_no_ties(make_events):
    log, cursor, seen = log_of(make_events), None, []
    while True:
        page, cursor = poll(log, cursor, limit=2)
        if not page:
            break
        seen += [r.event_id for r in page]
    assert seen == ["b", "c", "d", "a"]


def test_pages_of_the_lab_log_give_every_event_once(spark):
    log, cursor, seen = inputs.event_log(spark, "/root/testdata/sf0.001").cache(), None, []
    while True:
        page, cursor = poll(log, cursor, limit=150)
        if not page:
            break
        seen += [r.seq for r in page]
    assert len(seen) == len(set(seen)) == log.count()
    log.unpersist()
