import json

import pytest
from pyspark.sql import functions as F

from assaylake.operators import extracts
from assaylake.plans.adapter import run_adapter
from assaylake.schemas import PUBLIC_EVENT_COLUMNS, SchemaMismatch, assert_no_source_ids
from assaylake.sources import extracts as sources

SECRET = "test-secret-0123456789-0123456789-abc"


def normalized(df):
    return {r.source_observation_id: r for r in df.collect()}


@pytest.fixture
def csv_folder(tmp_path):
    lonely = tmp_path / "a"
    lonely.mkdir()
    (lonely / "patients.csv").write_text("Id\nignored\n")
    pair = tmp_path / "b"
    pair.mkdir()
    (pair / "patients.csv").write_bytes("﻿Id,NAME\np1,Ann\n p2 ,Bo\n,none\n".encode())
    (pair / "observations.csv").write_bytes(
        "﻿DATE,PATIENT,ENCOUNTER,CATEGORY,CODE,DESCRIPTION,VALUE,UNITS\n"
        "2026-01-02T03:04:05Z,p1,e1,laboratory,2093-3,Cholesterol,180,mg/dL\n"
        "2026-01-02T03:04:05Z,p1,e1,laboratory,2093-3,Cholesterol,180,mg/dL\n"
        "2026-01-02,p2,,LAB,718-7,\"Hemo, \"\"x\"\"\",14,\n"
        "2026-01-02,p9,e1,laboratory,718-7,Hemo,14,\n"
        "2026-01-02,p1,e1,vital-signs,718-7,Hemo,14,\n"
        "2026-01-02,p1,e1,laboratory,,Hemo,14,\n"
        "2026-01-02,p1,e1,laboratory,718-7,Hemo,  ,\n"
        "never,p1,e1,laboratory,718-7,Hemo,14,\n"
        "2026-01-02,p1,e1,laboratory,718-7,,14,\n".encode()
    )
    return tmp_path


def test_csv_pair_is_read_with_its_rules(spark, csv_folder):
    rows = sources.read_normalized(spark, str(csv_folder)).collect()
    assert sorted((r.source_patient_id, r.test_code, r.value, r.result_datetime) for r in rows) == [
        ("p1", "2093-3", "180", "2026-01-02T03:04:05Z"),
        ("p1", "2093-3", "180", "2026-01-02T03:04:05Z"),
        ("p2", "718-7", "14", "2026-01-02T00:00:00"),
    ]
    assert len({r.source_observation_id for r in rows}) == 3
    bo = next(r for r in rows if r.source_patient_id == "p2")
    assert (bo.test_name, bo.unit, bo.source_order_id, bo.loinc_code) == ('Hemo, "x"', None, None, "718-7")


def test_unknown_patients_are_the_complement(spark, csv_folder):
    patients, observations = (sources.read_csv(spark, p) for p in sources.find_csv_pair(spark, str(csv_folder)))
    unknown = extracts.unknown_patient_observations(observations, patients)
    assert [r.PATIENT for r in unknown.collect()] == ["p9"]
    assert extracts.known_patient_observations(observations, patients).count() == observations.count() - 1


def test_copies_without_id_get_stable_distinct_ids(spark):
    rows = spark.createDataFrame([("p", "c", "same")] * 25 + [("p", "c", "other")], "PATIENT string, CODE string, VALUE string")
    found = extracts.with_observation_ids(rows)
    again = extracts.with_observation_ids(rows.repartition(5))
    ids = sorted(r.source_observation_id for r in found.collect())
    assert len(set(ids)) == 26 and ids == sorted(r.source_observation_id for r in again.collect())


def test_many_copies_are_written_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(extracts, "COPIES_PER_PIECE", 7)
    rows = spark.range(50).select(F.lit("p").alias("PATIENT"))
    assert extracts.with_observation_ids(rows).select("source_observation_id").distinct().count() == 50


def test_own_ids_are_kept(spark):
    rows = spark.createDataFrame([(" o1 ", "p"), (None, "p"), ("", "p")], "Id string, PATIENT string")
    ids = [r.source_observation_id for r in extracts.with_observation_ids(rows).collect()]
    assert "o1" in ids and len(set(ids)) == 3


def observation(**changes):
    base = {
        "resourceType": "Observation", "id": "o1", "status": "preliminary", "effectiveDateTime": "2026-01-02T03:04:05+00:00",
        "category": [{"coding": [{"code": "laboratory"}]}],
        "code": {"text": "Chol text", "coding": [
            {"system": "urn:local", "code": "L1", "display": "Local"},
            {"system": "http://loinc.org", "code": "2093-3", "display": "Cholesterol"}]},
        "subject": {"reference": "Patient/p1/"}, "basedOn": [{"reference": "ServiceRequest/s1"}],
        "specimen": {"reference": "urn:x/Specimen/sp1"},
        "valueQuantity": {"value": 13.50, "unit": "mg/dL"},
        "referenceRange": [{"low": {"value": 0, "unit": "mg/dL"}, "high": {"value": 200.0, "unit": "mg/dL"}}],
        "interpretation": [{"coding": [{}]}, {"coding": [{"code": "H"}]}],
    }
    return {k: v for k, v in {**base, **changes}.items() if v is not None}


@pytest.fixture
def fhir(tmp_path):
    local = {"coding": [{"code": "L1"}], "text": "Only text"}
    bundle = {"resourceType": "Bundle", "entry": [
        {"resource": observation()},
        {"resource": {"resourceType": "Patient", "id": "p1"}},
        {},
        {"resource": observation(id="o2", valueQuantity=None, valueString="yellow", code=local, status=None, specimen=None,
                                 basedOn=None, referenceRange=[{"text": "clear"}], interpretation=None)},
        {"resource": observation(id="o3", valueQuantity=None, valueCodeableConcept={"text": "positive"}, effectiveDateTime=None,
                                 issued="2026-01-03T00:00:00Z", referenceRange=[{"low": {"value": 1.50}}],
                                 category=[{"coding": [{"code": "x"}]}, {"coding": [{"code": "lab"}]}])},
        {"resource": observation(id="o4", category=[{"coding": [{"code": "Laboratory"}]}])},
        {"resource": observation(id="o5", category=None)},
        {"resource": observation(id="o6", valueQuantity={"unit": "x"})},
        {"resource": observation(id="o7", subject=None)},
        {"resource": observation(id="o8", effectiveDateTime="soon")},
        {"resource": observation(id="o9", valueQuantity={"value": 13, "code": "mg"})},
    ]}
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "bundle.json").write_text(json.dumps(bundle, indent=1).replace("13.5,", "13.50,"))
    (tmp_path / "bare.json").write_text(json.dumps(observation(id="bare")))
    (tmp_path / "broken.json").write_text('{"resourceType": "Observation", ')
    return tmp_path


def test_fhir_resources(spark, fhir):
    rows = normalized(sources.read_normalized(spark, str(fhir)))
    assert sorted(rows) == ["bare", "o1", "o2", "o3", "o9"]
    one = rows["o1"]
    assert (one.source_patient_id, one.source_order_id, one.source_specimen_id) == ("p1", "s1", "sp1")
    assert (one.test_code, one.loinc_code, one.test_name) == ("2093-3", "2093-3", "Cholesterol")
    assert (one.value, one.unit, one.reference_range) == ("13.5", "mg/dL", "0 - 200.0 mg/dL")
    assert (one.abnormal_flag, one.validation_status, one.result_datetime) == ("H", "PRELIMINARY", "2026-01-02T03:04:05Z")
    two = rows["o2"]
    assert (two.test_code, two.loinc_code, two.test_name, two.value, two.unit) == ("L1", None, "Only text", "yellow", None)
    assert (two.validation_status, two.reference_range, two.abnormal_flag, two.source_order_id) == ("FINAL", "clear", None, None)
    three = rows["o3"]
    assert (three.value, three.result_datetime, three.reference_range) == ("positive", "2026-01-03T00:00:00Z", "1.5")
    assert (rows["o9"].value, rows["o9"].unit) == ("13", "mg")


def test_adapter_writes_public_events_only(spark, csv_folder, tmp_path):
    written = run_adapter(spark, str(csv_folder), str(tmp_path / "out"), SECRET)
    assert (written.records, written.format) == (3, "json")
    lines = [json.loads(line.value) for line in spark.read.text(written.path).collect()]
    assert all(list(e) == PUBLIC_EVENT_COLUMNS for e in lines)
    assert all(e["patient_id"].startswith("PAT-") and e["reference_range"] is None for e in lines)
    assert len({e["event_id"] for e in lines}) == 3 and len({e["order_id"] for e in lines}) == 2


def test_empty_folder_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        sources.read_normalized(spark, str(tmp_path))


def test_source_ids_may_not_leave(spark):
    with pytest.raises(SchemaMismatch):
        assert_no_source_ids(spark.range(1).withColumn("source_patient_id", F.lit("x")))


def test_reference_tail(spark):
    frame = spark.createDataFrame([("Patient/1",), ("1",), ("a/b/c//",), ("",), (None,)], "r string")
    assert [r.t for r in frame.select(extracts.reference_tail(F.col("r")).alias("t")).collect()] == ["1", "1", "c", None, None]
