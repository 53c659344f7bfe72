import hashlib
import hmac
import uuid

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from assaylake import fixed_values as fv
from assaylake.functions import ids, texts, values

SECRET = "test-secret-0123456789-0123456789-abc"


def column(spark, data, expression, kind="string"):
    frame = spark.createDataFrame([(i, d) for i, d in enumerate(data)], f"i int, x {kind}")
    return [r.y for r in frame.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


NUMBERS = {
    "3.9": 3.9, "> 140 mg/dL": 140.0, "yellow": None, "1,200": 1.0, "1e5": 1.0, "A-1": -1.0, "5.": 5.0, ".5": 0.5,
    "": None, None: None, "+7": 7.0, "--2": -2.0, "low 0.60 of 2": 0.6, "  12 ": 12.0,
}


def test_first_number_in_text(spark):
    assert column(spark, NUMBERS, values.parse_numeric) == list(NUMBERS.values())


def test_flags(spark):
    rows = [(3.9, True, 4.0, 11.0), (12.0, True, 4.0, 11.0), (7.0, True, 4.0, 11.0), (4.0, True, 4.0, 11.0),
            (11.0, True, 4.0, 11.0), (7.0, False, None, None), (None, True, 4.0, 11.0), (5.0, True, None, None),
            (1.0, True, None, 11.0), (99.0, True, 4.0, None)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, v double, k boolean, l double, h double")
    flags = frame.select("i", values.range_flag(F.col("v"), F.col("k"), F.col("l"), F.col("h")).alias("f")).orderBy("i")
    assert [r.f for r in flags.collect()] == ["L", "H", "N", "N", "N", "UNKNOWN", "UNKNOWN", "N", "N", "N"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(-(10**12), 10**12), st.integers(0, 12)), min_size=20, max_size=200))
def test_float_text_is_shortest_decimal(spark, parts):
    numbers = [n / 10**k for n, k in parts] + [1e7, 1e15, 1e16, 1.5e-5, 0.0001, 1e22, -2.5e8]
    assert column(spark, numbers, values.float_text, "double") == [str(n) for n in numbers]


TIMES = {
    "2026-01-02": "2026-01-02T00:00:00",
    "2026-01-02T03:04:05": "2026-01-02T03:04:05",
    "2026-01-02T03:04:05Z": "2026-01-02T03:04:05Z",
    "2026-01-02 03:04:05+00:00": "2026-01-02T03:04:05Z",
    " 2026-01-02T03:04:05+00:00 ": "2026-01-02T03:04:05Z",
    "2026-01-02T03:04:05.123+05:30": "2026-01-02T03:04:05.123000+05:30",
    "2026-01-02T03:04:05-05:00": "2026-01-02T03:04:05-05:00",
    "2026-01-02T03:04": "2026-01-02T03:04:00",
    "2026-13-02": None,
    "soon": None,
    "": None,
    None: None,
}


def test_event_time_text(spark):
    assert column(spark, TIMES, values.event_time_text) == list(TIMES.values())


def test_bad_time_gives_null_under_ansi(spark):
    assert column(spark, ["bad", None], values.parse_time) == [None, None]


def test_pseudonym_is_hmac_and_depends_on_the_secret(spark):
    patients = ["source-patient-123", "", "é", "x" * 100]
    expected = ["PAT-" + hmac.new(SECRET.encode(), p.encode(), hashlib.sha256).hexdigest() for p in patients]
    assert column(spark, patients, lambda c: ids.pseudonym(c, SECRET)) == expected
    long_secret = "b" * 100
    long_expected = "PAT-" + hmac.new(long_secret.encode(), b"p", hashlib.sha256).hexdigest()
    assert column(spark, ["p"], lambda c: ids.pseudonym(c, long_secret)) == [long_expected]
    one, two = (column(spark, ["p"], lambda c, s=s: ids.pseudonym(c, s)) for s in ("a" * 32, "b" * 32))
    assert one != two


@pytest.mark.parametrize("secret", ["", "short", "a" * 31])
def test_weak_secrets_are_refused(spark, secret):
    with pytest.raises(ids.WeakSecret):
        ids.pseudonym(F.lit("p"), secret)


def test_stable_ids_are_name_uuids(spark):
    names = [f"SYNTHEA|{i}" for i in range(200)] + ["é", ""]
    expected = ["EVT-" + str(uuid.uuid5(uuid.UUID(fv.ID_NAMESPACE), n)) for n in names]
    assert column(spark, names, lambda c: ids.stable_id("EVT", c)) == expected


def test_model_labels(spark):
    frame = spark.createDataFrame([("remote_medgemma", "m"), ("mock_medgemma", "mock_medgemma"), ("x", "y")], "p string, m string")
    stored = frame.select(texts.storage_model_name(F.col("p"), F.col("m")).alias("s"))
    assert [r.s for r in stored.collect()] == ["remote_medgemma:m", "mock_medgemma", "y"]
    assert [r.p for r in stored.select(texts.provider_of(F.col("s")).alias("p")).collect()] == [
        "remote_medgemma", "mock_medgemma", "unknown",
    ]


def test_export_filename(spark):
    assert column(spark, ["RPT-1/é 2"], lambda c: texts.export_filename(F.lit("FINAL_PDF"), c, F.lit(3))) == [
        "final_pdf_RPT-1_2_v3.pdf"
    ]


def test_json_object_sorts_names_and_escapes(spark):
    built = column(spark, ['say "hi"\n', None], lambda c: texts.json_object(b=F.lit("1"), a=texts.json_text(c)))
    assert built == ['{"a": "say \\"hi\\"\\n", "b": 1}', '{"a": null, "b": 1}']


def test_set_hash_ignores_order(spark):
    record = ("p", "o", "s", "{}", "c", "1", None, "N", "FINAL", "2026-01-01")
    kind = "array<struct<patient_id:string,order_id:string,specimen_id:string,result_id:string,test_code:string,value_raw:string,unit:string,abnormal_flag:string,validation_status:string,modified_at:string>>"
    a, b = (tuple(v.format(n) if v else v for v in record) for n in ("r1", "r2"))
    hashes = column(spark, [[a, b], [b, a], [a]], ids.set_hash, kind)
    assert hashes[0] == hashes[1] != hashes[2]
    names = ["patient_id", "order_id", "specimen_id", "result_id", "test_code", "value_raw", "unit", "abnormal_flag", "validation_status", "modified_at"]
    import json

    payload = json.dumps([dict(zip(names, r)) for r in (a, b)], sort_keys=True, separators=(",", ":"))
    assert hashes[0] == hashlib.sha256(payload.encode()).hexdigest()
