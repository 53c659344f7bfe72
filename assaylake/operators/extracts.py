"""Raw clinical observations (CSV or FHIR rows) to pseudonymised lab events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from ..functions import ids, values
from ..functions.values import none_if_blank
from ..schemas import NORMALIZED_COLUMNS, PUBLIC_EVENT_COLUMNS, assert_no_source_ids

LAB_CODES = ("laboratory", "lab")
COPIES_PER_PIECE = 10_000


# --- CSV -------------------------------------------------------------------------------------


def column_of(df: DataFrame, *names: str) -> Column:
    """The first non-empty of the named columns, matched exactly; null when none exists."""
    found = [F.nullif(F.col(f"`{n}`"), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def trimmed(df: DataFrame, *names: str) -> Column:
    return none_if_blank(column_of(df, *names))


def lab_predicate(df: DataFrame) -> Column:
    """Lab rows: value and code present, category containing ``laboratory`` or equal to ``lab``."""
    category = F.lower(F.coalesce(trimmed(df, "CATEGORY", "Category"), F.lit("")))
    is_lab = category.contains("laboratory") | (category == "lab")
    return (
        trimmed(df, "VALUE", "Value").isNotNull() & trimmed(df, "CODE", "Code").isNotNull() & is_lab
    )


def patient_ids(patients: DataFrame) -> DataFrame:
    return patients.select(trimmed(patients, "Id", "ID").alias("source_patient_id")).filter("source_patient_id is not null")


def _with_patient(observations: DataFrame) -> DataFrame:
    return observations.withColumn("source_patient_id", trimmed(observations, "PATIENT", "Patient"))


def known_patient_observations(observations: DataFrame, patients: DataFrame) -> DataFrame:
    """Observations whose patient is on the list."""
    return _with_patient(observations).join(patient_ids(patients), "source_patient_id", "left_semi")


def unknown_patient_observations(observations: DataFrame, patients: DataFrame) -> DataFrame:
    """The complement, for the reject feed."""
    return _with_patient(observations).join(patient_ids(patients), "source_patient_id", "left_anti")


def with_observation_ids(rows: DataFrame) -> DataFrame:
    """Give every row an observation id: its own, else a hash of its content and copy number.

    Rows without an id are counted per equal content and written out again with a number each:
    identical rows are interchangeable, so no order is needed. A row repeated very often is neither
    sorted nor collected, and its copies are written by many tasks.
    """
    own_id = trimmed(rows, "Id", "ID")
    with_id = rows.withColumn("source_observation_id", own_id).filter(F.col("source_observation_id").isNotNull())
    without = rows.filter(own_id.isNull())
    names = [c for c in rows.columns if c not in ("Id", "ID")]
    counted = without.groupBy(*names).agg(F.count("*").alias("_copies"))
    starts = F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1, F.lit(COPIES_PER_PIECE).cast("long"))
    pieces = counted.withColumn("_from", F.explode(starts)).repartition(F.xxhash64(*names, "_from"))
    last = F.least(F.col("_from") + COPIES_PER_PIECE, F.col("_copies")) - 1
    copies = pieces.withColumn("_copy", F.explode(F.sequence("_from", last)))
    lead = [c for c in ("PATIENT", "ENCOUNTER", "CODE", "DATE") if c in names]
    content = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in [*lead, *sorted(set(names) - set(lead))]]
    hashed = F.sha2(F.concat_ws("|", *content, F.col("_copy").cast("string")), 256)
    numbered = copies.withColumn("source_observation_id", hashed).select(*names, "source_observation_id")
    return with_id.select(*names, "source_observation_id").unionByName(numbered)


def normalized_csv(observations: DataFrame, patients: DataFrame) -> DataFrame:
    """Lab observations of known patients in the internal shape; incomplete rows are left out."""
    return complete_rows(shaped_csv(observations, patients))


def shaped_csv(observations: DataFrame, patients: DataFrame) -> DataFrame:
    """Lab observations of known patients in the internal shape, incomplete ones too."""
    known = with_observation_ids(known_patient_observations(observations.filter(lab_predicate(observations)), patients))
    code = trimmed(known, "CODE")
    shaped = known.select(
        "source_patient_id",
        "source_observation_id",
        trimmed(known, "ENCOUNTER").alias("source_order_id"),
        F.lit(None).cast("string").alias("source_specimen_id"),
        code.alias("test_code"),
        code.alias("loinc_code"),
        trimmed(known, "DESCRIPTION").alias("test_name"),
        trimmed(known, "VALUE").alias("value"),
        trimmed(known, "UNITS").alias("unit"),
        F.lit(None).cast("string").alias("reference_range"),
        F.lit(None).cast("string").alias("abnormal_flag"),
        F.lit("FINAL").alias("validation_status"),
        column_of(known, "DATE").alias("result_datetime"),
    )
    return shaped


# --- FHIR ------------------------------------------------------------------------------------


def reference_tail(reference: Column) -> Column:
    """Last path part of a reference, closing slashes ignored; null for an empty reference."""
    return F.when(
        F.length(reference) > 0, F.element_at(F.split(F.regexp_replace(reference, "/+$", ""), "/"), -1)
    )


def _first_where(items: Column, test) -> Column:
    return F.get(F.filter(items, test), F.lit(0))


def _number_text(raw: Column) -> Column:
    """JSON number text the way it prints once read: ``13.50`` is ``13.5``, ``13`` stays ``13``."""
    return F.when(raw.rlike(r"[.eE]"), F.coalesce(values.float_text(raw.try_cast("double")), raw)).otherwise(raw)


def lab_resource_predicate() -> Column:
    """Observations with any category coding code equal to ``laboratory`` or ``lab``."""
    codings = F.flatten(F.transform("category", lambda c: F.coalesce(c["coding"], F.array())))
    return (F.col("resourceType") == "Observation") & F.coalesce(
        F.exists(codings, lambda c: c["code"].isin(*LAB_CODES)), F.lit(False)
    )


def normalized_fhir(resources: DataFrame) -> DataFrame:
    """Lab observations among FHIR resource rows in the internal shape; incomplete ones are left out.

    ``resources`` has the columns of :data:`assaylake.sources.extracts.FHIR_RESOURCE`.
    """
    return complete_rows(shaped_fhir(resources))


def shaped_fhir(resources: DataFrame) -> DataFrame:
    """Lab observations among FHIR resource rows in the internal shape, incomplete ones too.

    An empty quantity counts as absent, so the text value is looked at next.
    """
    labs = resources.filter(lab_resource_predicate())
    loinc = _first_where(F.col("code.coding"), lambda c: c["system"].contains("loinc.org"))
    coding = F.coalesce(loinc, F.get(F.col("code.coding"), F.lit(0)))
    code = F.trim(F.coalesce(coding["code"], F.lit("")))
    name = F.trim(
        F.coalesce(F.nullif(coding["display"], F.lit("")), F.nullif(F.col("code.text"), F.lit("")), code)
    )
    quantity = F.col("valueQuantity")
    given = F.coalesce(quantity["value"], quantity["unit"], quantity["code"]).isNotNull()
    value = (
        F.when(given, _number_text(quantity["value"]))
        .when(F.col("valueString").isNotNull(), F.col("valueString"))
        .otherwise(F.col("valueCodeableConcept.text"))
    )
    unit = F.coalesce(F.nullif(quantity["unit"], F.lit("")), quantity["code"])
    range_ = F.get(F.col("referenceRange"), F.lit(0))
    low, high = range_["low"], range_["high"]
    bounds = F.concat_ws(" - ", _number_text(low["value"]), _number_text(high["value"]))
    range_unit = F.coalesce(F.nullif(low["unit"], F.lit("")), F.nullif(high["unit"], F.lit("")))
    range_text = F.coalesce(
        F.nullif(range_["text"], F.lit("")),
        F.when(F.length(bounds) > 0, F.concat_ws(" ", bounds, range_unit)),
    )
    flags = F.flatten(F.transform("interpretation", lambda i: F.coalesce(i["coding"], F.array())))
    flag = _first_where(flags, lambda c: F.length(c["code"]) > 0)["code"]
    shaped = labs.select(
        reference_tail(F.col("subject.reference")).alias("source_patient_id"),
        none_if_blank(F.col("id")).alias("source_observation_id"),
        reference_tail(F.get(F.col("basedOn"), F.lit(0))["reference"]).alias("source_order_id"),
        reference_tail(F.col("specimen.reference")).alias("source_specimen_id"),
        code.alias("test_code"),
        F.when(loinc.isNotNull(), code).alias("loinc_code"),
        name.alias("test_name"),
        value.alias("value"),
        unit.alias("unit"),
        range_text.alias("reference_range"),
        flag.alias("abnormal_flag"),
        F.upper(F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("FINAL"))).alias("validation_status"),
        F.coalesce(F.nullif(F.col("effectiveDateTime"), F.lit("")), F.col("issued")).alias("result_datetime"),
    )
    return shaped


# --- Both ------------------------------------------------------------------------------------

REQUIRED = ["source_patient_id", "source_observation_id", "test_code", "test_name", "value"]


def first_missing() -> Column:
    """The first required part that a shaped row lacks, or ``result_datetime`` when its date cannot be read."""
    cases = [(F.coalesce(F.length(name), F.lit(0)) == 0, name) for name in REQUIRED]
    return values.first_match([*cases, (values.parse_time(F.trim("result_datetime")).isNull(), "result_datetime")], None)


def complete_rows(shaped: DataFrame) -> DataFrame:
    """Rows with every required part and a readable date, the date in event form.

    The date is tested with one cast; its text is built only for the rows that stay.
    """
    return (
        shaped.filter(first_missing().isNull())
        .withColumn("result_datetime", values.event_time_text(F.col("result_datetime")))
        .select(*NORMALIZED_COLUMNS)
    )


def incomplete_rows(shaped: DataFrame) -> DataFrame:
    """The complement, for the reject feed: rows as they are, with the first missing part."""
    return shaped.select(*NORMALIZED_COLUMNS, first_missing().alias("missing")).filter("missing is not null")


def with_stable_ids(normalized: DataFrame) -> DataFrame:
    """Event, order and specimen ids from the source ids, with fallbacks for missing ones."""
    observation = F.concat(F.lit(fv.OBSERVATION_KEY_PREFIX), F.col("source_observation_id"))
    order = ids.order_key(F.col("source_order_id"), observation)
    specimen = ids.specimen_key(F.col("source_specimen_id"), order)
    return normalized.withColumns(
        {
            "event_id": ids.stable_id("EVT", observation),
            "order_id": ids.stable_id("ORD", order),
            "specimen_id": ids.stable_id("SPC", specimen),
        }
    )


def lab_events(normalized: DataFrame, secret: str) -> DataFrame:
    """The 16 public event columns; no source identifier survives."""
    events = (
        with_stable_ids(normalized)
        .withColumns(
            {
                "source_system": F.lit(fv.SOURCE_SYSTEM),
                "origin_source": F.lit(fv.ORIGIN_SOURCE),
                "event_type": F.lit(fv.EVENT_CREATED),
                "patient_id": ids.pseudonym(F.col("source_patient_id"), secret),
            }
        )
        .select(*PUBLIC_EVENT_COLUMNS)
    )
    return assert_no_source_ids(events)
