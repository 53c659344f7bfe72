"""Clinical extracts: a pair of CSV files, or FHIR JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators import extracts
from .files import exists, find_files, has_files

FHIR_RESOURCE = """
    resourceType string, id string, status string, effectiveDateTime string, issued string,
    category array<struct<coding: array<struct<code: string>>>>,
    code struct<text: string, coding: array<struct<system: string, code: string, display: string>>>,
    subject struct<reference: string>,
    basedOn array<struct<reference: string>>,
    specimen struct<reference: string>,
    valueQuantity struct<value: string, unit: string, code: string>,
    valueString string,
    valueCodeableConcept struct<text: string>,
    referenceRange array<struct<text: string, low: struct<value: string, unit: string>,
                                high: struct<value: string, unit: string>>>,
    interpretation array<struct<coding: array<struct<code: string>>>>"""
def find_csv_pair(spark: SparkSession, folder: str) -> tuple[str, str] | None:
    """The first ``patients.csv`` with an ``observations.csv`` beside it."""
    for patients in find_files(spark, folder, "patients.csv"):
        observations = patients.rsplit("/", 1)[0] + "/observations.csv"
        if exists(spark, observations):
            return patients, observations
    return None


def read_csv(spark: SparkSession, path: str, *, quoted_newlines: bool = False) -> DataFrame:
    """All columns as text. Files with line breaks inside quotes need ``quoted_newlines``.

    Such files cannot be split, so it is off unless asked for.
    """
    return (
        spark.read.option("header", "true")
        .option("escape", '"')
        .option("multiLine", str(quoted_newlines).lower())
        .csv(path)
    )


def read_fhir(spark: SparkSession, folder: str) -> DataFrame:
    """FHIR resources, one per row: the entries of bundles, and bare resources.

    Only the fields the mapping needs are parsed. An unreadable file gives no resource.
    """
    resource = T.StructType.fromDDL(FHIR_RESOURCE)
    entries = T.ArrayType(T.StructType([T.StructField("resource", resource)]))
    documents = (
        spark.read.schema(T.StructType([*resource.fields, T.StructField("entry", entries)]))
        .option("multiLine", "true")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.json")
        .json(folder)
    )
    bare = F.array(F.struct(*resource.names))
    in_bundle = F.filter(F.transform("entry", lambda e: e["resource"]), lambda r: r.isNotNull())
    resources = F.when(F.col("resourceType") == "Bundle", in_bundle).when(F.col("resourceType").isNotNull(), bare)
    return documents.select(F.explode(resources).alias("r")).select("r.*")


def read_normalized(spark: SparkSession, folder: str, *, quoted_newlines: bool = False) -> DataFrame:
    """Normalised lab results of an unpacked extract: the CSV pair when there is one, else FHIR."""
    pair = find_csv_pair(spark, folder)
    if pair:
        patients, observations = (read_csv(spark, p, quoted_newlines=quoted_newlines) for p in pair)
        return extracts.normalized_csv(observations, patients)
    if not has_files(spark, folder, "*.json"):
        raise FileNotFoundError(f"no CSV pair and no FHIR JSON under {folder}")
    return extracts.normalized_fhir(read_fhir(spark, folder))
