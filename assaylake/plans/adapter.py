"""A clinical extract to pseudonymised events.

``ASSAYLAKE_SECRET=... python -m assaylake.plans.adapter --input extract --output events``
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from ..operators import extracts
from ..session import configure
from ..sources.extracts import read_normalized
from ..sources.layers import Written, write_events_jsonl


def run_adapter(spark: SparkSession, folder: str, output: str, secret: str, *, quoted_newlines: bool = False) -> Written:
    """Read the extract, pseudonymise it and write JSON lines."""
    rows = read_normalized(spark, folder, quoted_newlines=quoted_newlines)
    return write_events_jsonl(extracts.lab_events(rows, secret), output)


def main() -> None:
    parser = argparse.ArgumentParser(description="Turn a clinical extract into lab events.")
    parser.add_argument("--input", required=True, help="folder with the unpacked CSV or FHIR files")
    parser.add_argument("--output", required=True)
    parser.add_argument("--quoted-newlines", action="store_true")
    args = parser.parse_args()
    spark = configure(SparkSession.builder.appName("lab adapter").getOrCreate())
    try:
        written = run_adapter(
            spark, args.input, args.output, os.environ.get("ASSAYLAKE_SECRET", ""), quoted_newlines=args.quoted_newlines
        )
        print(f"{written.records} events in {written.path}")
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
