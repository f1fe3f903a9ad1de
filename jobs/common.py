"""What the jobs share: settings from a file that Spark reads, and logs."""

from __future__ import annotations

import json
import logging

from pyspark.sql import SparkSession


def settings(spark: SparkSession, path: str | None, defaults: dict) -> dict:
    """``defaults`` with what the JSON file at ``path`` sets; a name that is not among them is an error."""
    given = json.loads(spark.read.text(path, wholetext=True).first()[0]) if path else {}
    if unknown := set(given) - set(defaults):
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return defaults | given


def logs() -> None:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
