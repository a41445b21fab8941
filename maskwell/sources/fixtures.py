"""Corpora of cases that say whether a rule fires on an input, from YAML."""

from __future__ import annotations

from importlib import resources

from pyspark.sql import DataFrame, SparkSession

from maskwell.errors import ActionableError
from maskwell.plans.policy import LEVELS

SCHEMA = "name string, input string, rule string, expect string, level string, reason string, source string"


def built_in_text() -> str:
    """The YAML of the package's own cases: for each rule an input on which it fires and one on which it does not."""
    return resources.files("maskwell.sources").joinpath("cases.yaml").read_text("utf-8")


def built_in_cases(spark: SparkSession) -> DataFrame:
    return load_cases(spark, built_in_text())


def load_cases(spark: SparkSession, text: str, key: str | None = None) -> DataFrame:
    """The cases of a YAML text (a list, or a mapping with the list under ``key`` or as its only list). The level defaults to standard."""
    import yaml

    data = yaml.safe_load(text)
    if isinstance(data, dict):
        data = data[key] if key else next(v for v in data.values() if isinstance(v, list))
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    rows = []
    for case in data or []:
        row = {n: case.get(n) for n in names} | {"level": case.get("level") or "standard"}
        if row["level"] not in LEVELS or row["expect"] not in ("match", "no_match"):
            raise ActionableError(f"case {row['name']!r} is invalid", "its level or expectation is unknown", "maskwell.sources.fixtures.load_cases", "cases were loaded", "no case was loaded", "use a known level and match or no_match")
        rows.append(tuple(row[n] for n in names))
    return spark.createDataFrame(rows, SCHEMA)
