"""Counts over match tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwell.operators.native import rendered
from maskwell.plans.policy import RENDERED_ORDER


def rule_counts(matches: DataFrame, *by: str) -> DataFrame:
    """Matches per rule (and the columns in ``by``), those that masking passes over included."""
    return matches.groupBy(*by, "rule", F.coalesce("category", F.lit("secrets")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def report(matches: DataFrame) -> DataFrame:
    """One row: total, counts (map of rule to matches) and categories, rendered and in their fixed order."""
    counts = rule_counts(matches)
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule", "n")))).alias("counts"),
        F.filter(F.array(*[F.lit(c) for c in RENDERED_ORDER]), lambda c: F.array_contains(F.collect_set(rendered(F.col("category"))), c)).alias("categories"),
    )


def warning_counts(residue: DataFrame, column: str = "warnings") -> DataFrame:
    return residue.select(F.explode(column).alias("w")).groupBy(F.col("w.rule_id").alias("rule_id")).agg(F.count(F.lit(1)).alias("n"))
