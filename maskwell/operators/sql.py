"""The engine as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwell.functions import engine
from maskwell.operators import arrow
from maskwell.plans.policy import Policy
from maskwell.shipping import ship


def register(spark: SparkSession, policy: Policy, prefix: str = "mw_") -> list[str]:
    """mw_mask(text), mw_matches(text), mw_residue(text), mw_entropy(text), mw_json(text), mw_title(text), mw_code_blocks(text): the names registered."""
    made = {
        "mask": arrow.masker(spark, policy), "matches": arrow.detector(spark, policy), "residue": arrow.residue_scanner(spark), "entropy": arrow.entropy_masker(spark),
        "json": arrow.json_masker(spark, policy), "title": arrow.title_maker(spark), "code_blocks": arrow.code_extractor(spark),
    }
    for name, function in made.items():
        spark.udf.register(prefix + name, function)
    return [prefix + name for name in made]


def register_table_function(spark: SparkSession, policy: Policy, name: str = "mw_detect") -> str:
    """A table function: ``SELECT * FROM mw_detect('text')``, or LATERAL over a table, gives a row per match with its rule, category, byte_offset and byte_length."""
    ship(spark)
    rules = policy.active_rules

    class Detect:
        def eval(self, text: str):
            for m in engine.detect(text or "", rules):
                yield m.rule.id, m.rule.category, m.offset, m.length

    spark.udtf.register(name, F.udtf(Detect, returnType="rule string, category string, byte_offset bigint, byte_length bigint"))
    return name


def mask_nested(spark: SparkSession, policy: Policy, value: Column, data_type: T.DataType) -> Column:
    """A struct, array or map with every string inside masked; keys and other values stay. Null stays null."""
    as_json = F.to_json(value, {"ignoreNullFields": "false"})
    return F.when(value.isNotNull(), F.from_json(arrow.json_masker(spark, policy)(as_json), data_type))
