"""Session metadata as nested structs."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwell.operators.arrow import metadata_masker
from maskwell.plans.policy import Policy

_S = T.StringType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])


#: The fields that masking reads; git fields are nullable, sub-agents pass through.
METADATA = _struct(
    source=_struct(file_path=_S), cwd=_S, host_slug=_S, git=_struct(remote=_S, branch=_S, worktree=_S, tracking=_S), project=_struct(file_path=_S, name=_S),
    diagnostics=_struct(warnings=T.ArrayType(_struct(error_type=_S, location=_S, message=_S, remediation=_S))), subagents=T.ArrayType(_struct(id=_S)),
)


def mask_metadata(spark: SparkSession, policy: Policy, meta: Column) -> Column:
    """The struct with its sensitive fields masked; null stays null."""
    as_json = F.to_json(meta, {"ignoreNullFields": "false"})
    return F.when(meta.isNotNull(), F.from_json(metadata_masker(spark, policy)(as_json), METADATA))
