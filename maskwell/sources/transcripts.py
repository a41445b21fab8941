"""Transcripts: files of JSON lines in, masked files of JSON lines out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.operators.arrow import json_masker, _udf
from maskwell.functions import documents, engine
from maskwell.plans.policy import Policy


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (increasing inside a file) and line (without its carriage return) of each line."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line_no"), without_return(F.col("value")).alias("line"))


def without_return(line: Column) -> Column:
    return F.regexp_replace(line, r"\r(?![\s\S])", "")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), F.col("value").alias("document"))


def mask_lines(lines: DataFrame, policy: Policy, most: int | None = None) -> DataFrame:
    """The lines with every JSON string masked, and ``too_long``: whether the line's file has a line of the largest size or more. Such a
    file is not rewritten at all: its lines come back as they are, for the caller to reject."""
    most = policy.scanner.most if most is None else most
    long_files = lines.filter(F.octet_length("line") >= most).select(F.col("file").alias("_f")).distinct()
    marked = lines.join(long_files, F.col("file") == F.col("_f"), "left").withColumn("too_long", F.col("_f").isNotNull()).drop("_f")
    masked = json_masker(lines.sparkSession, policy)(F.when(~F.col("too_long"), F.col("line")))
    return marked.withColumn("line", F.coalesce(masked, F.col("line")))


def mask_documents(docs: DataFrame, policy: Policy) -> DataFrame:
    mask = _udf(docs.sparkSession, "string", lambda t: None if t is None else documents.rewrite_document(t, lambda s: engine.mask_text(s, policy, warn=False).text))
    return docs.withColumn("document", mask(F.col("document")))


def write_lines(lines: DataFrame, path: str) -> None:
    """Text files with the lines in order by file and line, inside each part and from part to part, so that a long transcript is no single task; every line ends with a newline."""
    lines.repartitionByRange("file", "line_no").sortWithinPartitions("file", "line_no").select("line").write.option("lineSep", "\n").text(path)
