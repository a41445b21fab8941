"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; what a stage returns is
written as Parquet and read again as the next one's ``docs``. All but the last return the columns of documents, with whatever further columns
the table has, whatever their names but those that begin with ``__mw_``. An empty table passes through every stage as an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from maskwell.llm import importance, mixing, ngram_join, packing, quality_rules
from maskwell.llm.common import materialize
from maskwell.sources.tables import read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects, by themselves or with their host.

    A null or empty text has no words and is rejected; a null source is a host. Rows that repeat an id and text share their verdict and stay as often as
    they are there. Texts are measured whole.
    """
    return quality_rules.filter_documents(docs)


def resample(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws for the target of well-labelled ones.

    A null or empty text has log weight 0. Rows that tie with the last one drawn stay, and so do all rows where no label is good. Repeated rows share their verdict.
    """
    return importance.filter_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id.

    Texts without words and rows without an id stay. Of rows that repeat an id and text one stays, the same in every run.
    """
    return ngram_join.filter_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The taken runs of words as documents: repeated sources occur up to twice, others in part.

    Texts without words are in no run. A null source is a source. Repeated rows are taken each for itself.
    """
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of at most 1024 tokens.

    A null or empty text is the end token alone. Rows that repeat, as runs taken twice do, are pieces each.
    """
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("quality_classifier", resample),
    ("ngram_join", near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL has no seeded noise, MinHash, multinomial draw or tokenizer; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
