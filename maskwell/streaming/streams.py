"""The same operators on streams, and two that need state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.functions.engine import Anonymizer
from maskwell.operators.arrow import detector, masker
from maskwell.plans.policy import Policy
from maskwell.shipping import ship


def mask_stream(stream: DataFrame, text: str, policy: Policy) -> DataFrame:
    """A stream with one column masked: stateless, so any output mode does."""
    return stream.withColumn(text, masker(stream.sparkSession, policy)(F.col(text)))


def hit_rates(stream: DataFrame, text: str, time: str, policy: Policy, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Matches per rule and tumbling window, with a watermark for late rows."""
    found = detector(stream.sparkSession, policy)(F.col(text))
    matches = stream.withWatermark(time, late).select(time, F.explode(found).alias("m"))
    return matches.groupBy(F.window(time, window), F.col("m.rule").alias("rule")).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), "rule", "n")


def anonymize_session_stream(stream: DataFrame, session: str, order: str, text: str) -> DataFrame:
    """Code anonymized with names kept per session in the stream's state, so a later batch uses the names of an earlier one."""
    ship(stream.sparkSession)
    key_type = stream.schema[session].dataType.simpleString()
    order_type = stream.schema[order].dataType.simpleString()

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        names = Anonymizer(json.loads(state.get[0]) if state.exists else {})
        rows = pd.concat(frames).sort_values(order, kind="stable")
        rows[text] = [None if t is None else names.text(t) for t in rows[text]]
        state.update((json.dumps(names.names),))
        yield rows[[session, order, text]]

    return stream.select(session, order, text).groupBy(session).applyInPandasWithState(run, f"`{session}` {key_type}, `{order}` {order_type}, `{text}` string", "names string", "append", "NoTimeout")


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into Parquet and return a reader of it."""
    spark: SparkSession = stream.sparkSession
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_latest(stream: DataFrame, keys: list[str], out: str, checkpoint: str) -> DataFrame:
    """Run an aggregated stream over what is there now and return its last row for each key, those of windows still open included.

    Each batch's updates are written under the batch's number, so a batch that is run again replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    rows = stream.sparkSession.read.schema(stream.schema.add("batch", "long")).parquet(out)
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(*(F.max_by(c, "batch").alias(c) for c in rest))
