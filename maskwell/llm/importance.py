"""Importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.llm.common import materialize, only_kept
from maskwell.llm.textvec import blocks, find_words, hash_keys, hash_words, lower_ascii, mix, unit_interval
from maskwell.shipping import map_arrow
from maskwell.sources.tables import read_table

BUCKETS = 1 << 14
#: The target model is fitted on about so many labelled rows at most, those with the smallest hashes.
TARGET_ROWS = 20_000
SEED = 11
#: Correlation of the n-grams of one text. A text repeats its own words, topic and language, so n of its n-grams tell as much as n / (1 + CORRELATION (n - 1))
#: independent ones, and so many times the mean log ratio is its log weight. 0 gives the plain sum, in which what chance did to the model's
#: counts outweighs all else in long texts.
CORRELATION = 0.01
#: One of so many target rows is held out of the fit to calibrate the cut, which lies so many standard deviations below the lowest of them: good rows that
#: nobody labelled reach a little further down. With fewer held-out rows than LEAST_HELD all target rows calibrate.
HELD_OUT, DEVIATIONS, LEAST_HELD = 5, 1.0, 8


def buckets_of(data: np.ndarray, offsets: np.ndarray, n: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of each word and each pair of adjoining words of the whole texts, ASCII letters in lower case."""
    data = lower_ascii(data)
    start, end, row = find_words(data, offsets)
    word = hash_words(data, start, end)
    same = row[:-1] == row[1:]
    pair = mix(word[:-1] * np.uint64(3) + word[1:])[same]
    return (np.concatenate([word, pair]) % np.uint64(n)).astype(np.int64), np.concatenate([row, row[:-1][same]])


def count_ngrams(docs: DataFrame, n: int = BUCKETS) -> DataFrame:
    """bucket, raw, target: n-grams of all rows and of those with ``is_target``. A task sends a row for each bucket, and
    Spark sums them before and after the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for rows, data, offsets in blocks(batches):
            bucket, row = buckets_of(data, offsets, n)
            wanted = np.asarray(rows.column(1).to_pylist(), bool)
            raw += np.bincount(bucket, minlength=n)
            target += np.bincount(bucket[wanted[row]], minlength=n)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])

    out = map_arrow(docs.select("text", "is_target"), run, "bucket long, raw long, target long")
    return out.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: list, n: int = BUCKETS) -> np.ndarray:
    """log(p_target / p_raw) of each bucket, both smoothed by one count in each."""
    raw, target = np.ones(n), np.ones(n)
    for r in counts:
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def score(docs: DataFrame, ratios: np.ndarray, seed: int = SEED, correlation: float = CORRELATION) -> DataFrame:
    """doc_id, text_hash, role, n_ngrams, log_weight (the mean log ratio times the number of independent n-grams) and gumbel_key (that with
    Gumbel noise) of each row of ``docs`` (doc_id, text, role)."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for rows, data, offsets in blocks(batches):
            bucket, row = buckets_of(data, offsets, len(table))
            n = np.bincount(row, minlength=rows.num_rows)
            weight = np.bincount(row, table[bucket], minlength=rows.num_rows) / (1 + correlation * np.maximum(n - 1, 0))
            ids = rows.column(0).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            u = unit_interval(hash_keys(ids, seed))
            yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(n.astype(np.int64)), pa.array(weight), pa.array(weight - np.log(-np.log(u)))], ["doc_id", "text_hash", "role", "n_ngrams", "log_weight", "gumbel_key"])

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "role", "text")
    return map_arrow(named, run, "doc_id long, text_hash long, role int, n_ngrams long, log_weight double, gumbel_key double")


def kth_largest(values: DataFrame, column: str, k: int) -> float:
    """The k-th largest value, exactly: counts over ever narrower ranges, a bounded number of rows each time."""
    lo, hi, n = values.agg(F.min(column), F.max(column), F.count(column)).first()
    if n == 0 or k <= 0:
        return math.inf
    if k >= n:
        return lo
    above, width = 0, 2048
    for _ in range(12):
        if not hi > lo:
            return lo
        step = (hi - lo) / width
        inside = values.filter((F.col(column) >= lo) & (F.col(column) <= hi))
        cut = F.least(F.lit(width - 1), F.floor((F.col(column) - lo) / F.lit(step)))
        found = inside.groupBy(cut.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        for r in sorted(found, key=lambda r: -r["b"]):
            if above + r["n"] >= k:
                lo, hi, n = r["lo"], r["hi"], r["n"]
                break
            above += r["n"]
        if n <= 4096:
            last = values.filter((F.col(column) >= lo) & (F.col(column) <= hi)).select(column).collect()
            return sorted((r[0] for r in last), reverse=True)[k - above - 1]
    return lo


def resample(docs: DataFrame, labels: DataFrame, target_rows: int = TARGET_ROWS, buckets: int = BUCKETS, k: int | None = None, seed: int = SEED, correlation: float = CORRELATION) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text) and mark the ``k`` with the largest weight plus Gumbel noise as kept.

    The target are the rows whose label has quality 1 (a bounded sample of their ids); most of them are fitted on, the others are held out. The raw
    model is that of all rows. By default k is the number of rows whose log weight reaches the cut that the held-out target rows set, so the number kept follows
    the corpus, and its share does not depend on how many labels there are. Noise is drawn from a hash of doc_id: reruns agree.

    A null or empty text has weight 1 (log 0). Rows that tie with the k-th are all kept. Without good labels nothing can be told
    apart and all rows are kept. Rows with the same id and text share their verdict; a null id is an id. Texts are read whole, however long. Other columns of
    ``docs`` and ``labels`` are not read. An empty table gives an empty result.
    """
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_label_id")).distinct()
    first = good.orderBy(F.xxhash64("_label_id", F.lit(seed)), "_label_id").limit(target_rows)
    held = F.pmod(F.xxhash64("_label_id", F.lit(seed + 1)), F.lit(HELD_OUT)) == 0
    # Role 0: neither, 1: fitted on, 2: held out.
    marked = docs.select("doc_id", "text").join(F.broadcast(first), F.col("doc_id") == F.col("_label_id"), "left")
    marked = marked.select("doc_id", "text", F.when(F.col("_label_id").isNull(), 0).when(held, 2).otherwise(1).alias("role"))
    counts = count_ngrams(marked.select("text", (F.col("role") == 1).alias("is_target")), buckets).collect()
    scores = materialize(score(marked, log_ratios(counts, buckets), seed, correlation), "importance")
    if k is None:
        target = scores.filter("role > 0 AND n_ngrams > 0").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.min("log_weight").alias("low"), F.stddev_pop("log_weight").alias("sd"))
        found = {r["role"]: r for r in target.collect()}
        if not found:
            return scores.withColumn("kept", F.lit(True)).drop("role")
        use = [found[2]] if 2 in found and found[2]["n"] >= LEAST_HELD else found.values()
        limit = min(r["low"] - DEVIATIONS * r["sd"] for r in use)
        k = scores.filter(F.col("log_weight") >= F.lit(limit)).count()
    limit = kth_largest(scores, "gumbel_key", k)
    return scores.withColumn("kept", F.col("gumbel_key") >= F.lit(limit)).drop("role")


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`resample` keeps, with all their columns."""
    return only_kept(docs, resample(docs, labels))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight and verdict of every document."""
    out = resample(read_table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_ngrams", "log_weight", "gumbel_key", "kept")
