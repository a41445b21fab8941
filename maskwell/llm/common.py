"""Shared pieces of the corpus operators: scratch tables, word expressions, distributed ranks.

Conventions that every operator keeps:

* a word is a maximal run of characters other than space and U+0009..U+000D; a null text has none;
* an operator selects the columns it needs by name and ignores all others, whatever they are called;
* intermediate tables go to the folder of ``spark.checkpoint.dir``, which all executors share.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[ \t\n\x0B\f\r]+"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    Read from the session; only a local master may fall back to a folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="maskwell-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _run_root(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/maskwell/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once to the shared folder and return a reader of it: lineage ends here, and a
    lost executor costs a re-read instead of a recomputation."""
    spark = df.sparkSession
    path = f"{_run_root(spark)}/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that no plan reads any more."""
    for table in tables:
        _delete(table.sparkSession, table._scratch_path.rpartition("/")[0])


def release(spark: SparkSession) -> None:
    """Free the shuffle files of plans that are done. Spark does so when the driver happens to collect its garbage, which with few objects and large
    shuffles may be never; an operator of many rounds asks for it between them."""
    gc.collect()
    spark._jvm.System.gc()


def cleanup(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; call it when the results are written."""
    _delete(spark, _run_root(spark))


@contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows for what is executed inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Size of the filter that stands for a set of keys (8 MB).
FILTER_BITS = 26


def maybe_in(df: DataFrame, key: Column, keys: DataFrame, keys_column: Column, bits: int = FILTER_BITS) -> DataFrame:
    """``df`` with a boolean ``__mw_maybe``: may the row's key be among ``keys``?

    A filter of ``1 << bits`` bits, so of a fixed size, is broadcast in place of the keys, and no row of ``df`` is shuffled. All rows whose
    key is there are marked, and some others; a join on the key tells them apart. Keys are longs or hashes of what they are, and not null.
    """
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    maps = keys.select(at(keys_column).alias("h")).groupBy(F.shiftright("h", 15).alias("__mw_part"))
    maps = maps.agg(F.bitmap_construct_agg(F.col("h").bitwiseAND(F.lit(32767))).alias("__mw_bits"))
    h = at(key)
    byte = F.conv(F.hex(F.expr("substring(__mw_bits, CAST((__mw_at div 8) + 1 AS int), 1)")), 16, 10).cast("int")
    marked = df.withColumn("__mw_at", h.bitwiseAND(F.lit(32767))).join(F.broadcast(maps), F.shiftright(h, 15) == F.col("__mw_part"), "left")
    hit = F.expr("shiftright(__mw_byte, CAST(__mw_at % 8 AS int)) & 1") == 1
    out = marked.withColumn("__mw_byte", byte).withColumn("__mw_maybe", F.coalesce(hit, F.lit(False)))
    return out.drop("__mw_at", "__mw_part", "__mw_bits", "__mw_byte")


def only_kept(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) that ``verdicts`` (doc_id, text_hash, kept) keeps, with all their columns; of verdicts on one id and text one that keeps it
    is enough.

    The texts are shuffled once. Marking the rows that may be rejected with :func:`maybe_in` and joining only those shuffles a ninth of that, but where it was tried the executors'
    memory rose by 300 MB.
    """
    kept = verdicts.filter("kept").select(F.col("doc_id").alias("__mw_id"), F.col("text_hash").alias("__mw_hash")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__mw_id")) & (F.xxhash64("text") == F.col("__mw_hash")), "left_semi")


def words(text: Column) -> Column:
    """The words of a text, in order; an empty array for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def pieces_of(n_rows: int, smallest: int = 256, most: int = 65536) -> int:
    """Into how many parts to cut ``n_rows`` so that each part is small and the list of parts is bounded."""
    return max(1, min(most, -(-n_rows // smallest)))


def fraction_bucket(hex_hash: Column, n: int) -> Column:
    """Bucket 0..n-1 of a hexadecimal hash, increasing in the hash."""
    high = F.conv(F.substring(hex_hash, 1, 8), 16, 10).cast("long")
    return F.floor(high * F.lit(n) / F.lit(1 << 32)).cast("long")


def ranked(df: DataFrame, group: str, hash_col: str, ties: list[str], n_rows: int, size_col: str | None = None) -> DataFrame:
    """Add ``rank`` (from 0), ``group_rows`` and, with ``size_col``, ``begin`` and ``group_size`` to each row of a group
    in the order of a hexadecimal hash.

    A group is cut into buckets of the hash, so a group with a third of all rows is spread over all
    tasks: rows are ranked inside a bucket, and what lies before a bucket comes from the small table of
    bucket counts.
    """
    n = pieces_of(n_rows)
    cut = df.withColumn("_bucket", fraction_bucket(F.col(hash_col), n))
    aggs = [F.count(F.lit(1)).alias("_rows")]
    if size_col:
        aggs.append(F.sum(size_col).alias("_size"))
    counts = cut.groupBy(group, "_bucket").agg(*aggs)
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(group)
    cols = [F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_rows").over(whole).alias("group_rows")]
    if size_col:
        cols += [F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_begin"), F.sum("_size").over(whole).alias("group_size")]
    offsets = counts.select(F.col(group).alias("_g"), F.col("_bucket").alias("_b"), *cols)
    inside = Window.partitionBy(group, "_bucket").orderBy(hash_col, *ties)
    rows = cut.withColumn("_rn", F.row_number().over(inside))
    if size_col:
        running = inside.rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("_run", F.coalesce(F.sum(size_col).over(running), F.lit(0)))
    out = rows.join(offsets, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_bucket") == F.col("_b")))
    out = out.withColumn("rank", F.col("_before") + F.col("_rn") - 1)
    if size_col:
        out = out.withColumn("begin", F.col("_begin") + F.col("_run"))
    return out.drop("_bucket", "_rn", "_run", "_g", "_b", "_before", "_begin")
