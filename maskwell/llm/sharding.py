"""Proportional stratified interleaving of documents into shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskwell.llm.common import materialize, pieces_of, ranked
from maskwell.sources.tables import read_table


def interleave(rows: DataFrame, n_shards: int, stratum: str = "source", ties: tuple[str, ...] = ("doc_id",), seed: str = "interleave") -> DataFrame:
    """Deal rows into ``n_shards`` shards that all have the mixture of the whole table.

    Rows of a stratum are shuffled by a seeded hash of the ``ties`` columns and ranked; row r of n gets the
    fractional rank (2r+1)/2n. All rows are then ordered by fractional rank and cut into ``n_shards`` runs
    whose row counts differ by at most one, so a stratum's share of a shard is off by at most one row or so.
    Adds ``shard`` (int) and ``slot`` (long, gapless from 0 in a shard).

    Nulls: a null stratum is a stratum of its own. Ties: rows equal in all ``ties`` columns are
    interchangeable and keep distinct slots. An empty table gives an empty result. Text is never shuffled
    unless the caller leaves it in ``rows``. Columns of ``rows`` that are called like those used on the way (rank, group_rows, _hash and others) come back
    as they were; a column shard or slot is refused.
    """
    if taken := {"shard", "slot"} & set(rows.columns):
        raise ValueError(f"rows have a column {sorted(taken)[0]!r} already; rename it")
    own = {c: f"__mw_{i}" for i, c in enumerate(rows.columns)}
    out = _interleave(rows.withColumnsRenamed(own), n_shards, own[stratum], tuple(own[c] for c in ties), seed)
    return out.withColumnsRenamed({v: k for k, v in own.items()})


def _interleave(rows: DataFrame, n_shards: int, stratum: str, ties: tuple[str, ...], seed: str) -> DataFrame:
    key = F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in ties]))
    rows = rows.withColumn("_hash", key)
    n = rows.count()
    parts = pieces_of(n)
    placed = ranked(rows, stratum, "_hash", list(ties), n)
    placed = placed.withColumn("_f", (2 * F.col("rank") + 1) / (2 * F.col("group_rows")))
    placed = placed.withColumn("_part", F.floor(F.col("_f") * parts).cast("long"))
    placed = materialize(placed, "fractional_ranks")
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    # At most 65,536 rows, whatever the input: see pieces_of.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(F.col("_f"), F.col(stratum).asc_nulls_last(), F.col("_hash"), *ties)
    at = F.col("_before") + F.row_number().over(inside) - 1
    out = placed.join(F.broadcast(offsets), F.col("_part") == F.col("_p")).withColumn("_at", at)
    shard = F.expr(f"(_at * {n_shards}) div {max(n, 1)}")
    slot = F.expr(f"_at - (shard * {n} + {n_shards - 1}) div {n_shards}")
    out = out.withColumn("shard", shard.cast("int")).withColumn("slot", slot.cast("long"))
    return out.drop("_hash", "_f", "_part", "_p", "_before", "_at", "rank", "group_rows")


def describe_documents(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in UTF-8 bytes plus one and crc32 of the text; a null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", "source", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 under the law ``rows``. Copies of a text are rows like any others."""
    docs = materialize(describe_documents(read_table(spark, sf_dir, "documents")), "sizes")
    out = interleave(docs, 8, ties=("doc_id", "text_crc32"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: DuckDB has no crc32, so the SQL works it out byte by byte from a table of 256 steps.
_SQL = """
WITH t AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(CAST(n AS BIGINT), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
         lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS steps),
h AS (SELECT doc_id, source, strlen(coalesce(text, '')) + 1 AS size, string_split(hex(encode(coalesce(text, ''))), '') AS x FROM documents),
b AS (
  SELECT doc_id, source, size, CASE WHEN size = 1 THEN CAST([] AS BIGINT[]) ELSE list_transform(range(1, size), lambda i:
         CAST((instr('0123456789ABCDEF', x[2 * i - 1]) - 1) * 16 + instr('0123456789ABCDEF', x[2 * i]) - 1 AS BIGINT)) END AS bytes FROM h),
c AS (
  SELECT doc_id, source, CAST(size AS BIGINT) AS size,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda a, b: xor(a >> 8, steps[(xor(a, b) & 255) + 1])), CAST(4294967295 AS BIGINT)) AS text_crc32 FROM b, t),
m AS (SELECT *, md5('interleave|' || coalesce(CAST(doc_id AS VARCHAR), '~') || '|' || CAST(text_crc32 AS VARCHAR)) AS name FROM c),
r AS (
  SELECT *, (2 * (row_number() OVER (PARTITION BY source ORDER BY name, doc_id, text_crc32) - 1) + 1) / CAST(2 * count(*) OVER (PARTITION BY source) AS DOUBLE) AS f,
         count(*) OVER () AS n FROM m),
o AS (SELECT *, row_number() OVER (ORDER BY f, source NULLS LAST, name, doc_id, text_crc32) - 1 AS at_row FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(at_row * 8 // n AS INTEGER) AS shard, CAST(at_row - ((at_row * 8 // n) * n + 7) // 8 AS BIGINT) AS slot, CAST(NULL AS DOUBLE) AS grown_shard FROM o
"""

SQL = {"op6_sharding": _SQL}
