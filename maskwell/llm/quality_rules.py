"""Host-level quality rules with DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.llm.common import SPACES, materialize, only_kept, words
from maskwell.sources.tables import read_table

#: Limits of the rules, as shares. A row over a firm limit fails by itself; a row over a soft limit fails
#: where its host fails.
SOFT_SYMBOLS, FIRM_SYMBOLS = 0.1, 0.3
SOFT_DUP_LINES, FIRM_DUP_LINES = 0.3, 0.6
SOFT_WORD_CHARS, FIRM_WORD_CHARS = (3.0, 12.0), (2.0, 20.0)
HOST_LIMIT = 0.5


def text_measures(docs: DataFrame) -> DataFrame:
    """Add the base counts of each whole text to ``docs``: n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words (all long). A null or empty text has zeros.

    Repeated windows: the three words of each window are hashed, hash and position packed into one long,
    and the longs sorted as primitives; neighbours with equal hashes are compared again as words, so a
    collision of hashes changes nothing. The cost is that of a sort of the text's own words.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("_w", words(F.col("text")))
    out = out.withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    out = out.select(
        *docs.columns,
        "_w",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.length(F.bin(F.size("_w"))).alias("_bits"),
    )
    keys = F.expr(
        "CASE WHEN n_words < 3 THEN CAST(array() AS array<bigint>) ELSE transform(sequence(0, CAST(n_words AS int) - 3), "
        "i -> coalesce(shiftleft(xxhash64(_w[i], _w[i + 1], _w[i + 2]), _bits) | CAST(i AS bigint), 0L)) END"
    )
    out = out.withColumn("_k", keys).withColumn("_s", F.sort_array("_k"))
    alike = F.expr(
        "filter(_s, (x, i) -> coalesce(shiftright(x, _bits) = shiftright(get(_s, i - 1), _bits), false)"
        " OR coalesce(shiftright(x, _bits) = shiftright(get(_s, i + 1), _bits), false))"
    )
    out = out.withColumn("_c", alike)
    spelled = F.expr(
        "array_sort(transform(transform(_c, x -> CAST(x & (shiftleft(1L, _bits) - 1) AS int)),"
        " p -> struct(concat_ws(' ', _w[p], _w[p + 1], _w[p + 2]) AS g, p AS p)))"
    )
    out = out.withColumn("_e", spelled)
    at = F.expr("array_sort(transform(filter(_e, (x, i) -> coalesce(x.g = get(_e, i - 1).g, false) OR coalesce(x.g = get(_e, i + 1).g, false)), x -> x.p))")
    out = out.withColumn("_p", at)
    covered = F.expr("aggregate(transform(_p, (p, i) -> coalesce(least(3, get(_p, i + 1) - p), 3)), 0, (a, x) -> a + x)")
    return out.withColumn("n_repeat_words", covered.cast("long")).drop("_w", "_lines", "_bits", "_k", "_s", "_c", "_e", "_p")


def rule_failures(measured: DataFrame) -> DataFrame:
    """Add base_failed, firm_failed and soft_failed (which holds the other two) from the counts."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    mean = F.col("word_chars") / n
    symbols, lines = F.col("n_symbols") / n, F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))

    def over(limit_symbols, limit_lines, span):
        return (symbols > limit_symbols) | (lines > limit_lines) | (mean < span[0]) | (mean > span[1])

    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = measured.withColumn("base_failed", base)
    out = out.withColumn("firm_failed", F.col("base_failed") | over(FIRM_SYMBOLS, FIRM_DUP_LINES, FIRM_WORD_CHARS))
    return out.withColumn("soft_failed", F.col("firm_failed") | over(SOFT_SYMBOLS, SOFT_DUP_LINES, SOFT_WORD_CHARS))


def beta_prior(mean: float | None, variance: float | None) -> tuple[float, float]:
    """The beta distribution with these moments; the uniform one where they fit none."""
    if mean is None or variance is None or not 0 < mean < 1 or not 0 < variance < mean * (1 - mean):
        return 1.0, 1.0
    strength = mean * (1 - mean) / variance - 1
    return mean * strength, (1 - mean) * strength


def host_verdicts(failures: DataFrame, host: str = "host", limit: float = HOST_LIMIT) -> DataFrame:
    """One row per host: rows, failed, its failure rate shrunk toward the prior of all hosts, and ``host_bad``.

    The prior is the beta distribution whose mean and variance are those of the hosts' raw rates. A null
    host is a host. Rows are counted map-side first, so a hot host costs one partial row per task.
    """
    counts = failures.groupBy(host).agg(F.count(F.lit(1)).alias("host_rows"), F.sum(F.col("soft_failed").cast("long")).alias("host_failed"))
    moments = counts.agg(F.avg(F.col("host_failed") / F.col("host_rows")).alias("m"), F.var_pop(F.col("host_failed") / F.col("host_rows")).alias("v")).first()
    a, b = beta_prior(moments["m"], moments["v"])
    rate = (F.col("host_failed") + F.lit(a)) / (F.col("host_rows") + F.lit(a + b))
    return counts.withColumn("host_rate", rate).withColumn("host_bad", F.col("host_rate") > F.lit(limit))


def judge(docs: DataFrame, host: str = "source") -> DataFrame:
    """Counts, failures and the verdict ``kept`` for each row of ``docs`` (doc_id, text and the host column).

    A row is kept unless it fails a base or firm rule, or fails a soft rule on a host whose shrunk
    failure rate is over the limit. Counts are written once without the text; hosts are summed from that table
    and their verdicts joined back to it.

    A null or empty text has zero counts and fails; a null host is a host and a null id an id. Repeated rows are judged alike and count each for their host. A rate
    that ties with the limit is not over it. Very long texts cost a sort of their own words, in one row. Other columns, whatever their names, are not read.
    An empty table gives an empty result.
    """
    base = docs.select("doc_id", F.col(host).alias("host"), "text", F.xxhash64("text").alias("text_hash"))
    failures = materialize(rule_failures(text_measures(base)).drop("text"), "rule_failures")
    hosts = host_verdicts(failures).select(F.col("host").alias("_h"), "host_rate", "host_bad")
    out = failures.join(hosts, F.col("host").eqNullSafe(F.col("_h"))).drop("_h")
    return out.withColumn("kept", ~F.col("firm_failed") & ~(F.col("soft_failed") & F.col("host_bad")))


def filter_documents(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with all their columns."""
    return only_kept(docs, judge(docs, host))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every document."""
    judged = judge(read_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_SQL = r"""
WITH d AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS l
  FROM documents),
g AS (
  SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS t
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) >= 3)),
r AS (
  SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS q
  FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, t) AS n FROM g) WHERE n >= 2),
c AS (SELECT doc_id, CAST(sum(coalesce(least(3, q - p), 3)) AS BIGINT) AS n_repeat_words FROM r GROUP BY doc_id),
m AS (
  SELECT d.doc_id, host, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) AS BIGINT) AS n_lines,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN c ON d.doc_id = c.doc_id),
s AS (
  SELECT *, n_symbols / greatest(n_words, 1) AS sy, n_dup_lines / greatest(n_lines, 1) AS du, word_chars / greatest(n_words, 1) AS me,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
f AS (
  SELECT *, base_failed OR sy > 0.3 OR du > 0.6 OR me < 2.0 OR me > 20.0 AS firm,
         base_failed OR sy > 0.1 OR du > 0.3 OR me < 3.0 OR me > 12.0 AS soft FROM s),
h AS (SELECT host, count(*) AS n, count(*) FILTER (WHERE soft) AS k FROM f GROUP BY host),
p AS (SELECT avg(k / n) AS m, var_pop(k / n) AS v FROM h),
a AS (
  SELECT CASE WHEN m > 0 AND m < 1 AND v > 0 AND v < m * (1 - m) THEN m * (m * (1 - m) / v - 1) ELSE 1.0 END AS a,
         CASE WHEN m > 0 AND m < 1 AND v > 0 AND v < m * (1 - m) THEN (1 - m) * (m * (1 - m) / v - 1) ELSE 1.0 END AS b FROM p),
b AS (SELECT host, (k + a) / (n + a + b) > 0.5 AS bad FROM h, a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT firm AND NOT (soft AND bad) AS kept
FROM f JOIN b ON f.host IS NOT DISTINCT FROM b.host
"""

SQL = {"op1_quality_rules": _SQL}
