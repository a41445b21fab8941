"""Similarity join of texts on word n-grams: MinHash bands, then verification on full n-gram sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskwell.llm.common import SPACES, discard, materialize, maybe_in
from maskwell.llm.components import components
from maskwell.llm.textvec import blocks, find_words, hash_words, mix
from maskwell.shipping import map_arrow
from maskwell.sources.tables import read_table

THRESHOLD, N_WORDS = 0.8, 5
#: Share of the pairs at the threshold that the bands find; more similar pairs are found more surely.
RECALL = 0.9999
MOST_HASHES = 96
#: Members of a bucket that meet in one step; a larger bucket is cut into chunks and every pair of chunks meets.
CHUNK = 256
_U = np.uint64


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band, so the fewest false candidates, whose bands reach the recall within ``most`` hashes."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - threshold)), 1)
    for rows in range(2, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = N_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the distinct runs of n words of each text, sorted by row and hash. A text of 1 to n-1 words has
    one run, of all its words; a text without words has none."""
    start, end, row = find_words(data, offsets)
    word = hash_words(data, start, end)
    rows = len(offsets) - 1
    count = np.bincount(row, minlength=rows)
    first = np.cumsum(count) - count
    at = np.arange(len(word)) - first[row] if len(word) else row
    lead = at <= np.maximum(count[row] - n, 0)
    begin = np.flatnonzero(lead)
    h = np.zeros(len(begin), np.uint64)
    length = np.minimum(count[row[begin]], n)
    for j in range(n):
        there = j < length
        h[there] = h[there] * _U(0x9E3779B97F4A7C15) + word[begin[there] + j]
    h = mix(h + length.astype(np.uint64))
    owner = row[begin]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], owner[new]


def fingerprints(h: np.ndarray, some: np.ndarray, first: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free sums over the n-gram hashes of each row; ``some`` are the rows with any, ``first`` where theirs begin."""
    out = np.zeros((2, n_rows), np.uint64)
    if len(some):
        out[0, some] = np.add.reduceat(mix(h), first)
        out[1, some] = np.add.reduceat(mix(h ^ _U(0x5DEECE66D)), first)
    return out[0].view(np.int64), out[1].view(np.int64)


def signatures(docs: DataFrame, bands: int, rows: int, n: int = N_WORDS, seed: int = 1) -> DataFrame:
    """doc_id, text_hash, low and high (a fingerprint of the set of n-grams), n_grams and bands (a hash of each band) of each row."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(0, 1 << 63, bands * rows, dtype=np.int64).view(np.uint64) * _U(2) + _U(1)
    terms = rng.integers(0, 1 << 63, bands * rows, dtype=np.int64).view(np.uint64) * _U(2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in blocks(batches):
            h, owner = shingles(data, offsets, n)
            count = np.bincount(owner, minlength=batch.num_rows)
            some = np.flatnonzero(count)
            first = (np.cumsum(count) - count)[some]
            keys = np.zeros((batch.num_rows, bands), np.uint64)
            low, high = fingerprints(h, some, first, batch.num_rows)
            if len(some):
                for b in range(bands):
                    key = np.full(len(some), b + 1, np.uint64)
                    for k in range(b * rows, (b + 1) * rows):
                        key = mix(key) + np.minimum.reduceat(h * factors[k] + terms[k], first)
                    keys[some, b] = mix(key)
            flat = pa.array(keys.view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * bands), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(low), pa.array(high), pa.array(count.astype(np.int64)), lists], ["doc_id", "text_hash", "low", "high", "n_grams", "bands"])

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return map_arrow(named, run, "doc_id long, text_hash long, low long, high long, n_grams long, bands array<long>")


def gram_sets(docs: DataFrame, n: int = N_WORDS) -> DataFrame:
    """low, high, n_grams (the fingerprint) and grams (the sorted distinct n-gram hashes, as bytes) of each text with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in blocks(batches):
            h, owner = shingles(data, offsets, n)
            count = np.bincount(owner, minlength=batch.num_rows)
            some = np.flatnonzero(count)
            first = (np.cumsum(count) - count)[some]
            low, high = fingerprints(h, some, first, batch.num_rows)
            raw = [h[b : b + c].tobytes() for b, c in zip(first, count[some], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(low[some]), pa.array(high[some]), pa.array(count[some].astype(np.int64)), pa.array(raw, pa.binary())], ["low", "high", "n_grams", "grams"])

    return map_arrow(docs.select("text"), run, "low long, high long, n_grams long, grams binary")


def runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """(rows, bounds) of the runs of rows with equal keys in sorted input; no run is split."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        columns = [table.column(k).to_numpy() for k in keys]
        new = np.zeros(table.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        cuts = np.flatnonzero(new)
        if not len(cuts):
            rest = table
            continue
        done = table.slice(0, int(cuts[-1])).combine_chunks()
        rest = table.slice(int(cuts[-1]))
        yield done.to_batches()[0], [0, *cuts.tolist()]
    if rest is not None and rest.num_rows:
        done = rest.combine_chunks()
        yield done.to_batches()[0], [0, done.num_rows]


def _band_matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("bands").flatten().to_numpy().reshape(batch.num_rows, -1)


def _new_pairs(bands: np.ndarray, band: int, side: np.ndarray, i: int, j: int) -> np.ndarray:
    """Which pairs of members meet in this band first, and here: across the two chunks, or within the one."""
    fresh = np.ones((len(bands), len(bands)), bool)
    for earlier in range(band):
        fresh &= bands[:, earlier][:, None] != bands[:, earlier][None, :]
    if i != j:
        fresh &= side[:, None] != side[None, :]
    np.fill_diagonal(fresh, False)
    return fresh


_PLACE = ("key", "band", "i", "j")
_FINGERPRINT = ("low", "high", "n_grams")
_CARRIED = ("doc", *_FINGERPRINT, "bands", "copies")


def meetings(reps: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """key, band, i, j, chunk, rep, doc, low, high, n_grams, bands, copies: who meets whom, for buckets with more than one member.

    A bucket of at most ``chunk`` members is one meeting. A larger one is cut by a hash of the members into chunks, and each
    pair of chunks (i <= j) is a meeting, so no task ever holds more than about two chunks of a bucket and no pair is left out.
    """
    members = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    crowded = members.groupBy("key", "band").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    crowded = materialize(crowded.select(F.col("key").alias("_k"), F.col("band").alias("_b"), "m"), "buckets")
    met = members.join(crowded, (F.col("key") == F.col("_k")) & (F.col("band") == F.col("_b"))).drop("_k", "_b")
    # Most documents meet nobody, so their bands stay behind until it is known who does.
    met = materialize(met, "members").join(reps.select("rep", *_CARRIED), "rep")
    n = F.ceil(F.col("m") / F.lit(chunk)).cast("int")
    met = met.withColumn("_n", n).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("_n")).cast("int"))
    alone = met.filter("_n = 1").withColumn("other", F.lit(0))
    spread = met.filter("_n > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    both = alone.unionByName(spread)
    return both.select("key", "band", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "rep", *_CARRIED)


def first_meetings(met: DataFrame) -> DataFrame:
    """The rows of ``met`` that have a pair which meets there for the first time: only these need their n-gram sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in runs(batches, _PLACE):
            matrix = _band_matrix(batch)
            band, i, j, side = (batch.column(c).to_numpy() for c in ("band", "i", "j", "chunk"))
            keep = np.zeros(batch.num_rows, bool)
            for begin, end in zip(bounds, [*bounds[1:], batch.num_rows], strict=True):
                if end - begin == 2 and i[begin] == j[begin]:
                    keep[begin:end] = not (matrix[begin, : band[begin]] == matrix[begin + 1, : band[begin]]).any()
                elif end - begin > 1:
                    keep[begin:end] = _new_pairs(matrix[begin:end], band[begin], side[begin:end], i[begin], j[begin]).any(axis=1)
            yield batch.filter(pa.array(keep))

    sorted_rows = met.repartition(*_PLACE).sortWithinPartitions(*_PLACE)
    return map_arrow(sorted_rows, run, "key long, band int, i int, j int, chunk int, rep long, doc long, low long, high long, n_grams long, bands array<long>, copies long")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted distinct arrays."""
    sizes = np.asarray([len(s) for s in sets])
    _, number = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(sets), len(sets)), np.int64)
    mark = np.zeros(int(number.max()) + 1, np.int64)
    for k in range(len(sets)):
        own = number[starts[k] : starts[k] + sizes[k]]
        mark[own] = 1
        out[k] = np.add.reduceat(mark[number], starts)
        mark[own] = 0
    return out


def verified_links(met: DataFrame, threshold: float) -> DataFrame:
    """(rep, links, low) from rows with their ``grams``: links counts the copies of partners with a Jaccard similarity of at least
    ``threshold``; ``low`` is the smallest rep connected to it within the meeting."""
    from maskwell.llm.components import lowest_linked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in runs(batches, _PLACE):
            matrix = _band_matrix(batch)
            band, i, j, side, rep, copies = (batch.column(c).to_numpy() for c in ("band", "i", "j", "chunk", "rep", "copies"))
            grams = batch.column("grams")
            out = []
            for begin, end in zip(bounds, [*bounds[1:], batch.num_rows], strict=True):
                if end - begin < 2:
                    continue
                sets = [np.frombuffer(grams[k].as_buffer(), np.uint64) for k in range(begin, end)]
                sizes = np.asarray([len(s) for s in sets])
                both = overlaps(sets)
                union = sizes[:, None] + sizes[None, :] - both
                hit = _new_pairs(matrix[begin:end], band[begin], side[begin:end], i[begin], j[begin]) & (both >= threshold * union)
                if not hit.any():
                    continue
                low, _ = lowest_linked(hit, rep[begin:end], rep[begin:end], True)
                at = np.flatnonzero(hit.any(axis=1))
                out.append((rep[begin:end][at], (hit @ copies[begin:end])[at], low[at]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], ["rep", "links", "low"])

    sorted_rows = met.repartition(*_PLACE).sortWithinPartitions(*_PLACE)
    return map_arrow(sorted_rows, run, "rep long, links long, low long")


def judged_documents(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, n: int = N_WORDS) -> DataFrame:
    """doc_id, text_hash, component (a number of the class; null for rows that link with nothing by themselves), class_id and n_links of each row."""
    bands, rows = choose_bands(threshold, recall)
    signed = materialize(signatures(docs, bands, rows, n), "signatures")
    able = signed.filter("n_grams > 0 AND doc_id IS NOT NULL")
    sets = able.groupBy(*_FINGERPRINT).agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("copies"), F.min_by("bands", "doc_id").alias("bands"))
    # A set of n-grams has a number of its own: ids may repeat with different texts.
    reps = materialize(sets.withColumn("rep", F.monotonically_increasing_id()), "representatives")
    first = materialize(first_meetings(meetings(reps)), "meetings")
    texts = only_ids(docs.select("doc_id", "text"), first.select("doc"))
    grams = gram_sets(texts, n).groupBy(*_FINGERPRINT).agg(F.min("grams").alias("grams"))
    links = materialize(verified_links(first.join(grams, list(_FINGERPRINT)), threshold), "links")
    per_rep = links.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = components(links.select(F.col("rep").alias("a"), F.col("low").alias("b"))).withColumnRenamed("node", "rep")
    known = reps.select(*_FINGERPRINT, "rep", "doc", "copies").join(per_rep, "rep", "left").join(parts, "rep", "left")
    smallest = known.filter("component IS NOT NULL").groupBy("component").agg(F.min("doc").alias("smallest"))
    known = known.join(smallest, "component", "left")
    known = known.select(*(F.col(c).alias(f"_{c}") for c in _FINGERPRINT), "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component"), F.coalesce("smallest", "doc").alias("smallest"))
    known = materialize(known, "classes")
    discard(first, links)
    same = (F.col("n_grams") > 0) & F.col("doc_id").isNotNull()
    for c in _FINGERPRINT:
        same = same & (F.col(c) == F.col(f"_{c}"))
    out = signed.drop("bands").join(known, same, "left")
    return out.select("doc_id", "text_hash", "component", F.coalesce("smallest", "doc_id").alias("class_id"), F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"))


def similar_documents(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, n: int = N_WORDS) -> DataFrame:
    """doc_id, class_id, n_links and kept for each row of ``docs`` (doc_id, text).

    Two documents are linked if the sets of their runs of ``n`` words have a Jaccard similarity of at least ``threshold``. Texts with equal
    sets are one class from the start, whose members are all linked with each other; classes are compared through one representative.
    n_links counts all documents that a document is linked with; class_id is the smallest doc_id reachable by links, and kept says
    whether that is the document itself. No bucket is capped; a pair at the threshold is missed with a probability of 1 - ``recall``.

    A text without words (null, empty, white space) links with nothing. A row without doc_id takes no part: it keeps a null class, no links and is kept.
    A row is known by its text, not by its id: rows that repeat a doc_id are documents of their own, equal ones share their verdict. Whole texts are
    compared, however long. Ties do not occur: links and classes are sets. Other columns, whatever their names, are not read. An empty table gives an empty result.
    """
    out = judged_documents(docs, threshold, recall, n)
    return out.select("doc_id", "class_id", "n_links", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept"))


def only_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``ids`` (doc), and some others; no text is shuffled."""
    return maybe_in(docs, F.col("doc_id").cast("long"), ids, F.col("doc").cast("long")).filter("__mw_maybe").select(*docs.columns)


def filter_documents(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each class of :func:`similar_documents`, with all columns; rows without an id and texts without words all stay.

    Of a class the row with the smallest doc_id stays, of several with it the one with the smallest text hash, and of rows that repeat both the one whose other
    columns have the smallest hash: reruns agree.
    """
    judged = materialize(judged_documents(docs), "join_verdicts")
    first = judged.filter("component IS NOT NULL AND doc_id = class_id").groupBy("component").agg(F.min_by(F.struct("doc_id", "text_hash"), "text_hash").alias("k"), F.count(F.lit(1)).alias("__mw_rows"))
    first = first.select(F.col("k.doc_id").alias("__mw_id"), F.col("k.text_hash").alias("__mw_hash"), "__mw_rows")
    names = [F.col(f"`{c}`") for c in docs.columns]
    stay = docs.join(first, (F.col("doc_id") == F.col("__mw_id")) & (F.xxhash64("text") == F.col("__mw_hash")))
    repeated = stay.filter("__mw_rows > 1").withColumn("__mw_order", F.xxhash64(F.to_json(F.struct(*names))))
    one = Window.partitionBy("__mw_id", "__mw_hash").orderBy("__mw_order")
    repeated = repeated.withColumn("__mw_at", F.row_number().over(one)).filter("__mw_at = 1")
    apart = docs.filter(F.col("doc_id").isNull() | (F.btrim(F.coalesce(F.col("text"), F.lit("")), F.lit(SPACES)) == ""))
    return stay.filter("__mw_rows = 1").select(*names).unionByName(repeated.select(*names)).unionByName(apart)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and links of all documents."""
    return similar_documents(read_table(spark, sf_dir, "documents"))


#: Exact, by all pairs of documents with a common n-gram.
_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' ')) END) AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM s WHERE doc_id IS NOT NULL),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS c FROM e a JOIN e b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p WHERE c >= 0.8 * (nx + ny - c)),
r(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.y, r.root FROM r JOIN l ON r.node = l.x),
m AS (SELECT node, min(root) AS class_id FROM r GROUP BY node),
k AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
SELECT d.doc_id, m.class_id, CAST(coalesce(k.n_links, 0) AS BIGINT) AS n_links, d.doc_id = m.class_id AS kept FROM documents d JOIN m ON d.doc_id = m.node LEFT JOIN k ON d.doc_id = k.x
"""

SQL = {"op7_ngram_join": _SQL}
