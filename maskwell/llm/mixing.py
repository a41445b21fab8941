"""Mixing sources to target weights: token blocks, multinomial shard draws, index permutations, block joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskwell.llm.common import materialize, n_words, ranked
from maskwell.llm.textvec import blocks, find_words, hash_keys
from maskwell.shipping import map_arrow
from maskwell.sources.tables import read_table

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2
BLOCK_WORDS = 64
#: Blocks of a shard, on average.
SHARD_BLOCKS = 4096
#: Slots of a source that one task draws for and deals at a time.
DRAW_SLOTS, DEAL_SLOTS = 1 << 22, 1 << 18


def targets(sizes: list[int], weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> list[float]:
    """Target of each source: its weight's part of ``share`` of all sizes, at most ``cap`` times its own size; what is
    over the cap is shared again by weight among the others until none is above."""
    w = np.resize(np.asarray(weights, float), len(sizes))
    limit = cap * np.asarray(sizes, float)
    out = np.zeros(len(sizes))
    free = np.ones(len(sizes), bool)
    left = share * float(sum(sizes))
    while free.any():
        part = np.where(free, w * left / w[free].sum(), 0.0)
        over = free & (part > limit)
        if not over.any():
            out[free] = part[free]
            break
        out[over] = limit[over]
        left -= float(limit[over].sum())
        free &= ~over
    return out.tolist()


def source_table(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """source, source_index (by code point, null last), source_size and target of each source of ``sizes`` (source, size), as :func:`targets` gives them.

    Sources are numbered by a sort over all tasks and their targets found from sums over them: as many as there are, none of them is on the driver. The
    level of the free sources only rises, and each round settles all that it puts over their cap.
    """
    spark = sizes.sparkSession
    n_parts = max(1, spark.sparkContext.defaultParallelism)
    ordered = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_null", F.col("source").isNull())
    ordered = ordered.repartitionByRange(n_parts, "_null", "source").withColumn("_part", F.spark_partition_id())
    ordered = materialize(ordered, "sources")
    counts = {r["_part"]: r["n"] for r in ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, begins = 0, []
    for part in sorted(counts):
        begins.append((part, before))
        before += counts[part]
    begin = F.broadcast(spark.createDataFrame(begins, "_p int, _begin long"))
    inside = Window.partitionBy("_part").orderBy("_null", "source")
    numbered = ordered.join(begin, F.col("_part") == F.col("_p")).withColumn("source_index", F.col("_begin") + F.row_number().over(inside) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_index") % len(weights) + 1).cast("int"))
    numbered = materialize(numbered.select("source", "source_index", "source_size", weight.alias("_weight"), (F.col("source_size") * F.lit(float(cap))).alias("_limit")), "source_weights")
    total = float(numbered.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        over = F.col("_weight") * F.lit(level) > F.col("_limit")
        full, free = numbered.agg(F.sum(F.when(over, F.col("_limit"))), F.sum(F.when(~over, F.col("_weight")))).first()
        if free is None:
            break
        new = (share * total - (full or 0.0)) / free
        if new <= level * (1 + 1e-15):
            break
        level = new
    target = F.least(F.col("_limit"), F.col("_weight") * F.lit(level))
    return materialize(numbered.select("source", "source_index", "source_size", target.alias("target")), "source_targets")


def split_draw(n: int, first: int, end: int, key: int, seed: int) -> Iterator[tuple[int, int]]:
    """(shard, slots) of a multinomial draw of ``n`` slots over the shards first to end - 1, all alike, those with slots only. The draw is made by halves: each
    half's slots are binomial, with a generator of the key and the half, so any part of the draw can be made anywhere."""
    stack = [(first, end, n)]
    while stack:
        a, b, k = stack.pop()
        if not k:
            continue
        if b - a == 1:
            yield a, k
            continue
        m = (a + b) // 2
        left = int(np.random.default_rng([seed, key, a, b]).binomial(k, (m - a) / (b - a)))
        stack += [(m, b, k - left), (a, m, left)]


def draw_shards(sources: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """source_index, blocks, shard, first, n: how many slots of each source (source_index, blocks, slots) every shard gets, and the number of the first.

    A source's slots are one multinomial draw over the shards, so a shard's counts by source are draws with the sources' slots as weights, and
    every source ends at its slots exactly. A source with many slots is drawn by several tasks, each for a range of shards.
    """
    pieces = F.least(F.lit(n_shards), F.greatest(F.lit(1), F.ceil(F.col("slots") / DRAW_SLOTS))).cast("int")
    parts = sources.withColumn("parts", pieces).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                # The slots of the ranges before come from the same draw, made over whole ranges.
                ranges = [n_shards * i // r["parts"] for i in range(r["parts"] + 1)]
                rng = np.random.default_rng([seed, r["source_index"]])
                share = rng.multinomial(r["slots"], np.diff(ranges) / n_shards)
                begin, out = int(share[: r["part"]].sum()), []
                for shard, n in split_draw(int(share[r["part"]]), ranges[r["part"]], ranges[r["part"] + 1], r["source_index"], seed):
                    for at in range(0, n, DEAL_SLOTS):
                        out.append((r["source_index"], r["blocks"], shard, begin + at, min(DEAL_SLOTS, n - at)))
                    begin += n
                    if len(out) >= 10_000:
                        yield _rows(out)
                        out = []
                if out:
                    yield _rows(out)

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["source_index", "blocks", "shard", "first", "n"])

    spread = parts.select("source_index", "blocks", "slots", "parts", "part").repartition("source_index", "part")
    return map_arrow(spread, run, "source_index long, blocks long, shard long, first long, n long")


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 under a key: a Feistel network on the next even power of two, walked
    until the result is below n. ``n`` and ``key`` are arrays like ``index``."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2)
    mask = (np.int64(1) << half) - 1
    out = index.astype(np.int64).copy()
    todo = np.ones(len(out), bool)
    while todo.any():
        at = np.flatnonzero(todo)
        x, h, m, k = out[at], half[at], mask[at], key[at]
        left, right = x >> h, x & m
        for turn in range(4):
            f = (hash_keys(right ^ (k << np.int64(8)), turn + 1) >> np.uint64(1)).astype(np.int64) & m
            left, right = right, left ^ f
        out[at] = (left << h) | right
        todo[at] = out[at] >= n[at]
    return out


def _describe(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"))


def plan_mix(docs: DataFrame, seed: int = 7, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """(rows, slots) of the mixture of a table with doc_id, source and text.

    rows: doc_id, source, text_hash, size, source_size, target, source_index and ``begin``, the place of the row's words
    among all words of its source, which are laid out in a seeded shuffle of its rows. Word ``w`` of a source is in
    block ``w // block_words``.
    slots: one row for each block that the mix takes: source_index, block, copy (0 or 1), shard.

    A null text has size 0 and a null source is a source, the last one. Repeated rows are laid out as often as they occur; rows that tie in the seeded
    shuffle are ordered by id and text. A very long text is cut into blocks like any other. Other columns, whatever their names, are not read. An empty table
    has no rows and no slots. The places in a source come from :func:`ranked`, so a hot source is spread over all tasks.
    """
    base = _describe(docs)
    base = base.withColumn("_hash", F.md5(F.concat_ws("|", F.lit(f"mix{seed}"), F.coalesce(F.col("doc_id").cast("string"), F.lit("~")), F.col("text_hash").cast("string"))))
    base = materialize(base, "mix_sizes")
    sources = source_table(base.select("source", "size"), weights, share, cap)
    placed = ranked(base, "source", "_hash", ["doc_id", "text_hash"], base.count(), "size")
    own = sources.select(F.col("source").alias("_source"), "source_index", "source_size", "target")
    rows = placed.join(own, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "_hash", "rank", "group_rows", "group_size")
    rows = materialize(rows, "mix_rows")

    blocks_of = F.ceil(F.col("source_size") / block_words).cast("long")
    wanted = sources.filter("source_size > 0").select("source_index", blocks_of.alias("blocks"), "source_size", "target")
    exact = F.col("target") * F.col("blocks") / F.col("source_size")
    wanted = wanted.select("source_index", "blocks", F.least(F.col("blocks") * cap, F.bround(exact).cast("long")).alias("slots"))
    n_slots = wanted.agg(F.sum("slots")).first()[0] or 0
    runs = draw_shards(wanted, max(1, -(-n_slots // SHARD_BLOCKS)), seed)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                at = np.arange(r["first"], r["first"] + r["n"])
                copy, index = at // r["blocks"], at % r["blocks"]
                key = hash_keys(copy + r["source_index"] * 1024, seed).view(np.int64) >> np.int64(9)
                block = permute(index, np.full(len(at), r["blocks"], np.int64), key)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), r["source_index"], np.int64)), pa.array(block), pa.array(copy.astype(np.int32)), pa.array(np.full(len(at), r["shard"], np.int64))],
                    ["source_index", "block", "copy", "shard"],
                )

    # A given number of tasks, as the rows of ``runs`` are few and each stands for many.
    n_tasks = max(1, -(-n_slots // DEAL_SLOTS), min(8 * docs.sparkSession.sparkContext.defaultParallelism, n_slots // SHARD_BLOCKS))
    # The dealt slots are many more than Spark can tell from the sources they come from, so it must not broadcast them.
    return rows, map_arrow(runs.repartition(n_tasks, "source_index", "shard"), deal, "source_index long, block long, copy int, shard long")


def block_pieces(rows: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Each row's part of each block that it touches: source_index, begin, block, word (the first, counted in the row) and n words."""
    has = rows.filter("size > 0")
    out = has.withColumn("block", F.explode(F.sequence(F.expr(f"begin div {block_words}"), F.expr(f"(begin + size - 1) div {block_words}"))))
    first = F.greatest(F.lit(0), F.col("block") * block_words - F.col("begin"))
    last = F.least(F.col("size"), (F.col("block") + 1) * block_words - F.col("begin"))
    return out.withColumn("word", first).withColumn("n", last - first)


def taken_words(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken, the words that the mix takes of each row of ``docs``; see :func:`plan_mix`."""
    rows, slots = plan_mix(docs)
    times = slots.groupBy("source_index", "block").agg(F.count(F.lit(1)).alias("times"))
    pieces = block_pieces(rows).select("source_index", "begin", "block", "n")
    taken = pieces.join(times.hint("merge"), ["source_index", "block"]).groupBy("source_index", "begin").agg(F.sum(F.col("n") * F.col("times")).alias("_taken"))
    taken = taken.select(F.col("source_index").alias("_s"), F.col("begin").alias("_b"), "_taken")
    own = (F.col("source_index") == F.col("_s")) & (F.col("begin") == F.col("_b")) & (F.col("size") > 0)
    out = rows.join(taken.hint("merge"), own, "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce(F.col("_taken"), F.lit(0)).cast("long").alias("taken"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return taken_words(read_table(spark, sf_dir, "documents"))


def mixed_documents(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mixture as documents: the columns of ``docs``, with a row for each run of adjoining words that is
    taken, as often as it is taken, ``text`` being that run as it stands in the text, and n_chars (where there is such a
    column) its code points.

    A text is joined once, by its id and hash; repeated rows are told apart by their number.
    """
    rows, slots = plan_mix(docs, seed)
    pieces = block_pieces(rows).join(slots.select("source_index", "block", "copy").hint("merge"), ["source_index", "block"])
    spans = pieces.groupBy("source_index", "begin", "doc_id", "text_hash").agg(F.collect_list(F.struct("copy", "word", "n")).alias("__mw_spans"))
    ids = [F.col("doc_id").alias("__mw_id"), F.col("text_hash").alias("__mw_t")]
    spans = spans.select(*ids, "source_index", "begin", "__mw_spans")
    return _cut_out(docs, spans)


def _cut_out(docs: DataFrame, spans: DataFrame) -> DataFrame:
    one = Window.partitionBy("__mw_id", "__mw_t").orderBy("source_index", "begin")
    spans = spans.withColumn("__mw_rn", F.row_number().over(one)).select("__mw_id", "__mw_t", "__mw_rn", "__mw_spans")
    text_hash = F.xxhash64("text")
    numbered = docs.withColumn("__mw_h", text_hash).withColumn("__mw_k", F.row_number().over(Window.partitionBy("doc_id", "__mw_h").orderBy("source")))
    same = F.col("doc_id").eqNullSafe(F.col("__mw_id")) & (F.col("__mw_h") == F.col("__mw_t")) & (F.col("__mw_k") == F.col("__mw_rn"))
    joined = numbered.join(spans.hint("merge"), same).drop("__mw_id", "__mw_t", "__mw_rn", "__mw_h", "__mw_k")
    names = docs.columns
    text_at = names.index("text")
    chars_at = names.index("n_chars") if "n_chars" in names else None
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches):
            start, end, owner = find_words(data, offsets)
            first = np.searchsorted(owner, np.arange(rows.num_rows))
            raw = data.tobytes()
            keep, texts = [], []
            for i, row_spans in enumerate(rows.column(rows.num_columns - 1).to_pylist()):
                open_at = None
                for s in sorted((s["copy"], s["word"], s["n"]) for s in row_spans):
                    if open_at is not None and open_at[0] == s[0] and open_at[2] == s[1]:
                        open_at[2] = s[1] + s[2]
                        continue
                    if open_at is not None:
                        keep.append(i)
                        texts.append(raw[start[first[i] + open_at[1]] : end[first[i] + open_at[2] - 1]].decode("utf-8", "replace"))
                    open_at = [s[0], s[1], s[1] + s[2]]
                if open_at is not None:
                    keep.append(i)
                    texts.append(raw[start[first[i] + open_at[1]] : end[first[i] + open_at[2] - 1]].decode("utf-8", "replace"))
            arrays = rows.select(names).take(pa.array(keep, pa.int64())).columns
            arrays[text_at] = pa.array(texts, pa.string())
            if chars_at is not None:
                arrays[chars_at] = pa.array([len(t) for t in texts], rows.schema.field(chars_at).type)
            yield pa.RecordBatch.from_arrays(arrays, names)

    return map_arrow(joined.select(*names, "__mw_spans"), run, schema)
