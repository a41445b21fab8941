"""Token pieces of documents and their sum-of-squares packing into sequences."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.llm.common import materialize
from maskwell.llm.textvec import blocks
from maskwell.shipping import group_arrow, map_arrow
from maskwell.sources.tables import read_table

CAPACITY = 1024
#: Pieces that one task packs; each group is packed on its own, which costs at most a few part-filled
#: sequences a group.
GROUP_ROWS = 50_000
END_ID = 2


@cache
def _encoder(path: str):
    import public_tokenizers
    import tiktoken

    ranks = {}
    with open(path, encoding="ascii") as lines:
        for line in lines:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: one where they fit, else full pieces after a shorter first one."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of every whole text: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    The vocabulary file has the ranks of the byte-level BPE whose ids the ``tokenizers`` file of the same name
    gives; strings of special tokens are ordinary text. A null or empty text is the end id alone. The path
    must be readable on every executor (it is a package's file). Repeated rows and rows without an id have their pieces each; a very long text
    is encoded as a whole by one task. Other columns are not read. An empty table gives an empty result.
    """
    path = vocabulary or default_vocabulary()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for rows, data, offsets in blocks(batches):
            out: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            kept = []
            raw = data.tobytes()
            for i, doc_id in enumerate(rows.column(0).to_pylist()):
                ids = encoder.encode_ordinary(raw[offsets[i] : offsets[i + 1]].decode("utf-8", "replace"))
                ids.append(end_id)
                packed = np.asarray(ids, "<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    part = packed[start : start + length]
                    for name, value in zip(out, (doc_id, k, start, length, zlib.crc32(part.tobytes())), strict=True):
                        out[name].append(value)
                    if with_ids:
                        kept.append(part.astype(np.int32))
            arrays = [pa.array(out["doc_id"], pa.int64()), pa.array(out["piece"], pa.int32()), *(pa.array(out[c], pa.int64()) for c in ("start", "length", "ids_crc32"))]
            names = list(out)
            if with_ids:
                arrays.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), encode, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, placed in the given order.

    Each item goes where the sum over gaps of the squared number of open bins with that gap becomes smallest, of equals to the tightest. As the
    aim is few bins, two placements go before the sum: an open bin that the item fills is always taken, and an item of at most half a bin opens
    no new one while an open bin has room; a longer item opens one where that makes the smaller sum. Over lengths in descending order this ends
    within a bin or so of the least number; with the sum alone, one percent more bins are opened.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, size in enumerate(lengths.tolist()):
        best = -1
        if open_bins[size]:
            best = size
        else:
            here = count[size:capacity]
            after = count[: capacity - size]
            # A bin leaves gap g (count c -> c-1) and enters gap g-size (d -> d+1): the change is 2(d - c) + 2, or 1 - 2c for a full bin.
            change = np.where(here > 0, 2 * (after - here) + 2, 1 << 60)
            if len(change):
                k = int(change.argmin())
                if here[k] > 0 and (change[k] <= 2 * count[capacity - size] + 1 or size <= capacity // 2):
                    best = size + k
        if best < 0:
            bin_id, gap, made = made, capacity, made + 1
        else:
            bin_id, gap = open_bins[best].pop(), best
            count[gap] -= 1
        bins[i], offsets[i] = bin_id, capacity - gap
        if gap > size:
            open_bins[gap - size].append(bin_id)
            count[gap - size] += 1
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a written table of pieces with doc_id, piece, start and length (at most ``capacity``).

    Full pieces are sequences by themselves. The others are dealt by a hash into groups of about
    ``group_rows``, and a group is packed by :func:`sum_of_squares` from its longest piece to its shortest. Only these
    numbers are shuffled. Rows are dealt by their place in the table, so rows that repeat, as often as they may, are spread like others and packed each;
    lengths that tie go by id and piece. Pieces keep all their columns. An empty table packs into nothing.
    """
    n = pieces.count()
    groups = max(1, -(-n // group_rows))
    h = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("long")
    names = pieces.columns
    cut_up = pieces.withColumn("_group", h)
    full = cut_up.filter(F.col("length") == capacity)
    rest = cut_up.filter(F.col("length") < capacity)

    def place(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins, offsets = sum_of_squares(group.column("length").to_numpy(), capacity)
        base = group.column("_group")[0].as_py() if len(group) else 0
        ids = bins * groups + base
        out = group.select(names).append_column("sequence_id", pa.array(ids * 2, pa.int64()))
        return out.append_column("offset", pa.array(offsets, pa.int64()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    placed = group_arrow(rest, ["_group"], place, schema)
    alone = full.select(*names, (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(alone)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of at most 1024 tokens."""
    return pack_documents(read_table(spark, sf_dir, "documents"))


def pack_documents(docs: DataFrame) -> DataFrame:
    """The pieces of ``docs`` (doc_id, text) and their places in sequences; see :func:`token_pieces` and :func:`pack` for nulls, repeated rows and the like."""
    pieces = materialize(token_pieces(docs), "pieces")
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
