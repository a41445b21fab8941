"""Brown class-based n-gram scoring: exchange clustering, class transitions, word emissions.

The texts are read once: each run of texts sends its distinct words to the shards of the vocabulary, a shard sums and numbers them, and the
numbers go back, so that texts become arrays of ids. Every word of the training texts is a unit of the exchange. Clustering and scoring then
only read the ids. What a task holds is one shard, one run of texts and the classes of the most frequent words, one byte each, of which there is a
bounded number; the classes of all rarer words stay in a table by shard and travel with the texts that have them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.llm.common import discard, materialize, release, small_batches
from maskwell.llm.language_id import fold
from maskwell.llm.textvec import blocks, find_words, hash_words, lower_ascii, mix
from maskwell.shipping import map_arrow
from maskwell.sources.tables import read_table

#: The most frequent words, which move one after the other on the driver; all others move in their shard's task.
HEAD_WORDS = 4096
#: Words whose classes are broadcast, a byte each, the most frequent of each shard.
BROADCAST_WORDS = 1 << 27
#: A word that no training text has gets the class that words seen once have most often under its shape, the hash of its last three bytes.
SHAPES = 2048
CLASSES = 64
#: Rounds at most, each a turn of the head and one of all other words.
ROUNDS = 4
#: Clustering ends when a round raises the likelihood by less than this share.
SETTLED = 1e-3
DELTA = 0.1
TRANSITION_PRIOR = 2.0
#: Text bytes for each shard of the vocabulary, and for each run of texts.
SHARD_BYTES, RUN_BYTES = 8 << 20, 2 << 20
LEAST_SHARDS = 16
#: Head words whose counts are summed in one group.
HEAD_GROUP = 256
_MERGE_AT = 1 << 21

class _Counts:
    """Counts of integer keys, merged now and then."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        self.parts.append((keys, counts))
        self.size += len(keys)
        if self.size > _MERGE_AT:
            self.parts = [self.total()]
            # Half of the limit stays free, or each further block would merge anew.
            self.size = min(len(self.parts[0][0]), _MERGE_AT // 2)

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) == 1:
            return self.parts[0]
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, where = np.unique(np.concatenate([k for k, _ in self.parts]), return_inverse=True)
        return keys, np.bincount(where, np.concatenate([c for _, c in self.parts])).astype(np.int64)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, shape, row) of each word, ASCII letters in lower case."""
    data = lower_ascii(data)
    start, end, row = find_words(data, offsets)
    word = hash_words(data, start, end)
    shape = np.zeros(len(start), np.uint64)
    for back in range(1, 4):
        at = end - back
        shape = shape * np.uint64(257) + np.where(at >= start, data[np.maximum(at, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    return word, (mix(shape) % np.uint64(SHAPES)).astype(np.int16), row


def with_ends(values: np.ndarray, row: np.ndarray, n_rows: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(previous, value, row) of every token of each row: its words, then one end. Before the first word stands an end."""
    count = np.bincount(row, minlength=n_rows)
    at = np.arange(len(values)) + row
    out = np.full(len(values) + n_rows, end, np.int64)
    out[at] = values
    before = np.full(len(out), end, np.int64)
    before[1:] = out[:-1]
    return before, out, np.repeat(np.arange(n_rows), count + 1)


def _ends(begin: np.ndarray, n: int) -> np.ndarray:
    """Where each of the runs that begin at ``begin`` ends, the last one at ``n``."""
    return np.append(begin[1:], n)[: len(begin)]


def _records(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)], [name for name, _ in fields])


def _array(batch: pa.RecordBatch, column: str, i: int, kind: type) -> np.ndarray:
    return np.frombuffer(batch.column(column)[i].as_buffer(), kind)


def _planes(values: np.ndarray) -> bytes:
    """Integers of 32 bits compressed, all lower halves and then all upper ones, which are mostly alike. The number of bytes comes first."""
    values = values.astype(np.uint32)
    data = (values & np.uint32(0xFFFF)).astype(np.uint16).tobytes() + (values >> np.uint32(16)).astype(np.uint16).tobytes()
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(data, asbytes=True)


def _from_planes(data) -> np.ndarray:
    size = int.from_bytes(memoryview(data)[:8], "little")
    data = pa.decompress(memoryview(data)[8:], decompressed_size=size, codec="zstd")
    low, high = np.frombuffer(data, np.uint16).reshape(2, -1).astype(np.uint32)
    return (low | (high << np.uint32(16))).view(np.int32).astype(np.int64)


def _partitions(spark: SparkSession, n_shards: int) -> int:
    """Tasks of a shuffle by shard or by run of texts: the session's number, more where the shards outgrow it, so that a task's share stays the same."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_shards // 4))


_SENT = "kind int, shard int, key long, start long, words binary, shapes binary, counts binary, docs binary, nulls binary, learned binary, lengths binary, codes binary"
_ANSWER = "kind int, shard int, key long, start long, words binary, shapes binary, counts binary"
_ALL = "key long, docs binary, nulls binary, learned binary, lengths binary, ids binary, base binary, known binary, shard int, words binary, shapes binary, counts binary"
_CODED = "key long, docs binary, nulls binary, learned binary, lengths binary, ids binary, base binary, known binary"


def send(docs: DataFrame, n_shards: int) -> DataFrame:
    """For each run of ``docs`` (doc_id, text, learned) a row of its texts, whose words are places in its list of distinct words, and a row for each
    shard with the words of that list that are the shard's and how often learned texts of the run have them. A word is once in
    a run's list, so no word is hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        key = TaskContext.get().partitionId() << 40
        for batch, data, offsets in blocks(batches, limit=RUN_BYTES):
            n = batch.num_rows
            word, shape, row = tokens(data, offsets)
            learned = np.asarray(batch.column(2).fill_null(False).to_pylist(), np.uint8)
            distinct, first, where = np.unique(word, return_index=True, return_inverse=True)
            count = np.bincount(where, learned[row], minlength=len(distinct)).astype(np.int32)
            shard = (distinct % np.uint64(n_shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            ids = batch.column(0)
            nulls = np.asarray(ids.is_null().to_pylist(), np.uint8)
            lengths = np.bincount(row, minlength=n).astype(np.int64)
            out = [(0, 0, key, 0, None, None, None, ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(), nulls.tobytes(), learned.tobytes(), lengths.tobytes(), _planes(place[where]))]
            some, begin = np.unique(shard[order], return_index=True)
            for s, b, e in zip(some, begin, _ends(begin, len(order)), strict=True):
                at = order[b:e]
                out.append((1, int(s), key, int(b), distinct[at].tobytes(), shape[first[at]].tobytes(), count[at].tobytes(), *(None,) * 5))
            yield _records(_SENT, out)
            key += 1

    with small_batches(docs.sparkSession, 2000):
        return materialize(map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "learned"), run, _SENT), "sent_words", "zstd")


def number(sent: DataFrame, n_shards: int) -> DataFrame:
    """Per shard its vocabulary (kind 0: words, shapes and counts of learned words from the most frequent on) and an answer to each list (ids
    in ``words``, counts; kind 1 in 64 bits, kind 2 in 32 where they fit). The key of a vocabulary is -1 - shard. Nothing is written here: the rows go on to :func:`assemble`. The k-th word of shard s has the id k * n_shards + s; a word that no learned text has gets -1 - shape."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, lists = -1, []

        def done() -> Iterator[pa.RecordBatch]:
            words, shapes, counts = (np.concatenate([x[i] for x in lists]) for i in (2, 3, 4))
            distinct, first, where = np.unique(words, return_index=True, return_inverse=True)
            n = np.bincount(where, counts, minlength=len(distinct)).astype(np.int64)
            order = np.argsort(-n, kind="stable")
            ids = np.empty(len(order), np.int64)
            ids[order] = np.arange(len(order)) * n_shards + of
            ids = np.where(n > 0, ids, -1 - shapes[first].astype(np.int64))
            known = order[: int((n > 0).sum())]
            yield _records(_ANSWER, [(0, of, -1 - of, 0, distinct[known].tobytes(), shapes[first[known]].tobytes(), n[known].tobytes())])
            ids, n, begin = ids[where], n[where], 0
            narrow = max(ids.max(initial=0), n.max(initial=0)) < 1 << 31
            kind, wire = (2, _planes) if narrow else (1, np.ndarray.tobytes)
            for key, start, have, *_ in lists:
                end = begin + len(have)
                yield _records(_ANSWER, [(kind, of, key, start, wire(ids[begin:end]), None, wire(n[begin:end]))])
                begin = end

        for batch in batches:
            shard, key, start = (batch.column(c).to_numpy() for c in ("shard", "key", "start"))
            for i in range(batch.num_rows):
                if shard[i] != of:
                    if lists:
                        yield from done()
                    of, lists = int(shard[i]), []
                # Copies, as the batch's own memory goes with it.
                lists.append((int(key[i]), int(start[i]), *(_array(batch, c, i, t).copy() for c, t in (("words", np.uint64), ("shapes", np.int16), ("counts", np.int32)))))
        if lists:
            yield from done()

    asked = sent.filter("kind = 1").select("shard", "key", "start", "words", "shapes", "counts").repartition(_partitions(sent.sparkSession, n_shards), "shard").sortWithinPartitions("shard")
    return map_arrow(asked, run, _ANSWER)


def assemble(sent: DataFrame, answers: DataFrame, n_shards: int) -> tuple[DataFrame, DataFrame]:
    """(coded texts, vocabulary): the runs of texts with ids, and for each text the sum of log10(count + 0.1) of its words and how many of them are known; and
    shard, words, shapes and counts of each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict = {}
        parts: list = []

        def done() -> pa.RecordBatch:
            parts.sort(key=lambda x: x[0])
            ids, n = (np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64) for c in (1, 2))
            codes, lengths = _from_planes(texts["codes"]), np.frombuffer(texts["lengths"], np.int64)
            of = np.repeat(np.arange(len(lengths)), lengths)
            base = np.bincount(of, np.log10(n + DELTA)[codes], minlength=len(lengths))
            known = np.bincount(of, (n > 0)[codes], minlength=len(lengths)).astype(np.int64)
            return _records(_ALL, [(texts["key"], texts["docs"], texts["nulls"], texts["learned"], texts["lengths"], ids[codes].tobytes(), base.astype(np.float64).tobytes(), known.tobytes(), *(None,) * 4)])

        for batch in batches:
            kind, key, start = (batch.column(c).to_numpy() for c in ("kind", "key", "start"))
            for i in range(batch.num_rows):
                if key[i] < 0:
                    yield _records(_ALL, [(key[i], *(None,) * 7, int(-1 - key[i]), *(batch.column(c)[i].as_py() for c in ("words", "shapes", "counts")))])
                elif kind[i] == 0:
                    if texts:
                        yield done()
                    texts, parts = {c: batch.column(c)[i].as_py() for c in ("key", "docs", "nulls", "learned", "lengths", "codes")}, []
                else:
                    read = (lambda b: np.frombuffer(b, np.int64).copy()) if kind[i] == 1 else _from_planes
                    parts.append((start[i], *(read(batch.column(c)[i].as_buffer()) for c in ("words", "counts"))))
        if texts:
            yield done()

    none = lambda *names: [F.lit(None).cast("binary").alias(c) for c in names]
    own = sent.filter("kind = 0").select("kind", "key", "start", *none("words", "shapes", "counts"), "docs", "nulls", "learned", "lengths", "codes")
    back = answers.select("kind", "key", "start", "words", "shapes", "counts", *none("docs", "nulls", "learned", "lengths", "codes"))
    with small_batches(sent.sparkSession, 16):
        whole = own.unionByName(back).repartition(_partitions(sent.sparkSession, n_shards), "key").sortWithinPartitions("key", "kind")
        out = materialize(map_arrow(whole, run, _ALL), "coded_texts", "zstd")
    names = [f.split()[0] for f in _CODED.split(", ")]
    return out.filter("key >= 0").select(*names), out.filter("key < 0").select("shard", "words", "shapes", "counts")


#: The id of the end. Ids below 0 are places from the end of the array of classes: those of the shapes, and before them that of the end.
END = -1 - SHAPES


class Classes:
    """The class of each id below ``limit`` (a whole number of rows of ids, one for each shard), of the end and of the shapes. Texts carry the classes of other ids."""

    def __init__(self, low: np.ndarray, end: int, shapes: np.ndarray | None = None):
        self.limit = len(low)
        shapes = np.full(SHAPES, -1, np.int8) if shapes is None else shapes
        self.of = np.concatenate([low, [end], shapes[::-1]]).astype(np.int8)

    @property
    def low(self) -> np.ndarray:
        return self.of[: self.limit]

    def find(self, ids: np.ndarray, carried: np.ndarray | None) -> np.ndarray:
        """Classes of ids; ``carried`` are those of the ids from the limit on, in their order."""
        high = ids >= self.limit
        if not high.any():
            return self.of[ids].astype(np.int64)
        out = self.of[np.where(high, 0, ids)].astype(np.int64)
        out[high] = carried
        return out


def adjoining(batches: Iterator[pa.RecordBatch], classes: Classes, learned: bool = False) -> Iterator[tuple]:
    """(batch, row in it, text, ids before, ids after, classes before, classes after) of the adjoining tokens of each run of texts, of all texts or of those learned."""
    for batch in batches:
        carries = "carried" in batch.schema.names
        for i in range(batch.num_rows):
            lengths, ids = _array(batch, "lengths", i, np.int64), _array(batch, "ids", i, np.int64)
            of = classes.find(ids, _array(batch, "carried", i, np.int8) if carries else None)
            if learned:
                wanted = _array(batch, "learned", i, np.uint8).astype(bool)
                at = np.repeat(wanted, lengths)
                ids, of, lengths = ids[at], of[at], lengths[wanted]
            row = np.repeat(np.arange(len(lengths)), lengths)
            before, after, text = with_ends(ids, row, len(lengths), END)
            left, right, _ = with_ends(of, row, len(lengths), int(classes.of[END]))
            yield batch, i, text, before, after, left, right


class Head:
    """The ids that move on the driver, the most frequent first, and where each id stands among them."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        self.place = np.full(int(ids.max()) + 1 if len(ids) else 0, -1, np.int32)
        self.place[ids] = np.arange(len(ids), dtype=np.int32)

    def find(self, ids: np.ndarray) -> np.ndarray:
        """Places of ids, -1 for those outside the head."""
        low = (ids >= 0) & (ids < len(self.place))
        return np.where(low, self.place[np.where(low, ids, 0)] if len(self.place) else -1, -1)


def _token_columns(coded: DataFrame) -> DataFrame:
    return coded.select("learned", "lengths", "ids", *[c for c in ("carried",) if c in coded.columns])


def head_counts(coded: DataFrame, head: Head, classes: Classes, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How often each class follows and precedes each head word, how often the word follows itself, and the class bigrams of all learned tokens."""
    shared, h = coded.sparkSession.sparkContext.broadcast((head, classes)), len(head.ids)
    # One line of cells: two rows of classes for each head word, then the class bigrams, then the head's own bigrams.
    n_cells = 2 * k * h + k * k + h
    group = HEAD_GROUP * 2 * k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_head, of = shared.value
        cells = np.zeros(n_cells, np.int64)
        for _, _, _, before, after, left, right in adjoining(batches, of, True):
            one, two = at_head.find(before), at_head.find(after)
            a, b = one >= 0, two >= 0
            both = a & (one == two)
            cells += np.bincount(np.concatenate([one[a] * (2 * k) + right[a], two[b] * (2 * k) + k + left[b], left * k + right + 2 * k * h, one[both] + (2 * k * h + k * k)]), minlength=n_cells)
        some = np.flatnonzero(cells)
        number, begin = np.unique(some // group, return_index=True)
        for g, b, e in zip(number, begin, _ends(begin, len(some)), strict=True):
            at = some[b:e]
            yield _records("part int, cells binary, counts binary", [(int(g), (at - g * group).astype(np.int32).tobytes(), cells[at].tobytes())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, sums = -1, np.zeros(group, np.int64)
        for batch in batches:
            part = batch.column("part").to_numpy()
            for i in range(batch.num_rows):
                if part[i] != of:
                    if of >= 0:
                        yield _records("part int, counts binary", [(of, sums.tobytes())])
                    of, sums = int(part[i]), np.zeros(group, np.int64)
                sums[_array(batch, "cells", i, np.int32)] += _array(batch, "counts", i, np.int64)
        if of >= 0:
            yield _records("part int, counts binary", [(of, sums.tobytes())])

    with small_batches(coded.sparkSession, 16):
        sent = map_arrow(_token_columns(coded), run, "part int, cells binary, counts binary")
        found = map_arrow(sent.repartition("part").sortWithinPartitions("part"), add, "part int, counts binary").toArrow()
    cells = np.zeros(-(-n_cells // group) * group, np.int64)
    for i in range(found.num_rows):
        g = found.column("part")[i].as_py()
        cells[g * group : (g + 1) * group] = np.frombuffer(found.column("counts")[i].as_buffer(), np.int64)
    shared.unpersist()
    sides = cells[: 2 * k * h].reshape(h, 2, k).astype(np.float64)
    matrix = cells[2 * k * h : 2 * k * h + k * k].reshape(k, k).astype(np.float64)
    return sides[:, 0], sides[:, 1], cells[2 * k * h + k * k : n_cells].astype(np.float64), matrix


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def likelihood(matrix: np.ndarray) -> float:
    """Log likelihood of the class bigrams but for what no clustering changes."""
    return float(_xlogx(matrix).sum() - _xlogx(matrix.sum(axis=0)).sum() - _xlogx(matrix.sum(axis=1)).sum())


def exchange(classes: np.ndarray, after: np.ndarray, before: np.ndarray, loops: np.ndarray, movable: np.ndarray, matrix: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(classes, class matrix) after one pass of exchanges: each movable unit, in the given order, goes to the class where the likelihood becomes largest.

    ``after[u, c]`` and ``before[u, c]`` count the classes that follow and precede unit u; ``loops[u]`` how often u follows itself. The
    last class belongs to the end of text alone. The class matrix, by default that of these units alone, follows each move.
    """
    classes, k = classes.copy(), after.shape[1]
    if matrix is None:
        matrix = np.zeros((k, k))
        np.add.at(matrix, classes, after)
    else:
        matrix = matrix.copy()
    free = k - 1
    for u in movable:
        out, into, loop = after[u].copy(), before[u].copy(), loops[u]
        if out.sum() + into.sum() == 0:
            continue
        a = classes[u]
        out[a] -= loop
        into[a] -= loop
        matrix[a] -= out
        matrix[:, a] -= into
        matrix[a, a] -= loop
        np.maximum(matrix, 0, out=matrix)
        rows, columns = matrix[:free], matrix[:, :free].T
        # Most units meet few classes; only those cells change.
        x, y = np.flatnonzero(out), np.flatnonzero(into)
        after_it, before_it = rows[:, x], columns[:, y]
        gain = (_xlogx(after_it + out[x]) - _xlogx(after_it)).sum(axis=1) + (_xlogx(before_it + into[y]) - _xlogx(before_it)).sum(axis=1)
        own = np.diagonal(matrix)[:free]
        o, i = out[:free], into[:free]
        gain += _xlogx(own + o + i + loop) + _xlogx(own) - _xlogx(own + o) - _xlogx(own + i)
        n_out, n_in = out.sum() + loop, into.sum() + loop
        # What the neighbours' classes lost to this unit comes back to them wherever it goes.
        total_out, total_in = rows.sum(axis=1) + i, columns.sum(axis=1) + o
        gain -= _xlogx(total_out + n_out) - _xlogx(total_out) + _xlogx(total_in + n_in) - _xlogx(total_in)
        c = int(gain.argmax())
        if gain[c] <= gain[a] + 1e-9:
            c = a
        classes[u] = c
        matrix[c] += out
        matrix[:, c] += into
        matrix[c, c] += loop
    return classes, matrix


_SMALL = 33


def _changes(cells: np.ndarray) -> np.ndarray:
    """[c, x, a]: what c more in cell (a, x) adds to the sum of x log x, for small c; by far the most counts are small."""
    return np.stack([_xlogx(cells.T + c) - _xlogx(cells.T) for c in range(_SMALL)])


def _sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The sum of the rows of each run; runs are mostly short, so those of one length are added together."""
    length = _ends(begin, len(values)) - begin
    out = np.empty((len(begin), values.shape[1]), values.dtype)
    for m in np.unique(length):
        of = np.flatnonzero(length == m)
        total = values[begin[of]]
        if m <= 8:
            for j in range(1, int(m)):
                total += values[begin[of] + j]
        else:
            total = np.stack([values[b : b + m].sum(axis=0) for b in begin[of]])
        out[of] = total
    return out


class Relocation:
    """Where a word goes if it alone moves, under one class matrix.

    Words that stand beside members of their own class are rated as if those stayed where they are.
    """

    def __init__(self, matrix: np.ndarray):
        self.k, free = len(matrix), len(matrix) - 1
        self.sides = []
        for cells in (matrix[:free], matrix[:, :free].T):
            total = cells.sum(axis=1)
            self.sides.append((cells, _changes(cells), total, np.stack([_xlogx(total + c) - _xlogx(total) for c in range(_SMALL)])))
        self._once: np.ndarray | None = None

    def gains(self, own: np.ndarray, after: tuple[np.ndarray, np.ndarray], before: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """[word, class]. ``after`` and ``before`` hold word * classes + class, ascending, and how often that class follows or precedes the word."""
        out = np.zeros((len(own), self.k - 1))
        each = np.arange(len(own))
        for (at, n), (cells, table, total, table_of_total) in zip((after, before), self.sides, strict=True):
            word, met = at // self.k, at % self.k
            for b in range(0, len(at), 50_000):
                w, x, c = word[b : b + 50_000], met[b : b + 50_000], n[b : b + 50_000]
                change = table[np.minimum(c, _SMALL - 1), x]
                big = np.flatnonzero(c >= _SMALL)
                if len(big):
                    cell = cells.T[x[big]]
                    change[big] = _xlogx(cell + c[big, None]) - _xlogx(cell)
                have = cells[own[w], x]
                change[np.arange(len(w)), own[w]] = _xlogx(have) - _xlogx(np.maximum(have - c, 0))
                some, first = np.unique(w, return_index=True)
                out[some] += _sums(change, first)
            size = np.bincount(word, n, minlength=len(own)).astype(np.int64)
            change = table_of_total[np.minimum(size, _SMALL - 1)]
            big = np.flatnonzero(size >= _SMALL)
            if len(big):
                change[big] = _xlogx(total + size[big, None]) - _xlogx(total)
            change[each, own] = _xlogx(total[own]) - _xlogx(np.maximum(total[own] - size, 0))
            out -= change
        return out

    def best(self, own: np.ndarray, after: tuple[np.ndarray, np.ndarray], before: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        out, each = own.copy(), np.arange(len(own))
        gain = self.gains(own, after, before)
        best = gain.argmax(axis=1)
        return np.where(gain[each, best] > gain[each, own] + 1e-9, best, out)

    def once(self) -> np.ndarray:
        """[class after, class before, own]: where a word goes that occurs once; most words do, and for them this is all there is to look up."""
        if self._once is None:
            k, free = self.k, self.k - 1
            (after, table_a, total_a, size_a), (before, table_b, total_b, size_b) = self.sides
            gain = table_a[1][:, None, :] + table_b[1][None, :, :] - size_a[1] - size_b[1]
            less = lambda cells: _xlogx(cells) - _xlogx(np.maximum(cells - 1, 0))
            stay = less(after).T[:, None, :] + less(before).T[None, :, :] - less(total_a) - less(total_b)
            out = np.empty((k, k, free), np.int8)
            for own in range(free):
                with_own = gain.copy()
                with_own[:, :, own] = stay[:, :, own]
                best = with_own.argmax(axis=2)
                better = np.take_along_axis(with_own, best[:, :, None], 2)[:, :, 0] > stay[:, :, own] + 1e-9
                out[:, :, own] = np.where(better, best, own)
            self._once = out
        return self._once


_CONTEXT = "kind int, shard int, words binary, cells binary, counts binary"
_MOVED = "shard int, words binary, classes binary, state binary"


def move_tail(coded: DataFrame, head: Head, classes: Classes, state: DataFrame | None, matrix: np.ndarray, n_shards: int, half: int | None) -> tuple[Classes, DataFrame | None]:
    """The classes after one turn of all words outside the head, or of every other one of them. ``state`` (shard, state) holds the classes of the ids from the limit on.

    Texts are summed to counts of (word, side, class) before the shuffle, so a word that is everywhere costs a task few rows.
    """
    shared, k = coded.sparkSession.sparkContext.broadcast((head, classes, matrix)), len(matrix)
    first = classes.limit // n_shards

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_head, of, _ = shared.value
        counts = _Counts()
        for _, _, _, before, after, left, right in adjoining(batches, of, True):
            for word, cell in ((before, right), (after, k + left)):
                rest = (at_head.find(word) < 0) & (word != END)
                if half is not None:
                    rest &= (word // n_shards + half) % 2 == 0
                counts.add(word[rest] * (2 * k) + cell[rest])
        keys, n = counts.total()
        word = keys // (2 * k)
        order = np.argsort(word % n_shards, kind="stable")
        keys, n, shard = keys[order], n[order], (word % n_shards)[order]
        some, begin = np.unique(shard, return_index=True)
        for s, b, e in zip(some, begin, _ends(begin, len(keys)), strict=True):
            local = keys[b:e] // (2 * k) // n_shards
            yield _records(_CONTEXT, [(1, int(s), _planes(local), (keys[b:e] % (2 * k)).astype(np.uint8).tobytes(), _planes(n[b:e]))])

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, of, now = shared.value
        rule, shard, rare, lists = Relocation(now), -1, np.zeros(0, np.int8), []

        def done() -> pa.RecordBatch:
            if not lists:
                return _records(_MOVED, [(shard, b"", b"", rare.tobytes())])
            keys, where = np.unique(np.concatenate([x for x, _ in lists]), return_inverse=True)
            n = np.bincount(where, np.concatenate([x for _, x in lists])).astype(np.int64)
            word, cell = keys // (2 * k), keys % (2 * k)
            local, at = np.unique(word, return_inverse=True)
            low = local < first
            own = np.empty(len(local), np.int64)
            own[low], own[~low] = of.low[local[low] * n_shards + shard], rare[local[~low] - first]
            right, left = cell < k, cell >= k
            new = own.copy()
            total = np.bincount(at, n)
            once = total == 2
            after, before = np.zeros(len(local), np.int64), np.zeros(len(local), np.int64)
            after[at[right]], before[at[left]] = cell[right], cell[left] - k
            new[once] = rule.once()[after[once], before[once], own[once]]
            more = np.flatnonzero(~once)
            if len(more):
                number = np.full(len(local), -1)
                number[more] = np.arange(len(more))
                sides = []
                for side, base in ((right, 0), (left, k)):
                    mine = side & (number[at] >= 0)
                    sides.append((number[at[mine]] * k + cell[mine] - base, n[mine]))
                new[more] = rule.best(own[more], *sides)
            moved, later = np.flatnonzero((new != own) & low), rare.copy()
            later[local[~low] - first] = new[~low]
            return _records(_MOVED, [(shard, local[moved].astype(np.int32).tobytes(), new[moved].astype(np.int8).tobytes(), later.tobytes())])

        for batch in batches:
            of_shard, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            for i in range(batch.num_rows):
                if of_shard[i] != shard:
                    if shard >= 0:
                        yield done()
                    shard, rare, lists = int(of_shard[i]), np.zeros(0, np.int8), []
                if kind[i] == 0:
                    rare = _array(batch, "words", i, np.int8).copy()
                else:
                    lists.append((_from_planes(batch.column("words")[i].as_buffer()) * (2 * k) + _array(batch, "cells", i, np.uint8), _from_planes(batch.column("counts")[i].as_buffer())))
        if shard >= 0:
            yield done()

    with small_batches(coded.sparkSession, 16):
        sent = map_arrow(_token_columns(coded), run, _CONTEXT)
        if state is not None:
            none = F.lit(None).cast("binary")
            sent = sent.unionByName(state.select(F.lit(0).alias("kind"), "shard", F.col("state").alias("words"), none.alias("cells"), none.alias("counts")))
        moved = map_arrow(sent.repartition(_partitions(coded.sparkSession, n_shards), "shard").sortWithinPartitions("shard", "kind"), move, _MOVED)
        moved = moved if state is None else materialize(moved, "moved_words")
        found = moved.select("shard", "words", "classes").toArrow()
    out = classes.of.copy()
    for i in range(found.num_rows):
        local = np.frombuffer(found.column("words")[i].as_buffer(), np.int32).astype(np.int64)
        out[local * n_shards + found.column("shard")[i].as_py()] = np.frombuffer(found.column("classes")[i].as_buffer(), np.int8)
    shared.unpersist()
    return Classes(out[: classes.limit], int(out[END])), None if state is None else moved.select("shard", "state")


def carry(coded: DataFrame, state: DataFrame, limit: int, n_shards: int) -> DataFrame:
    """The coded texts with the classes of their ids from the limit on, brought from the shards' tables."""
    first, schema = limit // n_shards, _CODED + ", carried binary"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = _array(batch, "ids", i, np.int64)
                high = np.unique(ids[ids >= limit])
                shard = high % n_shards
                order = np.argsort(shard, kind="stable")
                some, begin = np.unique(shard[order], return_index=True)
                for s, b, e in zip(some, begin, _ends(begin, len(order)), strict=True):
                    yield _records("kind int, shard int, key long, ids binary, state binary", [(1, int(s), batch.column("key")[i].as_py(), high[order[b:e]].tobytes(), None)])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = np.zeros(0, np.int8)
        for batch in batches:
            for i, kind in enumerate(batch.column("kind").to_pylist()):
                if kind == 0:
                    rare = _array(batch, "state", i, np.int8).copy()
                else:
                    ids = _array(batch, "ids", i, np.int64)
                    yield _records("key long, asked binary, classes binary", [(batch.column("key")[i].as_py(), ids.tobytes(), rare[ids // n_shards - first].tobytes())])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, parts = None, []

        def done() -> pa.RecordBatch:
            ids = np.frombuffer(row[names.index("ids")], np.int64)
            asked, of = (np.concatenate([np.frombuffer(p[j], t) for p in parts]) if parts else np.zeros(0, t) for j, t in ((0, np.int64), (1, np.int8)))
            order = np.argsort(asked)
            high = ids[ids >= limit]
            return _records(schema, [(*row, of[order][np.searchsorted(asked[order], high)].tobytes())])

        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    if row is not None:
                        yield done()
                    row, parts = tuple(r[c] for c in names), []
                else:
                    parts.append((r["asked"], r["classes"]))
        if row is not None:
            yield done()

    names = [f.split()[0] for f in _CODED.split(", ")]
    none = lambda *columns: [F.lit(None).cast("binary").alias(c) for c in columns]
    with small_batches(coded.sparkSession, 16):
        asked = map_arrow(coded.select("key", "ids"), ask, "kind int, shard int, key long, ids binary, state binary")
        held = state.select(F.lit(0).alias("kind"), "shard", F.lit(0).cast("long").alias("key"), *none("ids"), "state")
        answers = map_arrow(held.unionByName(asked).repartition(_partitions(coded.sparkSession, n_shards), "shard").sortWithinPartitions("shard", "kind"), answer, "key long, asked binary, classes binary")
        own = coded.select(F.lit(0).alias("kind"), *names, *none("asked", "classes"))
        back = answers.select(F.lit(1).alias("kind"), "key", *none(*names[1:]), "asked", "classes")
        whole = own.unionByName(back).repartition(_partitions(coded.sparkSession, n_shards), "key").sortWithinPartitions("key", "kind")
        return materialize(map_arrow(whole, put, schema), "coded_texts", "zstd")


def cluster(coded: DataFrame, head: Head, classes: Classes, state: DataFrame | None, n_words: int, n_shards: int, n_classes: int = CLASSES, rounds: int | None = None) -> tuple:
    """(coded texts, classes, state, class transition counts, likelihood before each round and at the end), the first four at their best.

    The most frequent words found the classes, all others begin in the last one. In each round the head moves, word by word, and then all other words
    do, on counts under the round's first classes. Words don't see what their neighbours did in the same round, so
    after the first round every other word moves at a time, and the best classes seen are kept; the last pass only measures.
    """
    rounds = ROUNDS if rounds is None else rounds
    n = len(head.ids)
    low = classes.low.copy()
    low[head.ids[: n_classes - 1]] = np.arange(min(n_classes - 1, n))
    classes = Classes(low, n_classes)
    coded = coded if state is None else carry(coded, state, classes.limit, n_shards)
    best, values = (coded, classes, state, np.zeros((n_classes + 1, n_classes + 1))), []
    for turn in range(rounds + 1):
        after, before, loops, matrix = head_counts(coded, head, classes, n_classes + 1)
        value = likelihood(matrix)
        if not values or value > max(values):
            best = (coded, classes, state, matrix)
        settled = turn > 1 and value - max(values) < SETTLED * abs(value)
        values.append(value)
        if turn == rounds or settled:
            break
        movable = np.arange(n) if turn == 0 else np.arange(turn % 2, n, 2)
        moved, matrix = exchange(low[head.ids].astype(np.int64), after, before, loops, movable, matrix)
        low = classes.low.copy()
        low[head.ids] = moved
        classes = Classes(low, n_classes)
        if n_words > n:
            classes, state = move_tail(coded, head, classes, state, matrix, n_shards, None if turn == 0 else turn)
            low = classes.low
            coded = coded if state is None else carry(coded, state, classes.limit, n_shards)
            release(coded.sparkSession)
    return *best, values


class ClassModel:
    """What scoring needs besides the coded texts; ``kinds`` are the distinct words of each class."""

    def __init__(self, classes: Classes, matrix: np.ndarray, kinds: np.ndarray, n_ends: int, n_tokens: int, n_types: int, values: list[float]):
        self.classes = classes
        self.n_ends, self.n_tokens, self.n_types, self.values = n_ends, n_tokens, n_types, values
        k = len(matrix)
        into = matrix.sum(axis=0)
        share = (into + 1) / (into.sum() + k)
        self.transition = np.log10((matrix + TRANSITION_PRIOR * share) / (matrix.sum(axis=1, keepdims=True) + TRANSITION_PRIOR))
        self.emission_total = np.log10(into + DELTA * (kinds + 1))
        # The end is the only member of its class and is certain in it; the term that all tokens share is taken out again.
        self.emission_total[k - 1] = np.log10(n_ends + DELTA)


def class_sizes(vocabulary: DataFrame, classes: Classes, state: DataFrame | None, n_classes: int, n_shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct words of each class, the class of each shape: that which most of its words seen once have, for a shape without any that of most such words)."""
    shared, first = vocabulary.sparkSession.sparkContext.broadcast(classes), classes.limit // n_shards
    n_cells = SHAPES * n_classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(n_cells + n_classes, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                n, shape = _array(batch, "counts", i, np.int64), _array(batch, "shapes", i, np.int16).astype(np.int64)
                rare = batch.column("state")[i].as_buffer()
                of = shared.value.low[batch.column("shard")[i].as_py() :: n_shards][: min(first, len(n))]
                of = np.concatenate([of, np.frombuffer(rare, np.int8)] if rare is not None else [of]).astype(np.int64)
                once = np.flatnonzero(n == 1)
                out += np.bincount(np.concatenate([shape[once] * n_classes + of[once], n_cells + of]), minlength=len(out))
        some = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(out[some])], ["at", "n"])

    tables = vocabulary.select("shard", "counts", "shapes")
    tables = tables.withColumn("state", F.lit(None).cast("binary")) if state is None else tables.join(state, "shard", "left")
    with small_batches(vocabulary.sparkSession, 16):
        found = map_arrow(tables, run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n_cells + n_classes, np.int64)
    out[found.column("at").to_numpy()] = found.column("n").to_numpy()
    once = out[:n_cells].reshape(SHAPES, n_classes)
    return out[n_cells:], np.where(once.any(axis=1), once.argmax(axis=1), once.sum(axis=0).argmax()).astype(np.int8)


def word_rows(vocabulary: DataFrame, n_shards: int, most: int | None = None) -> DataFrame:
    """word (hash), id and n of the words of a vocabulary table, or of the ``most`` most frequent ones of each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                word, n = _array(batch, "words", i, np.int64)[:most], _array(batch, "counts", i, np.int64)[:most]
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(np.arange(len(word)) * n_shards + batch.column("shard")[i].as_py()), pa.array(n)], ["word", "id", "n"])

    return map_arrow(vocabulary.select("shard", "words", "counts"), run, "word long, id long, n long")


def fit(docs: DataFrame) -> tuple[ClassModel, DataFrame, DataFrame]:
    """(model of the texts of ``docs`` (doc_id, text, learned) that are learned, their words with ids and counts, coded texts of all rows)."""
    n_bytes, n_ends = docs.agg(F.sum(F.octet_length("text")), F.sum(F.col("learned").cast("long"))).first()
    n_ends = int(n_ends or 0)
    n_shards = max(LEAST_SHARDS, -(-int(n_bytes or 0) // SHARD_BYTES))
    sent = send(docs, n_shards)
    coded, vocabulary = assemble(sent, number(sent, n_shards), n_shards)
    discard(sent)
    release(docs.sparkSession)
    found = vocabulary.select("shard", (F.octet_length("counts") / 8).cast("long").alias("types")).toArrow()
    types = np.zeros(n_shards, np.int64)
    types[found.column("shard").to_numpy()] = found.column("types").to_numpy()
    with small_batches(docs.sparkSession, 16):
        top = word_rows(vocabulary, n_shards, HEAD_WORDS).orderBy(F.desc("n"), "word").limit(HEAD_WORDS).select("id").toArrow()
    head = Head(top.column("id").to_numpy().astype(np.int64))
    # The head's words are the first of their shards, so they are among those whose classes are broadcast.
    rows = int(types.max())
    first = min(rows, max(-(-BROADCAST_WORDS // n_shards), int(head.ids.max()) // n_shards + 1 if len(head.ids) else 0))
    low = np.full((first, n_shards), -1, np.int8)
    low[np.arange(first)[:, None] < types] = CLASSES - 1
    state = None
    if rows > first:
        start = F.expr(f"repeat('{CLASSES - 1:02x}', CAST(greatest(0, octet_length(counts) div 8 - {first}) AS int))")
        state = vocabulary.select("shard", F.unhex(start).alias("state"))
    coded, classes, state, matrix, values = cluster(coded, head, Classes(low.ravel(), CLASSES), state, int(types.sum()), n_shards)
    kinds, shapes = class_sizes(vocabulary, classes, state, len(matrix), n_shards)
    n_tokens, n_types = int(matrix.sum()), int(types.sum()) + (n_ends > 0)
    model = ClassModel(Classes(classes.low, CLASSES, shapes), matrix, kinds, n_ends, n_tokens, n_types, values)
    return model, word_rows(vocabulary, n_shards), coded


def score_texts(coded: DataFrame, model: ClassModel) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of each coded text."""
    shared = coded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch, i, text, _, _, a, b in adjoining(batches, m.classes):
            docs, nulls = _array(batch, "docs", i, np.int64), _array(batch, "nulls", i, np.uint8)
            n = len(docs)
            own = np.bincount(text, m.transition[a, b] - m.emission_total[b], minlength=n)
            base = _array(batch, "base", i, np.float64) + np.log10(m.n_ends + DELTA)
            known = _array(batch, "known", i, np.int64) + (m.n_ends > 0)
            values = (pa.array(docs, pa.int64(), mask=nulls.astype(bool)), np.bincount(text, minlength=n), known, base, own)
            yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in values], ["doc_id", "n_tokens", "n_known", "shared", "own"])

    total = float(np.log10(model.n_tokens + DELTA * (model.n_types + 1)))
    out = map_arrow(coded, run, "doc_id long, n_tokens long, n_known long, shared double, own double")
    return out.select("doc_id", "n_tokens", "n_known", (F.col("shared") - F.col("n_tokens") * F.lit(total)).alias("base_score"), (F.col("shared") + F.col("own")).alias("score"))


def class_scores(docs: DataFrame, folds: int = 10) -> DataFrame:
    """Scores of all rows of ``docs`` (doc_id, text) by a model of those whose fold is not 0.

    log10 P(text) is the sum over its words and one end of log10 P(class | class before) + log10 P(word | class). P(word | class) =
    (c + 0.1) / (class total + 0.1 (class types + 1)), so unknown words have a share in each class; transitions are smoothed with the
    classes' shares. Perplexity of a text is 10 to the power of -score / n_tokens. Every word of every training text is counted and classed, and the vocabulary
    never leaves the executors but for the classes of a bounded number of frequent words.

    A null or empty text is one end. A null id counts as the empty text for its fold. Repeated rows, of which each is one more text, are scored each; ties between words
    of one count are ordered by their hash. Of a very long text a task holds its ids. Other columns, whatever their names, are not read.
    With no training rows every word is unknown. An empty table gives an empty result.
    """
    model, _, coded = fit(docs.select("doc_id", "text", (fold(F.col("doc_id"), folds) != 0).alias("learned")))
    out = score_texts(coded, model)
    return out.select("doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op4_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    return class_scores(read_table(spark, sf_dir, "documents"))
