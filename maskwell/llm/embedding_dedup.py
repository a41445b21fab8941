"""Near-duplicate vectors by an epsilon grid order join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskwell.llm.common import materialize, small_batches
from maskwell.llm.components import Merging, components
from maskwell.shipping import map_arrow
from maskwell.sources.tables import read_table

THRESHOLD = 0.98
#: Leading principal dimensions of the grid and of the boxes; any orthonormal ones give the same result, these skip most.
DIMENSIONS = 16
#: Vectors the principal dimensions are fitted on, those with the smallest hashes.
FIT_ROWS = 4096
#: Vectors of an interval that is moved as a whole, and of a block inside it.
INTERVAL_ROWS, BLOCK_ROWS = 65536, 256
#: Intervals that one interval of the next level joins, and how many of a stratum may meet at the topmost level.
FAN, TOP = 16, 64


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding, width and ``ok``: whether the vector can link at all."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    ok = v.isNotNull() & F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists(v, lambda x: x != 0)
    return vectors.select("vec_id", F.col("label").cast("string").alias("label"), "embedding", F.coalesce(F.size(v), F.lit(-1)).alias("width"), F.coalesce(ok, F.lit(False)).alias("ok"))


def principal_axes(vectors: DataFrame, k: int, rows: int = FIT_ROWS) -> dict[int, np.ndarray]:
    """For each width, orthonormal axes (width x k) of greatest variance among unit vectors of a bounded sample."""
    sample = vectors.orderBy(F.xxhash64("point")).limit(rows).select("width", "embedding").toPandas()
    out = {}
    for width, part in sample.groupby("width"):
        x = _unit(np.stack(part["embedding"].to_list()).astype(np.float64))
        values, axes = np.linalg.eigh(np.cov(x.T) if len(x) > 1 and width > 1 else np.eye(int(width)))
        out[int(width)] = axes[:, np.argsort(-values)][:, :k]
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    # Halving exponents first keeps tiny and huge vectors from under- or overflowing.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _project(unit: np.ndarray, axes: dict[int, np.ndarray], k: int) -> np.ndarray:
    """Coordinates on the leading axes, zeros where the vectors have fewer. Widths outside the sample use their first coordinates."""
    width = unit.shape[1]
    base = axes.get(width)
    base = np.eye(width)[:, :k] if base is None else base
    out = np.zeros((len(unit), k))
    out[:, : base.shape[1]] = unit @ base
    return out


def grid_intervals(points: DataFrame, axes: dict[int, np.ndarray], epsilon: float, k: int, interval_rows: int, element: str) -> DataFrame:
    """The vectors in epsilon grid order, cut into intervals: interval (ascending in that order), stratum (label and width), width, the corners lo0.. and
    hi0.. of its box on the leading axes, and its points, copies and vectors.

    The grid's cells have the side epsilon on the leading axes. A label with at most ``interval_rows`` vectors is one interval, dealt out as a whole. Larger
    ones are sorted by cells by range over all tasks, with a hash as the last key, so that one crowded cell is cut as well.
    """
    spark = points.sparkSession
    shared = spark.sparkContext.broadcast(axes)
    side = max(epsilon, 2.0**-14)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = np.asarray(batch.column("width"))
            keys = np.empty(batch.num_rows, object)
            for width in np.unique(widths):
                at = np.flatnonzero(widths == width)
                where = _project(_unit(_matrix(batch.column("embedding").take(pa.array(at)), int(width))), shared.value, k)
                cells = (np.floor(where / side) + 32768).astype(">u2")
                keys[at] = [row.tobytes() for row in cells]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys.tolist(), pa.binary())], [*batch.schema.names, "cells"])

    kind = f"array<{element}>"
    named = points.select("point", "copies", "label", "width", F.col("embedding").cast(kind).alias("embedding"))
    # At most one large label for each interval_rows vectors.
    sizes = materialize(named.groupBy(F.col("label").alias("_l"), F.col("width").alias("_w")).agg(F.count(F.lit(1)).alias("n")), "label_sizes")
    large = sizes.filter(F.col("n") > interval_rows)
    n_all, n_large = (x or 0 for x in sizes.agg(F.sum("n"), F.sum(F.when(F.col("n") > interval_rows, F.col("n")))).first())
    n_parts = max(spark.sparkContext.defaultParallelism, n_all // (4 * interval_rows))
    order = ["label", "width", "cells", "_h"]
    with small_batches(spark, 2048):
        # Written, as sorting by range samples its input first.
        placed = materialize(map_arrow(named, place, f"point long, copies long, label string, width int, embedding {kind}, cells binary").withColumn("_h", F.xxhash64("point")), "grid")
    marked = placed.join(F.broadcast(large), (F.col("label") == F.col("_l")) & (F.col("width") == F.col("_w")), "left")
    whole = marked.filter("_l IS NULL").repartition(n_parts, "label", "width").sortWithinPartitions(*order)
    ranges = marked.filter("_l IS NOT NULL").repartitionByRange(max(1, -(-n_large // interval_rows)), *order).sortWithinPartitions(*order)
    held = np.float32 if element == "float" else np.float64

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        rows: list[pa.RecordBatch] = []

        def emit() -> pa.RecordBatch:
            nonlocal number
            table = pa.Table.from_batches(rows).combine_chunks()
            width = table.column("width")[0].as_py()
            vectors = np.ascontiguousarray(table.column("embedding").combine_chunks().flatten().to_numpy(), held)
            where = _project(_unit(vectors.reshape(-1, width).astype(np.float64)), shared.value, k)
            blobs = [np.asarray(table.column("point"), np.int64), np.asarray(table.column("copies"), np.int64), vectors]
            corners = [pa.array([float(x)]) for x in (*where.min(axis=0), *where.max(axis=0))]
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([f"{table.column('label')[0].as_py()}/{width}"]), pa.array([width], pa.int32()), *corners, *(pa.array([x.tobytes()], pa.binary()) for x in blobs)], [f.split()[0] for f in schema.split(", ")])

        size, now = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            label, width = np.asarray(batch.column("label").to_pylist(), object), np.asarray(batch.column("width"))
            new = np.flatnonzero((label[1:] != label[:-1]) | (width[1:] != width[:-1])) + 1
            for begin, end in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows], strict=True):
                if rows and (label[begin], width[begin]) != now:
                    yield emit()
                    rows, size = [], 0
                now = (label[begin], width[begin])
                while begin < end:
                    part = batch.slice(begin, min(end - begin, interval_rows - size))
                    rows.append(part)
                    begin, size = begin + part.num_rows, size + part.num_rows
                    if size == interval_rows:
                        yield emit()
                        rows, size = [], 0
        if rows:
            yield emit()

    schema = "interval long, stratum string, width int, " + ", ".join(f"{c}{i} double" for c in ("lo", "hi") for i in range(k)) + ", points binary, copies binary, vectors binary"
    columns = ["point", "copies", "label", "width", "embedding"]
    with small_batches(spark, 2048):
        found = map_arrow(whole.select(*columns), cut, schema)
        if n_large:
            cut_up = map_arrow(ranges.select(*columns), cut, schema).withColumn("interval", F.col("interval") + F.lit(1 << 61))
            found = found.unionByName(cut_up)
        return materialize(found, "intervals")


def _apart(k: int) -> Column:
    """Squared distance of the boxes of a and b."""
    out = F.lit(0.0)
    for i in range(k):
        gap = F.greatest(F.lit(0.0), F.col(f"a.lo{i}") - F.col(f"b.hi{i}"), F.col(f"b.lo{i}") - F.col(f"a.hi{i}"))
        out = out + gap * gap
    return out


def interval_pairs(intervals: DataFrame, epsilon: float, k: int, fan: int = FAN, top: int = TOP) -> DataFrame:
    """(left, right), left < right, of all intervals whose boxes are not provably farther than epsilon apart.

    The sequence of intervals is joined recursively: pairs of long intervals come first, at most ``top`` a stratum, and a pair that may be near
    is split into the pairs of its parts, ``fan`` on each side, until single intervals are left. Only boxes are moved.
    """
    corners = [f"{c}{i}" for c in ("lo", "hi") for i in range(k)]
    one = intervals.select("interval", "stratum", *corners).withColumn("at", F.row_number().over(Window.partitionBy("stratum").orderBy("interval")) - 1)
    one = materialize(one, "boxes")
    most = one.agg(F.max("at")).first()[0]
    if not most:
        return intervals.sparkSession.createDataFrame([], "left long, right long")
    depth = 0
    while most // fan**depth >= top:
        depth += 1

    def boxes(level: int) -> DataFrame:
        if level == 0:
            return one.select("stratum", "at", *corners)
        sides = [(F.min if c.startswith("lo") else F.max)(c).alias(c) for c in corners]
        return one.groupBy("stratum", F.expr(f"at div {fan**level}").alias("at")).agg(*sides)

    near = _apart(k) <= F.lit(epsilon * epsilon)
    level = boxes(depth)
    found = level.alias("a").join(level.alias("b"), (F.col("a.stratum") == F.col("b.stratum")) & (F.col("a.at") <= F.col("b.at"))).filter(near)
    found = found.select(F.col("a.stratum").alias("stratum"), F.col("a.at").alias("x"), F.col("b.at").alias("y"))
    for step in range(depth - 1, -1, -1):
        found, level = materialize(found, "interval_pairs"), boxes(step)
        parts = lambda c: F.explode(F.sequence(F.col(c) * fan, F.col(c) * fan + fan - 1))
        found = found.withColumn("x", parts("x")).withColumn("y", parts("y")).filter("x <= y").alias("p")
        found = found.join(level.alias("a"), (F.col("p.stratum") == F.col("a.stratum")) & (F.col("p.x") == F.col("a.at")))
        found = found.join(level.alias("b"), (F.col("p.stratum") == F.col("b.stratum")) & (F.col("p.y") == F.col("b.at"))).filter(near)
        found = found.select(F.col("p.stratum").alias("stratum"), "x", "y")
    name = lambda c, to: one.select(F.col("stratum").alias(f"_{to}"), F.col("at").alias(c), F.col("interval").alias(to))
    left, right = name("x", "left"), name("y", "right")
    found = found.filter("x < y").join(left, (F.col("stratum") == F.col("_left")) & (found["x"] == left["x"])).select("stratum", found["y"], "left")
    return found.join(right, (F.col("stratum") == F.col("_right")) & (found["y"] == right["y"])).select("left", "right")


def near_pairs(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], same: bool, limit: float) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) of boxes (low, high) of two sequences that aren't provably over ``limit`` apart; of one sequence with itself only i <= j.

    Runs of boxes that are too far apart are skipped whole; others are halved, the longer one first.
    """
    (low_a, high_a), (low_b, high_b) = a, b
    stack = [((0, len(low_a)), (0, len(low_b)))]
    while stack:
        (a0, a1), (b0, b1) = stack.pop()
        if a0 >= a1 or b0 >= b1 or same and b1 <= a0:
            continue
        gap = np.maximum(0, np.maximum(low_a[a0:a1].min(axis=0) - high_b[b0:b1].max(axis=0), low_b[b0:b1].min(axis=0) - high_a[a0:a1].max(axis=0)))
        if float((gap * gap).sum()) > limit * limit:
            continue
        if a1 - a0 == 1 and b1 - b0 == 1:
            if not same or a0 <= b0:
                yield a0, b0
        elif a1 - a0 >= b1 - b0:
            m = (a0 + a1) // 2
            stack += [((a0, m), (b0, b1)), ((m, a1), (b0, b1))]
        else:
            m = (b0 + b1) // 2
            stack += [((a0, a1), (b0, m)), ((a0, a1), (m, b1))]


class _Interval:
    """An interval's vectors, their projections and the boxes of its blocks."""

    def __init__(self, points: bytes, copies: bytes, vectors: bytes, width: int, held: type, axes: dict, k: int, block_rows: int):
        self.points, self.copies = np.frombuffer(points, np.int64), np.frombuffer(copies, np.int64)
        self.unit = _unit(np.frombuffer(vectors, held).reshape(-1, width).astype(np.float64))
        where = _project(self.unit, axes, k)
        self.where, self.square = where.astype(np.float32), (where * where).sum(axis=1).astype(np.float32)
        self.blocks = [slice(b, min(b + block_rows, len(where))) for b in range(0, len(where), block_rows)]
        self.low, self.high = (np.stack([f(where[s], axis=0) for s in self.blocks]) for f in (np.min, np.max))


def join_intervals(a: _Interval, b: _Interval, threshold: float, epsilon: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(point, links, low) of vectors with links between two intervals, or in one: links counts the partners' copies, and ``low`` is one point
    for all that are connected here.

    Blocks that may be near are compared on the leading dimensions in single precision, with room for its error, and then, if any pair is left, in double
    precision on whole vectors.
    """
    same, n = a is b, len(a.points)
    links = np.zeros(n, np.int64), np.zeros(len(b.points), np.int64)
    merging = Merging(n if same else n + len(b.points))
    room = np.float32(epsilon * epsilon + 1e-4)
    for i, j in near_pairs((a.low, a.high), (b.low, b.high), same, epsilon):
        x, y = a.blocks[i], b.blocks[j]
        close = a.square[x, None] + b.square[None, y] - 2 * (a.where[x] @ b.where[y].T) <= room
        if same and i == j:
            np.fill_diagonal(close, False)
        if not close.any():
            continue
        hit = a.unit[x] @ b.unit[y].T >= threshold
        if same and i == j:
            np.fill_diagonal(hit, False)
        if not hit.any():
            continue
        links[0][x] += hit @ b.copies[y]
        if not same:
            links[1][y] += a.copies[x] @ hit
        elif i != j:
            links[0][y] += a.copies[x] @ hit
        merging.link(hit, x, y if same else slice(y.start + n, y.stop + n))
    points = a.points if same else np.concatenate([a.points, b.points])
    total = links[0] if same else np.concatenate(links)
    at = np.flatnonzero(total)
    if len(at):
        yield points[at], total[at], points[merging.roots()[at]]


def interval_links(intervals: DataFrame, pairs: DataFrame, axes: dict[int, np.ndarray], threshold: float, epsilon: float, k: int, block_rows: int, element: str) -> DataFrame:
    """(point, links, low) of all intervals with themselves, which are read where they lie, and of all pairs, for which they are moved."""
    spark = intervals.sparkSession
    shared = spark.sparkContext.broadcast(axes)
    held = np.float32 if element == "float" else np.float64

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                sides = [_Interval(r[f"points_{s}"], r[f"copies_{s}"], r[f"vectors_{s}"], r["width"], held, shared.value, k, block_rows) for s in "lr" if f"points_{s}" in r]
                for columns in join_intervals(sides[0], sides[-1], threshold, epsilon):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["point", "links", "low"])

    side = lambda name, s: intervals.select(F.col("interval").alias(name), "width", *(F.col(c).alias(f"{c}_{s}") for c in ("points", "copies", "vectors")))
    schema = "point long, links long, low long"
    both = pairs.join(side("left", "l"), "left").join(side("right", "r").drop("width"), "right").drop("left", "right")
    return map_arrow(side("left", "l").drop("left"), compare, schema).unionByName(map_arrow(both, compare, schema))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, dimensions: int = DIMENSIONS, interval_rows: int = INTERVAL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of ``vectors`` (vec_id, label, embedding).

    Two vectors are linked if their labels are equal, their widths too, and their cosine in double precision is at least
    ``threshold`` (over 0). On the unit sphere that is a distance of at most epsilon = sqrt(2 - 2 threshold), and a projection on orthonormal
    axes only shortens distances, so intervals and blocks whose boxes are farther apart hold no link. Results are exact.

    Equal vectors of a label are one point with a number of copies, so a hot vector costs one row after the first aggregation. A row is known by
    its vector, not by its id: rows that repeat a vec_id are vectors of their own, and component_id is the smallest vec_id of the component.
    A vector that is null, zero or holds nulls or non-finite numbers, or has no label, links with nothing and is its own component. So does a row without
    vec_id, whose component is null and which is kept. Ties do not occur: links and components are sets. Other columns, whatever
    their names, are not read. Empty tables give empty results.
    """
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    element = element if element == "float" else "double"
    # Two hashes of the vector with different seeds, 128 bits, stand for it.
    keyed = valid_vectors(vectors).withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(7), "embedding"))
    key = ["label", "width", "h1", "h2"]
    groups = keyed.filter("ok").groupBy(*key).agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"))
    points = materialize(groups.withColumn("point", F.monotonically_increasing_id()), "points")
    epsilon = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    axes = principal_axes(points, dimensions)
    intervals = grid_intervals(points, axes, epsilon, dimensions, interval_rows, element)
    pairs = materialize(interval_pairs(intervals, epsilon, dimensions), "interval_pairs")
    with small_batches(vectors.sparkSession, 1):
        links = materialize(interval_links(intervals, pairs, axes, threshold, epsilon, dimensions, block_rows, element), "links")
    per_point = links.groupBy("point").agg(F.sum("links").alias("links"))
    parts = components(links.select(F.col("point").alias("a"), F.col("low").alias("b"))).withColumnRenamed("node", "point")
    known = points.select(*key, "point", "id", "copies").join(per_point, "point", "left").join(parts, "point", "left")
    linked = known.filter("component IS NOT NULL")
    smallest = linked.groupBy("component").agg(F.min("id").alias("smallest"))
    known = known.join(smallest, "component", "left")
    known = known.select(*(F.col(c).alias(f"_{c}") for c in key), "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("smallest", "id").alias("smallest"))
    known = materialize(known, "classes")
    own = F.col("ok")
    for c in key:
        own = own & (F.col(c) == F.col(f"_{c}"))
    out = keyed.join(known, own, "left")
    component = F.coalesce(F.col("smallest"), F.col("vec_id"))
    n_links = F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long")
    return out.select("vec_id", n_links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))


#: Exact, by all pairs of a label.
_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(node, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.y, r.root FROM r JOIN l ON r.node = l.x),
m AS (SELECT node, min(root) AS component_id FROM r GROUP BY node),
k AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
SELECT m.node AS vec_id, CAST(coalesce(k.n_links, 0) AS BIGINT) AS n_links, m.component_id, m.node = m.component_id AS kept FROM m LEFT JOIN k ON m.node = k.x
"""

SQL = {"op9_embedding_dedup": _SQL}
