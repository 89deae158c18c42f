"""A metric partition index: exact searches that skip blocks by the triangle inequality, and approximate ones.

Vectors go to the nearest of a few pivots; a pivot's vectors are cut by id hash into blocks of about ``block_size``.
One row per block is kept small: its pivot, and the least and greatest distance of its vectors from the pivot.  For a
vector at distance ``D`` from a block's pivot, no vector of the block is nearer than ``max(D - rmax, rmin - D)`` and
none is farther than ``D + rmax``.  A search sends a vector only to the blocks that can hold an answer:

* range: blocks whose lower bound is within the radius;
* nearest ``k``: the blocks with the least upper bounds that hold more than ``k`` vectors bound the k-th distance, and
  so does the vector's own block; blocks with a lower bound beyond that are skipped;
* probes (approximate): the blocks of the ``probes`` nearest pivots.

Vectors that visit a block stream past it: the block is the first row of its group after a sort, so a task holds one
block and one piece of visitors however many there are, and a block with many visitors is copied to several groups
(``salt``).  Where nothing can be skipped every vector visits every block and the result is the same.

Where nothing can be skipped a vector visits every block, so their number is bounded: beyond ``MAX_BLOCKS`` blocks of
``block_size`` vectors the blocks are larger instead (``fitting_block``), and what is sent grows with the vectors and not
with their square.  The distances to compute stay those of all pairs there.

What the driver and the tasks hold: pivots (``MAX_PIVOTS`` at most, fitted on ``PIVOT_SAMPLE`` vectors of least id
hash) and the table of blocks (40 bytes for ``block_size`` vectors).  Rows without a vector take no part.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellframe.session import materialize, ship_package

PIVOT_SAMPLE = 4096
MAX_PIVOTS = 512
LLOYD_ROUNDS = 4
MAX_BLOCKS = 32           # blocks of the least size; more vectors make larger blocks
BLOCK_VALUES = 16_000_000  # numbers of a block at most
STRIP_VALUES = 2_000_000  # numbers of a block product held at a time
PIECES_PER_GROUP = 64     # visiting blocks that share one copy of a block
GROUP_VISITORS = 65_536   # vectors that pass by one copy of a block, as far as MAX_COPIES go
MAX_COPIES = 16
ORTHOGONAL = math.sqrt(2.0)  # the distance of unit vectors with cosine 0


def fitting_block(n: int, block_size: int, width: int) -> int:
    """``block_size``, or more for ``MAX_BLOCKS`` blocks of ``n`` vectors, as far as a task holds them."""
    return max(block_size, min(math.ceil(n / MAX_BLOCKS), BLOCK_VALUES // max(1, width)))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances from a matrix product (``slack`` bounds the rounding)."""
    out, product = (a * a).sum(1)[:, None] + (b * b).sum(1), a @ b.T
    product *= 2
    out -= product
    return np.maximum(out, 0, out=out)


def slack(a: np.ndarray, b: np.ndarray) -> float:
    return 1e-11 * (((a * a).sum(1).max() if len(a) else 0) + ((b * b).sum(1).max() if len(b) else 0))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances to full accuracy: products where the vectors are apart, differences where they are close."""
    d2 = squared(a, b)
    near = d2 <= 1e5 * slack(a, b)
    out = np.sqrt(d2)
    r, c = np.nonzero(near)
    out[r, c] = between(a[r], b[c])
    return out


def between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of each row of ``a`` from the same row of ``b``."""
    step = max(1, STRIP_VALUES // max(1, a.shape[1] if a.ndim > 1 else 1))
    return np.concatenate([np.sqrt(((a[i:i + step] - b[i:i + step]) ** 2).sum(1))
                           for i in range(0, len(a), step)] or [np.zeros(0)])


def first_k(rows: np.ndarray, cols: np.ndarray, value: np.ndarray, tie: np.ndarray, k: int):
    """For each row the k columns of least (value, tie)."""
    order = np.lexsort((tie, value, rows))
    rows, cols = rows[order], cols[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[place < k], cols[place < k]


def id_ranks(ids: np.ndarray) -> np.ndarray:
    """Positions of the ids in their sorted order (ids of any type)."""
    return np.unique(ids, return_inverse=True)[1]


def _listed(col: pa.Array) -> np.ndarray:
    """Vectors of a list column as a matrix."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = len(flat) // len(col) if len(col) else 0
    if len(col) and set(np.unique(col.value_lengths().to_numpy(zero_copy_only=False))) != {width}:
        raise ValueError("vectors of different lengths")
    return flat.reshape(len(col), width)


def _packed(col: pa.Scalar, n: int) -> np.ndarray:
    return np.frombuffer(col.as_buffer(), np.float64).reshape(n, -1)


def _binary_rows(m: np.ndarray) -> pa.Array:
    offsets = np.arange(len(m) + 1, dtype=np.int32) * (m.shape[1] * 8 if len(m) else 0)
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(offsets), pa.py_buffer(
        np.ascontiguousarray(m, np.float64).tobytes())])


def unit_rows(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.where(norm > 0, m / np.where(norm == 0, 1, norm), 0.0)


def fit_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """``count`` centres of a sample: farthest points, then a few rounds of means."""
    if not len(sample):
        return np.zeros((0, 0))
    chosen, near = [0], squared(sample, sample[:1])[:, 0]
    while len(chosen) < min(count, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, squared(sample, sample[chosen[-1:]])[:, 0])
    pivots = sample[chosen]
    for _ in range(LLOYD_ROUNDS):
        at = squared(sample, pivots).argmin(1)
        size = np.bincount(at, minlength=len(pivots))
        sums = np.zeros_like(pivots)
        np.add.at(sums, at, sample)
        pivots = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], pivots)
    return pivots


@dataclass
class Blocks:
    """What is known of every block: the row at place b is block b."""

    pivots: np.ndarray
    pivot: np.ndarray   # place of the block's pivot; -1: vectors without a direction
    rmin: np.ndarray
    rmax: np.ndarray
    n: np.ndarray

    def to_pivots(self, m: np.ndarray) -> np.ndarray:
        """Distances of vectors to each block's pivot."""
        if not len(self.pivots):
            return np.full((len(m), len(self.pivot)), ORTHOGONAL)
        d = np.append(np.sqrt(squared(m, self.pivots)), np.full((len(m), 1), ORTHOGONAL), axis=1)
        return d[:, self.pivot]

    def margin(self, m: np.ndarray) -> float:
        return 1e-6 + math.sqrt(1e2 * slack(m, self.pivots)) if len(self.pivots) else 1e-6

    def lower(self, d: np.ndarray) -> np.ndarray:
        return np.maximum(np.maximum(d - self.rmax, self.rmin - d), 0)

    def kth_bound(self, d: np.ndarray, k: int) -> np.ndarray:
        """An upper bound of each vector's k-th distance: blocks of least upper bound that hold k vectors."""
        if self.n.sum() < k:
            return np.full(len(d), np.inf)
        upper = d + self.rmax
        order = upper.argsort(1)
        enough = self.n[order].cumsum(1) >= k
        at = np.take_along_axis(order, enough.argmax(1)[:, None], 1)
        return np.take_along_axis(upper, at, 1)[:, 0]


class MetricIndex:
    """Vectors of a frame in written blocks; ``rows`` is the written table ``id, vec, pivot, dist`` behind them."""

    def __init__(self, rows: DataFrame, blocks: DataFrame, known: Blocks, unit: bool, n: int):
        self.rows, self.blocks, self.known, self.unit, self.n = rows, blocks, known, unit, n
        self.spark = rows.sparkSession
        self.id_type = rows.schema["id"].dataType
        self.shipped = self.spark.sparkContext.broadcast(known)

    def packs(self, vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
        """Vectors from elsewhere as pieces (``block`` -1), to search with."""
        unit = self.unit

        def run(batches):
            for rb in batches:
                if rb.num_rows:
                    m = _listed(rb.column(1))
                    yield _piece(out, -1, rb.column(0), unit_rows(m) if unit else m)

        rows = _vectors(vectors, id_col, vec_col)
        schema = _piece_schema(rows.schema["id"].dataType)
        out = _arrow(schema)
        return rows.mapInArrow(run, schema)

    def own(self) -> DataFrame:
        return self.blocks.select("block", "ids", "mat", F.size("ids").cast("long").alias("n"))


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def _piece_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("block", T.IntegerType()), T.StructField("ids", T.ArrayType(id_type)),
                         T.StructField("mat", T.BinaryType()), T.StructField("n", T.LongType())])


def _piece(schema: pa.Schema, block: int, ids: pa.Array, m: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    cols = [pa.array([block], pa.int32()), lists, pa.array([np.ascontiguousarray(m, np.float64).tobytes()]),
            pa.array([len(ids)], pa.int64())]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema)], schema=schema)


def _vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    ship_package(df.sparkSession)
    return (df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
            .where(F.col("vec").isNotNull()))


def build(df: DataFrame, id_col: str, vec_col: str, block_size: int, unit: bool = False, keep_zero: bool = True,
          pivots: int | None = None) -> MetricIndex:
    """Index the vectors of ``df``.  With ``unit`` they are scaled to length 1, and those without a direction go to
    blocks of their own (left out unless ``keep_zero``); distances then stand for cosines."""
    source = _vectors(df, id_col, vec_col)
    n = source.count()
    head = source.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).select("vec").toArrow()["vec"].combine_chunks()
    sample = _listed(head)
    fitting = fitting_block(n, block_size, sample.shape[1])
    # larger blocks are one a pivot, so that the pivots do not make them as many again
    count = pivots or min(MAX_PIVOTS, max(1, math.ceil((2 if fitting == block_size else 1) * n / fitting)))
    if unit:
        sample = unit_rows(sample)
        sample = sample[(sample != 0).any(1)] if len(sample) else sample
    centres = fit_pivots(sample, count)

    schema = T.StructType([source.schema["id"], *T.StructType.fromDDL("vec binary, pivot int, dist double").fields])
    arrow = _arrow(schema)

    def assign(batches):
        for rb in batches:
            if not rb.num_rows:
                continue
            m = _listed(rb.column(1))
            ids = rb.column(0)
            zero = np.zeros(len(m), bool)
            if unit:
                m = unit_rows(m)
                zero = ~(m != 0).any(1)
                if not keep_zero:
                    m, ids, zero = m[~zero], ids.filter(pa.array(~zero)), zero[~zero]
            at, dist = np.full(len(m), -1), np.zeros(len(m))
            if len(centres):
                step = max(1, STRIP_VALUES // len(centres))
                for lo in range(0, len(m), step):
                    at[lo:lo + step] = squared(m[lo:lo + step], centres).argmin(1)
                dist = between(m, centres[at])
            at[zero], dist[zero] = -1, 0.0
            yield pa.RecordBatch.from_arrays(
                [ids, _binary_rows(m), pa.array(at, pa.int32()), pa.array(dist)], schema=arrow)

    rows = materialize(source.mapInArrow(assign, schema), "metric-rows")
    return _laid_out(rows, centres, fitting, unit, n)


def _laid_out(rows: DataFrame, centres: np.ndarray, block_size: int, unit: bool, n: int) -> MetricIndex:
    """Rows that know their pivot, written as blocks."""
    spark = rows.sparkSession
    size = {r.pivot: r["n"] for r in rows.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = sorted(size)
    parts = [max(1, math.ceil(size[p] / block_size)) for p in places]
    start = np.concatenate([[0], np.cumsum(parts)]).astype(int)
    n_blocks = int(start[-1])
    shift = places[0] if places else 0  # -1 where there are vectors without a direction

    def of_pivot(values: list[int]):
        full = [0] * ((places[-1] - shift + 1) if places else 1)
        for p, v in zip(places, values):
            full[p - shift] = int(v)
        return F.element_at(F.array([F.lit(v) for v in full]), F.col("pivot") - F.lit(shift) + 1)

    block = of_pivot(start[:-1].tolist()) + F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), of_pivot(parts))).cast("int")
    dealt = (rows.withColumn("block", block.cast("int")).repartition(_tasks(spark, n_blocks), "block")
             .sortWithinPartitions("block"))
    packed = T.StructType([*_piece_schema(rows.schema["id"].dataType).fields,
                           *T.StructType.fromDDL("pivot int, rmin double, rmax double").fields])
    blocks = materialize(dealt.select("block", "id", "vec", "pivot", "dist").mapInArrow(_pack(_arrow(packed)), packed),
                         "metric-blocks")
    at = {r.block: r for r in blocks.select("block", "pivot", "rmin", "rmax", "n").collect()}
    known = Blocks(centres, *(np.array([getattr(at[b], c) if b in at else 0 for b in range(n_blocks)])
                              for c in ("pivot", "rmin", "rmax")),
                   np.array([at[b]["n"] if b in at else 0 for b in range(n_blocks)]))
    return MetricIndex(rows, blocks, known, unit, n)


def _tasks(spark, groups: int) -> int:
    """A fixed number of tasks, so that small but costly groups are not put together."""
    return max(1, min(groups, 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _pack(schema: pa.Schema) -> Callable:
    """Rows sorted by block to one row per block."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done():
            t = pa.Table.from_batches(held).combine_chunks()
            dist = t["dist"].to_numpy()
            m = np.frombuffer(b"".join(t["vec"].to_pylist()), np.float64).reshape(t.num_rows, -1)
            ids = t["id"].combine_chunks()
            ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
            cols = [pa.array([t["block"][0].as_py()]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                    pa.array([m.tobytes()]), pa.array([t.num_rows]), pa.array([t["pivot"][0].as_py()]),
                    pa.array([dist.min()]), pa.array([dist.max()])]
            return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema)], schema=schema)

        for rb in batches:
            if not rb.num_rows:
                continue
            block = rb.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for lo, hi in zip(cuts, cuts[1:]):
                if held and held[0].column(0)[0].as_py() != block[lo]:
                    yield done()
                    held = []
                held.append(rb.slice(lo, hi - lo))
        if held:
            yield done()

    return run


#: from a piece (its block, vectors, distances to the blocks' pivots) to the blocks that each vector visits and a
#: bound of the distances that it needs
Choice = Callable[[Blocks, int, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def visits(index: MetricIndex, pieces: DataFrame, choose: Choice) -> DataFrame:
    """Where vectors go: ``home`` (the block visited), ``salt``, ``kind`` 1, and the visiting vectors as a piece."""
    id_type = pieces.schema["ids"].dataType.elementType
    schema = T.StructType([*T.StructType.fromDDL("home int, salt int, kind int").fields,
                           *_piece_schema(id_type).fields, T.StructField("bound", T.BinaryType())])
    arrow, shipped, salts = _arrow(schema), index.shipped, n_salts(index)
    item = arrow.field("ids").type

    def run(batches):
        known = shipped.value
        for rb in batches:
            for r in range(rb.num_rows):
                own, n = rb.column(0)[r].as_py(), rb.column(3)[r].as_py()
                ids, m = rb.column(1)[r].values, _packed(rb.column(2)[r], n)
                step = max(1, STRIP_VALUES // max(1, len(known.pivot)))
                for lo in range(0, n, step):
                    part = m[lo:lo + step]
                    want, bound = choose(known, own, part, known.to_pivots(part))
                    for home in np.flatnonzero(want.any(0)).tolist():
                        who = np.flatnonzero(want[:, home])
                        cols = [[home], [(own if own >= 0 else r) % salts], [1], [own],
                                pa.array([ids.take(pa.array(who + lo)).to_pylist()], item),
                                [np.ascontiguousarray(part[who]).tobytes()], [len(who)], [bound[who].tobytes()]]
                        yield pa.RecordBatch.from_arrays(
                            [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, arrow)],
                            schema=arrow)

    return pieces.select("block", "ids", "mat", "n").mapInArrow(run, schema)


def n_salts(index: MetricIndex) -> int:
    return max(1, math.ceil(len(index.known.pivot) / PIECES_PER_GROUP),
               min(MAX_COPIES, math.ceil(index.n / GROUP_VISITORS)))


#: block and visitors (block, ids, vectors, bounds) to columns of results
Work = Callable[[int, np.ndarray, np.ndarray, int, np.ndarray, np.ndarray, np.ndarray], dict | None]


def meet(index: MetricIndex, visiting: DataFrame, work: Work, schema: T.StructType) -> DataFrame:
    """Let the visitors of every block pass by it; ``work`` gives the result rows."""
    salts = n_salts(index)
    home = index.own().select(
        F.col("block").alias("home"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"),
        F.lit(0).alias("kind"), "block", "ids", "mat", "n", F.lit(None).cast("binary").alias("bound"))
    other = visiting.schema["ids"].dataType
    if other != home.schema["ids"].dataType:  # searchers of another id type: theirs travel in a column of their own
        home = home.withColumn("others", F.lit(None).cast(other))
        visiting = visiting.withColumnRenamed("ids", "others").withColumn("ids", F.lit(None).cast(home.schema["ids"].dataType))
    both = home.unionByName(visiting)
    blocks = len(index.known.pivot)
    tasks = max(_tasks(index.spark, blocks * salts), min(blocks * salts, math.ceil(blocks * index.n / GROUP_VISITORS)))
    dealt = (both.repartition(tasks, "home", "salt")
             .sortWithinPartitions("home", "salt", "kind"))
    arrow, named = _arrow(schema), "others" if "others" in both.columns else "ids"

    def run(batches):
        at = None
        for rb in batches:
            col = {name: rb.column(i) for i, name in enumerate(rb.schema.names)}
            for r in range(rb.num_rows):
                n, kind = col["n"][r].as_py(), col["kind"][r].as_py()
                m = _packed(col["mat"][r], n)
                if kind == 0:
                    at = (col["home"][r].as_py(), col["ids"][r].values.to_numpy(zero_copy_only=False), m.copy())
                    continue
                ids = col[named][r].values.to_numpy(zero_copy_only=False)
                bound = np.frombuffer(col["bound"][r].as_buffer(), np.float64)
                step = max(1, STRIP_VALUES // max(1, len(at[1])))
                for lo in range(0, n, step):
                    part = slice(lo, lo + step)
                    out = work(*at, col["block"][r].as_py(), ids[part], m[part], bound[part])
                    if out is not None and len(out[arrow.names[0]]):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return dealt.mapInArrow(run, schema)


# ------------------------------------------------------------ clusters ----
@dataclass
class Clusters:
    """Bounds of the mean distance from a vector to each cluster, from its centroid and mean squared distance."""

    labels: list
    centroids: np.ndarray
    spread: np.ndarray  # mean squared distance from the centroid


def cluster_statistics(df: DataFrame, vec_col: str, cluster_col: str, max_bytes: int) -> Clusters | None:
    """Centroid and spread of every cluster; None if the centroids are larger than ``max_bytes``."""
    ship_package(df.sparkSession)
    source = (df.select(F.col(cluster_col).alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
              .where(F.col("vec").isNotNull()))
    schema = T.StructType([source.schema["label"], *T.StructType.fromDDL("n long, total binary, square double").fields])
    arrow = _arrow(schema)

    def row(label, n, total, square):
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(
            (label, n, total.tobytes(), square), arrow)], schema=arrow)

    def partial(batches):
        for rb in batches:
            if rb.num_rows:
                m, labels = _listed(rb.column(1)), rb.column(0)
                code = labels.dictionary_encode(null_encoding="encode")
                place = code.indices.to_numpy()
                for i, label in enumerate(code.dictionary.to_pylist()):
                    own = m[place == i]
                    yield row(label, len(own), own.sum(0), float((own * own).sum()))

    def merge(batches):
        at = None
        for rb in batches:
            for label, n, total, square in zip(*[c.to_pylist() for c in rb.columns]):
                total = np.frombuffer(total, np.float64)
                if at is not None and at[0] == label:
                    at = (label, at[1] + n, at[2] + total, at[3] + square)
                else:
                    if at is not None:
                        yield row(*at)
                    at = (label, n, total, square)
        if at is not None:
            yield row(*at)

    merged = materialize(source.mapInArrow(partial, schema).repartition("label").sortWithinPartitions("label")
                         .mapInArrow(merge, schema), "clusters")
    if (merged.agg(F.sum(F.length("total") + 100)).first()[0] or 0) > max_bytes:
        return None
    found = merged.collect()
    n = np.array([r["n"] for r in found], float)
    centroids = np.array([np.frombuffer(bytes(r["total"]), np.float64) for r in found]) / n[:, None] if found else np.zeros((0, 0))
    square = np.array([r["square"] for r in found])
    spread = np.maximum(square / n - (centroids ** 2).sum(1), 0) if found else np.zeros(0)
    return Clusters([r["label"] for r in found], centroids, spread)


def build_by_cluster(df: DataFrame, id_col: str, vec_col: str, cluster_col: str, clusters: Clusters,
                     block_size: int) -> MetricIndex:
    """Index whose pivots are the clusters' centroids; a vector belongs to its cluster, not to the nearest one."""
    ship_package(df.sparkSession)
    source = (df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"),
                        F.col(cluster_col).alias("label")).where(F.col("vec").isNotNull()))
    place = {label: i for i, label in enumerate(clusters.labels)}
    centroids = clusters.centroids
    schema = T.StructType([source.schema["id"], *T.StructType.fromDDL("vec binary, pivot int, dist double").fields])
    arrow = _arrow(schema)

    def assign(batches):
        for rb in batches:
            if rb.num_rows:
                m = _listed(rb.column(1))
                at = np.array([place[x] for x in rb.column(2).to_pylist()], np.int32)
                yield pa.RecordBatch.from_arrays(
                    [rb.column(0), _binary_rows(m), pa.array(at), pa.array(between(m, centroids[at]))], schema=arrow)

    rows = materialize(source.mapInArrow(assign, schema), "metric-rows")
    n = rows.count()
    width = centroids.shape[1] if len(centroids) else 0
    return _laid_out(rows, centroids, fitting_block(n, block_size, width), False, n)


def rival_clusters(spread: np.ndarray) -> Choice:
    """The own cluster, and others that may have the least mean distance.

    The mean distance to a cluster is never below the distance to its centroid (convexity) and never above the root
    of the mean squared distance, which is the squared distance to the centroid plus the spread.
    """
    def choose(known, own, m, d):
        to = np.sqrt(squared(m, known.pivots))
        others = np.arange(to.shape[1]) != known.pivot[own]
        upper = np.where(others[None, :], np.sqrt(to ** 2 + spread), np.inf).min(1)
        want = (to <= (upper + 2 * known.margin(m))[:, None]) | ~others[None, :]
        return want[:, known.pivot], upper
    return choose


# ------------------------------------------------------------ searches ----
def within(radius: float) -> Choice:
    """Blocks that can hold a vector within ``radius``; each pair of blocks meets once (from the lower number)."""
    def choose(known, own, m, d):
        want = known.lower(d) <= radius + known.margin(m)
        if own >= 0:
            want[:, :own] = False
        return want, np.full(len(m), radius)
    return choose


def nearest(k: int) -> Choice:
    """Blocks that can hold one of the ``k`` nearest, the vector itself not counted."""
    def choose(known, own, m, d):
        bound = known.kth_bound(d, k + 1) + known.margin(m)
        if own >= 0 and len(m) > k:  # the piece itself holds k others
            kth, step = np.empty(len(m)), max(1, STRIP_VALUES // len(m))
            for lo in range(0, len(m), step):
                d2 = squared(m[lo:lo + step], m)
                d2.partition(k, axis=1)
                kth[lo:lo + step] = d2[:, k]
            bound = np.minimum(bound, np.sqrt(kth + slack(m, m)))
        return known.lower(d) <= bound[:, None] + known.margin(m), bound
    return choose


def probing(probes: int) -> Choice:
    """The blocks of the nearest pivots: an approximate search."""
    def choose(known, own, m, d):
        near = np.sqrt(squared(m, known.pivots))
        order = near.argsort(1, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :], 1)
        want = np.append(rank, np.full((len(m), 1), 0), axis=1)[:, known.pivot] < probes
        return want, np.full(len(m), np.inf)
    return choose


def routed_rows(index: MetricIndex, visiting: DataFrame) -> DataFrame:
    """One row: vectors indexed, blocks, vectors sent (visitors and copies of blocks), and distances to compute."""
    sizes = index.blocks.select(F.col("block").alias("home"), F.col("n").alias("home_n"))
    v = visiting.select("home", "n").join(sizes, "home")
    copies = index.n * n_salts(index)
    return v.agg((F.coalesce(F.sum("n"), F.lit(0)) + F.lit(copies)).alias("routed"),
                 F.coalesce(F.sum(F.col("n") * F.col("home_n")), F.lit(0)).alias("distances")).select(
        F.lit(index.n).cast("long").alias("n"), F.lit(len(index.known.pivot)).cast("long").alias("blocks"),
        "routed", "distances")
