"""Searches over vector tables (J-09, J-11, J-12, M-13, W-01).

Network, nearest neighbours, similarity search and silhouette run on the
metric partition index (``operators/metric.py``): a vector meets only the
blocks that the triangle inequality cannot rule out, so the answers are
exact and the work falls with the structure of the data.  ``knn_approx``
looks at the nearest lists only, as many as a measured recall needs.

``cluster_distance_sums`` is the plain blocked form (every block meets
every block): the silhouette uses it where the clusters' centroids do not
fit a broadcast.  Vectors are hashed into ``nb`` blocks of about
``block_size`` rows, so a group holds at most ``2 * block_size`` rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellframe.operators import metric
from cellframe.operators.metric import first_k, id_ranks
from cellframe.session import tasks_for

DEFAULT_BLOCK = 2048
STRIP_VALUES = 8_000_000   # differences (float64) held at a time in a block product
CENTROID_BYTES = 64 << 20  # clusters' centroids broadcast for the silhouette
RECALL_SAMPLE = 256        # vectors of least hash on which the number of probes is fitted


def _route(df: DataFrame, id_col: str, vec_col: str, block_size: int, extra: dict | None = None) -> DataFrame:
    from cellframe.session import ship_package
    ship_package(df.sparkSession)
    n = df.count()
    nb = max(1, math.ceil(n / block_size))
    extra = extra or {}
    names = list(extra)
    b = F.pmod(F.xxhash64(F.col("id")), F.lit(nb)).cast("int")
    base = (df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"),
                      *[c.alias(n) for n, c in extra.items()]).withColumn("_b", b))
    j = F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias("_j")
    routed = base.select("*", j)
    return routed.select(
        F.least("_b", "_j").alias("bi"), F.greatest("_b", "_j").alias("bj"),
        (F.col("_b") != F.least("_b", "_j")).cast("int").alias("side"),
        "id", "vec", *names)


def _split(pdf: pd.DataFrame):
    bi, bj = int(pdf["bi"].iloc[0]), int(pdf["bj"].iloc[0])
    left = pdf[pdf["side"] == 0]
    right = left if bi == bj else pdf[pdf["side"] == 1]
    return bi == bj, left, right


def _mat(s: pd.Series) -> np.ndarray:
    if len(s) == 0:
        return np.zeros((0, 0))
    return np.stack([np.asarray(v, dtype=np.float64) for v in s.to_numpy()])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, row strip by row strip: the differences held at a time stay under STRIP_VALUES."""
    out = np.empty((len(a), len(b)))
    step = max(1, STRIP_VALUES // max(1, b.size))
    for lo in range(0, len(a), step):
        out[lo:lo + step] = np.sqrt(((a[lo:lo + step, None, :] - b[None, :, :]) ** 2).sum(axis=2))
    return out


def _pairs_schema(df: DataFrame, id_col: str, value: str, names: tuple[str, str] = ("src", "dst")) -> T.StructType:
    kind = df.schema[id_col].dataType
    return T.StructType([*[T.StructField(n, kind) for n in names], T.StructField(value, T.DoubleType())])


def cosine_pairs(df: DataFrame, id_col: str, vec_col: str, threshold: float,
                 block_size: int = DEFAULT_BLOCK, self_loops: bool = True) -> DataFrame:
    """Unordered pairs (src <= dst) with cosine >= threshold and cosine != 0.

    Self pairs are included (a vector is similar to itself) unless
    ``self_loops`` is false.  A zero vector has cosine 0 with everything.
    On unit vectors a cosine of t is a distance of sqrt(2 - 2t), so this is
    a range search; each pair of blocks meets once.
    """
    index = metric.build(df, id_col, vec_col, block_size, unit=True, keep_zero=False)
    radius = math.sqrt(max(0.0, 2 - 2 * threshold))

    def work(home, ids, m, own, q, qm, bound):
        s = qm @ m.T
        keep = (s >= threshold) & (s != 0)
        if own == home:
            keep &= (q[:, None] <= ids[None, :]) if self_loops else (q[:, None] < ids[None, :])
        elif not self_loops:
            keep &= q[:, None] != ids[None, :]
        r, c = np.nonzero(keep)
        src, dst = q[r], ids[c]
        low = src <= dst
        return {"src": np.where(low, src, dst), "dst": np.where(low, dst, src), "sim": s[r, c]}

    return metric.meet(index, metric.visits(index, index.own(), metric.within(radius)), work,
                       _pairs_schema(df, id_col, "sim"))


def _nearest_work(k: int):
    def work(home, ids, m, own, q, qm, bound):
        d2, room = metric.squared(qm, m), metric.slack(qm, m)
        kk = min(k + 1, len(ids))  # one more: the vector itself may be among them
        limit = np.minimum(np.partition(d2, kk - 1, axis=1)[:, kk - 1] + 2 * room,
                           (bound + 1e-6 + math.sqrt(room)) ** 2)
        r, c = np.nonzero(d2 <= limit[:, None])
        other = q[r] != ids[c]
        r, c = r[other], c[other]
        dist = np.full(d2.shape, np.inf)
        dist[r, c] = metric.between(qm[r], m[c])
        r, c = first_k(r, c, dist[r, c], id_ranks(ids)[c], k)
        return {"src": q[r], "dst": ids[c], "dist": dist[r, c]}
    return work


def _least(candidates: DataFrame, by: str, k: int, *order: str | Column) -> DataFrame:
    """Rank within ``by``; Spark cuts the candidates to k per group before it shuffles them."""
    w = Window.partitionBy(by).orderBy(*order)
    return (candidates.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .withColumn("rank", F.col("rank").cast("int")))


def _search(index: metric.MetricIndex, pieces: DataFrame, k: int, choice) -> DataFrame:
    kind = index.id_type
    schema = T.StructType([T.StructField("src", kind), T.StructField("dst", kind), T.StructField("dist", T.DoubleType())])
    found = metric.meet(index, metric.visits(index, pieces, choice), _nearest_work(k), schema)
    # a vector meets at most one copy of each block in a task, so there is little to cut before the shuffle
    tasks = tasks_for(index.spark, index.n * len(index.known.pivot) * k)
    return _least(found.repartition(tasks, "src"), "src", k, "dist", "dst")


def knn(df: DataFrame, id_col: str, vec_col: str, k: int, block_size: int = DEFAULT_BLOCK,
        queries: DataFrame | None = None) -> DataFrame:
    """k nearest neighbours by Euclidean distance, self excluded: (src, dst, dist, rank).

    With ``queries`` (same columns) only those vectors are searched for.
    Ties are broken by the smaller neighbour id.  A vector's bound on its
    k-th distance comes from its own block and from the blocks' radii;
    blocks beyond it are not visited.
    """
    index = metric.build(df, id_col, vec_col, block_size)
    pieces = index.own() if queries is None else index.packs(queries, id_col, vec_col)
    return _search(index, pieces, k, metric.nearest(k))


def knn_routing(df: DataFrame, id_col: str, vec_col: str, k: int, block_size: int = DEFAULT_BLOCK) -> DataFrame:
    """One row (n, blocks, routed, distances): the work of ``knn`` on these vectors."""
    index = metric.build(df, id_col, vec_col, block_size)
    return metric.routed_rows(index, metric.visits(index, index.own(), metric.nearest(k)))


def fit_probes(index: metric.MetricIndex, df: DataFrame, id_col: str, vec_col: str, k: int, recall: float,
               sample: int = RECALL_SAMPLE) -> int:
    """The least number of lists whose nearest neighbours reach ``recall`` on a bounded sample.

    ``sample`` vectors of least hash are searched for exactly; each true
    neighbour's list has a rank among the lists of its vector.
    """
    asked = df.select(id_col, vec_col).where(F.col(vec_col).isNotNull()).orderBy(
        F.xxhash64(F.lit("probes"), F.col(id_col)), id_col).limit(sample)
    found = _search(index, index.packs(asked, id_col, vec_col), k, metric.nearest(k))
    lists = found.join(index.rows.select(F.col("id").alias("dst"), "pivot"), "dst").select("src", "pivot").collect()
    vectors = {r[0]: np.asarray(r[1], float) for r in asked.collect()}
    if not lists:
        return 1
    ranks = {i: np.argsort(np.argsort(metric.squared(v[None, :], index.known.pivots)[0], kind="stable"))
             for i, v in vectors.items()}
    need = np.sort([ranks[r["src"]][r["pivot"]] for r in lists])
    return int(need[max(0, math.ceil(recall * len(need)) - 1)]) + 1


def knn_approx(df: DataFrame, id_col: str, vec_col: str, k: int, recall: float = 0.95, probes: int | None = None,
               lists: int | None = None, block_size: int = DEFAULT_BLOCK, queries: DataFrame | None = None) -> DataFrame:
    """As ``knn``, looking only at the lists of the ``probes`` nearest centres (an inverted-file index).

    The centres (``lists`` of them, by default the root of the number of
    vectors, 512 at most) are fitted on a bounded sample; every vector is in
    the list of its nearest centre.  Without ``probes`` their number is
    fitted to ``recall`` by ``fit_probes``.
    """
    n = df.where(F.col(vec_col).isNotNull()).count()
    index = metric.build(df, id_col, vec_col, block_size,
                         pivots=lists or min(metric.MAX_PIVOTS, max(1, math.isqrt(n))))
    pieces = index.own() if queries is None else index.packs(queries, id_col, vec_col)
    return _search(index, pieces, k, metric.probing(probes or fit_probes(index, df, id_col, vec_col, k, recall)))


def recall_of(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row (n_queries, n_pairs, recall): the share of the exact pairs that were found."""
    hit = exact.select("src", "dst").join(found.select("src", "dst").withColumn("hit", F.lit(1)), ["src", "dst"], "left")
    return hit.agg(F.count_distinct("src").alias("n_queries"), F.count(F.lit(1)).alias("n_pairs"),
                   F.try_divide(F.sum(F.coalesce("hit", F.lit(0))), F.count(F.lit(1))).alias("recall"))


def cluster_distance_sums(df: DataFrame, id_col: str, vec_col: str, cluster_col: str,
                          block_size: int = DEFAULT_BLOCK) -> DataFrame:
    """(id, cluster, other_cluster, dist_sum, n): Euclidean distance sums from each
    row to every cluster, self excluded; each block pair emits one row per
    (row, cluster present in the other block), so output is bounded by
    rows x clusters x blocks."""
    routed = _route(df, id_col, vec_col, block_size, {"cl": F.col(cluster_col)})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        diag, left, right = _split(pdf)
        a, b = _mat(left["vec"]), _mat(right["vec"])
        if a.size == 0 or b.size == 0:
            return pd.DataFrame({"id": [], "cluster": [], "other": [], "dist_sum": [], "n": []})
        ia, ib = left["id"].to_numpy(), right["id"].to_numpy()
        ca, cb = left["cl"].to_numpy(), right["cl"].to_numpy()
        d = _distances(a, b)
        outs = []

        def sums(dm, rows, rcl, cols, ccl):
            dm = np.where(rows[:, None] == cols[None, :], 0.0, dm)
            selfm = rows[:, None] == cols[None, :]
            res = []
            for c in np.unique(ccl):
                m = ccl == c
                cnt = m.sum() - selfm[:, m].sum(axis=1)
                res.append(pd.DataFrame({"id": rows, "cluster": rcl, "other": c,
                                         "dist_sum": dm[:, m].sum(axis=1), "n": cnt}))
            return pd.concat(res, ignore_index=True)

        outs.append(sums(d, ia, ca, ib, cb))
        if not diag:
            outs.append(sums(d.T, ib, cb, ia, ca))
        return pd.concat(outs, ignore_index=True)

    cl_type = df.schema[cluster_col].dataType.simpleString()
    part = routed.groupBy("bi", "bj").applyInPandas(
        run, f"id {df.schema[id_col].dataType.simpleString()}, cluster {cl_type}, other {cl_type}, "
             "dist_sum double, n long")
    return part.groupBy("id", "cluster", "other").agg(F.sum("dist_sum").alias("dist_sum"),
                                                     F.sum("n").alias("n"))


def rival_distance_sums(df: DataFrame, id_col: str, vec_col: str, cluster_col: str, clusters: metric.Clusters,
                        block_size: int = DEFAULT_BLOCK) -> DataFrame:
    """As ``cluster_distance_sums``, only for the own cluster and those that may be the nearest other one."""
    index = metric.build_by_cluster(df, id_col, vec_col, cluster_col, clusters, block_size)
    visiting = metric.visits(index, index.own(), metric.rival_clusters(clusters.spread))
    pivot = index.known.pivot

    def work(home, ids, m, own, q, qm, bound):
        d = metric.distances(qm, m)
        n = np.full(len(q), len(ids))
        if pivot[home] == pivot[own]:
            same = q[:, None] == ids[None, :]
            d = np.where(same, 0.0, d)
            n = n - same.sum(1)
        return {"id": q, "c": np.full(len(q), pivot[own]), "o": np.full(len(q), pivot[home]), "dist_sum": d.sum(1), "n": n}

    schema = T.StructType([T.StructField("id", index.id_type),
                           *T.StructType.fromDDL("c int, o int, dist_sum double, n long").fields])
    sums = (metric.meet(index, visiting, work, schema).groupBy("id", "c", "o")
            .agg(F.sum("dist_sum").alias("dist_sum"), F.sum("n").alias("n")))
    # one row per cluster, bounded by the size of the centroids
    kind = df.schema[cluster_col].dataType
    names = df.sparkSession.createDataFrame(
        list(enumerate(clusters.labels)), T.StructType([T.StructField("c", T.IntegerType()), T.StructField("cluster", kind)]))
    others = names.select(F.col("c").alias("o"), F.col("cluster").alias("other"))
    return (sums.join(F.broadcast(names), "c").join(F.broadcast(others), "o")
            .select("id", "cluster", "other", "dist_sum", "n"))


def silhouette_routing(df: DataFrame, id_col: str, vec_col: str, cluster_col: str,
                       block_size: int = DEFAULT_BLOCK) -> DataFrame:
    """One row (n, blocks, routed, distances): the work of ``silhouette`` on these vectors."""
    clusters = metric.cluster_statistics(df, vec_col, cluster_col, CENTROID_BYTES)
    index = metric.build_by_cluster(df, id_col, vec_col, cluster_col, clusters, block_size)
    return metric.routed_rows(index, metric.visits(index, index.own(), metric.rival_clusters(clusters.spread)))


def silhouette(df: DataFrame, id_col: str, vec_col: str, cluster_col: str,
               block_size: int = DEFAULT_BLOCK, centroid_bytes: int = CENTROID_BYTES) -> DataFrame:
    """Per-row silhouette (b - a) / max(a, b); a row alone in its cluster scores 0.

    Clusters whose centroid lies farther than an upper bound of the best
    mean distance are not looked at.
    """
    clusters = metric.cluster_statistics(df, vec_col, cluster_col, centroid_bytes)
    s = (cluster_distance_sums(df, id_col, vec_col, cluster_col, block_size) if clusters is None
         else rival_distance_sums(df, id_col, vec_col, cluster_col, clusters, block_size))
    mean = F.try_divide(F.col("dist_sum"), F.col("n"))
    per = s.groupBy("id", "cluster").agg(
        F.max(F.when(F.col("cluster").eqNullSafe(F.col("other")), mean)).alias("a"),
        F.min(F.when(~F.col("cluster").eqNullSafe(F.col("other")) & (F.col("n") > 0), mean)).alias("b"),
        F.max(F.when(F.col("cluster").eqNullSafe(F.col("other")), F.col("n"))).alias("n_own"))
    score = F.when(F.coalesce(F.col("n_own"), F.lit(0)) == 0, F.lit(0.0)).otherwise(
        F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")))
    return per.withColumn("silhouette", F.coalesce(score, F.lit(0.0)))


def silhouette_score(df: DataFrame, id_col: str, vec_col: str, cluster_col: str,
                     block_size: int = DEFAULT_BLOCK) -> DataFrame:
    """M-13: one row (n, silhouette); fails unless 2 <= number of labels <= n - 1."""
    per = silhouette(df, id_col, vec_col, cluster_col, block_size)
    out = per.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cluster").alias("_k"),
                  F.round(F.avg("silhouette"), 6).alias("silhouette"))
    ok = (F.col("_k") >= 2) & (F.col("_k") <= F.col("n") - 1)
    return out.select("n", F.when(ok, F.col("silhouette")).otherwise(F.raise_error(
        F.concat(F.lit("silhouette needs 2 <= labels <= n-1, got "), F.col("_k").cast("string"))))
        .cast("double").alias("silhouette"))


def top_similar(corpus: DataFrame, queries: DataFrame, k: int, id_col: str = "gene",
                vec_col: str = "vec", qid_col: str = "query", qvec_col: str = "qvec",
                temperature: float | None = None, block_size: int = DEFAULT_BLOCK) -> DataFrame:
    """Top-k cosine neighbours of each query vector in the corpus (W-01, J-09).

    Ranking: similarity descending, ties to the later corpus row (larger
    id).  The query table is cut into pieces where it lies and each piece is
    sent to the blocks of the corpus that can hold one of its k best; the
    final window sees at most k rows per query and visited block.  Any
    number of queries is answered; none pass through the driver.  A query
    without a direction has similarity 0 with everything.
    """
    index = metric.build(corpus, id_col, vec_col, block_size, unit=True)
    pieces = index.packs(queries, qid_col, qvec_col)
    scale = 1.0 / temperature if temperature else 1.0

    def choose(known, own, m, d):
        bound = np.where((m != 0).any(1), known.kth_bound(d, k) + known.margin(m), np.inf)
        return known.lower(d) <= bound[:, None] + known.margin(m), bound

    def work(home, ids, m, own, q, qm, bound):
        s = qm @ m.T
        kk = min(k, len(ids))
        r, c = np.nonzero(s >= np.partition(s, len(ids) - kk, axis=1)[:, [len(ids) - kk]])
        r, c = first_k(r, c, -s[r, c], -id_ranks(ids)[c], k)
        return {"query": q[r], "gene": ids[c], "sim": s[r, c] * scale}

    schema = T.StructType([T.StructField("query", queries.schema[qid_col].dataType),
                           T.StructField("gene", corpus.schema[id_col].dataType), T.StructField("sim", T.DoubleType())])
    return _least(metric.meet(index, metric.visits(index, pieces, choose), work, schema), "query", k,
                  F.desc("sim"), F.desc("gene"))
