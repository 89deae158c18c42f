"""The metric partition index: exact against brute force on hard layouts, work that falls with structure, recall."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellframe.operators import metric, neighbors


def frame(spark, x, labels=None, ids=None):
    ids = list(range(len(x))) if ids is None else ids
    labels = [0] * len(x) if labels is None else labels
    rows = [(i, [float(v) for v in r], c) for i, r, c in zip(ids, x, labels)]
    return spark.createDataFrame(rows, "gene long, vec array<double>, cluster int").repartition(3)


def layouts():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 5)) * 20
    clustered = np.repeat(centres, 20, axis=0) + rng.normal(size=(120, 5))
    grid = np.stack(np.meshgrid(range(8), range(8)), -1).reshape(-1, 2).astype(float)
    return {
        "clustered": clustered, "uniform": rng.normal(size=(90, 6)), "equal": np.ones((50, 3)),
        "ties": np.vstack([grid, grid[:20]]), "far": np.vstack([rng.normal(size=(60, 3)), [[1e6, 0, 0]], [[1e6, 1, 0]]]),
        "zeros": np.vstack([np.zeros((15, 4)), rng.normal(size=(45, 4))]),
    }


@pytest.mark.parametrize("name", sorted(layouts()))
@pytest.mark.parametrize("block", [8, 1000])
def test_knn_equals_brute_force(spark, name, block):
    x = layouts()[name]
    k = 6
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    got = {}
    for r in neighbors.knn(frame(spark, x), "gene", "vec", k, block_size=block).collect():
        got.setdefault(r.src, []).append((r["rank"], r.dst, r.dist))
    for i in range(len(x)):
        order = [j for j in np.lexsort((np.arange(len(x)), d[i])) if j != i][:k]
        assert [(j, round(v, 9)) for _, j, v in sorted(got[i])] == [(j, round(d[i, j], 9)) for j in order]


@pytest.mark.parametrize("name", ["clustered", "uniform", "zeros", "equal"])
@pytest.mark.parametrize("threshold", [0.95, 0.2, -0.5])
def test_cosine_pairs_equal_brute_force(spark, name, threshold):
    x = layouts()[name]
    u = metric.unit_rows(x)
    s = u @ u.T
    i, j = np.nonzero(np.triu(np.ones_like(s)) * ((s >= threshold) & (s != 0)))
    got = [(r.src, r.dst) for r in neighbors.cosine_pairs(frame(spark, x), "gene", "vec", threshold, 16).collect()]
    sure = {(int(a), int(b)) for a, b in zip(i, j) if abs(s[a, b] - threshold) > 1e-9}
    assert len(got) == len(set(got)) and sure <= set(got)
    assert all(s[a, b] >= threshold - 1e-9 for a, b in got)


@pytest.mark.parametrize("centroid_bytes", [1 << 20, 0])
def test_silhouette_equals_brute_force(spark, centroid_bytes):
    rng = np.random.default_rng(2)
    x = np.vstack([layouts()["clustered"], layouts()["clustered"][:10] + 0.01])
    labels = [int(c) for c in rng.integers(0, 5, 40)] + [6 + i // 20 for i in range(len(x) - 41)] + [99]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    lab = np.array(labels)
    got = {r.id: r.silhouette for r in neighbors.silhouette(
        frame(spark, x, labels), "gene", "vec", "cluster", 16, centroid_bytes).collect()}
    for i in range(len(x)):
        own = (lab == lab[i]) & (np.arange(len(x)) != i)
        a = d[i, own].mean() if own.any() else None
        b = min(d[i, lab == c].mean() for c in set(labels) - {labels[i]})
        want = 0.0 if a is None else (b - a) / max(a, b)
        assert got[i] == pytest.approx(want, abs=1e-9)


def test_work_falls_with_structure(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16)) * 30
    x = np.repeat(centres, 50, axis=0) + rng.normal(size=(2000, 16))
    labels = [i // 50 for i in range(2000)]
    df = frame(spark, x, labels)
    plain = 2000 * -(-2000 // 64)
    for work in (neighbors.knn_routing(df, "gene", "vec", 10, 64).first(),
                 neighbors.silhouette_routing(df, "gene", "vec", "cluster", 64).first()):
        assert work.routed < plain / 5 and work.distances < 2000 * 2000 / 8
    # nothing to skip: the work is that of all blocks, the result the same
    assert neighbors.knn_routing(frame(spark, rng.normal(size=(300, 40))), "gene", "vec", 5, 32).first().distances <= 300 * 300


def test_approximate_search_reaches_its_recall(spark):
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(30, 12)) * 5, 30, axis=0) + rng.normal(size=(900, 12))
    df = frame(spark, x)
    asked = df.where(F.col("gene") % 20 == 0)
    exact = neighbors.knn(df, "gene", "vec", 20, 64, queries=asked)
    r = neighbors.recall_of(neighbors.knn_approx(df, "gene", "vec", 20, queries=asked, block_size=64), exact).first()
    assert (r.n_queries, r.n_pairs) == (45, 900) and r.recall >= 0.9
    few = neighbors.recall_of(neighbors.knn_approx(df, "gene", "vec", 20, probes=1, lists=60, queries=asked), exact).first()
    everything = neighbors.recall_of(neighbors.knn_approx(df, "gene", "vec", 20, probes=1000, queries=asked), exact).first()
    assert few.recall < everything.recall == 1.0


def test_similar_with_zero_vectors_and_other_id_types(spark):
    x = layouts()["zeros"]
    df = frame(spark, x)
    queries = df.select(F.concat(F.lit("q"), F.col("gene")).alias("query"), F.col("vec").alias("qvec"))
    u = metric.unit_rows(x)
    s = u @ u.T
    got = {}
    for r in neighbors.top_similar(df, queries, 25, block_size=8).collect():
        got.setdefault(int(r["query"][1:]), []).append((r["rank"], r.gene, r.sim))
    for i in range(len(x)):
        want = sorted(s[i], reverse=True)[:25]
        assert np.allclose([v for _, _, v in sorted(got[i])], want, atol=1e-9)
    # a query without a direction: similarity 0 with all, the largest ids first
    assert [g for _, g, _ in sorted(got[0])] == list(range(59, 34, -1))


def test_no_rows_null_vectors_and_uneven_widths(spark):
    none = spark.createDataFrame([], "gene long, vec array<double>, cluster int")
    assert neighbors.knn(none, "gene", "vec", 3).collect() == []
    assert neighbors.cosine_pairs(none, "gene", "vec", 0.5).collect() == []
    assert neighbors.silhouette(none, "gene", "vec", "cluster").collect() == []
    assert neighbors.top_similar(none, none.select(F.col("gene").alias("query"), F.col("vec").alias("qvec")), 3).collect() == []
    assert neighbors.knn_approx(none, "gene", "vec", 3).collect() == []
    some = spark.createDataFrame([(1, [0.0, 1.0]), (2, None), (3, [0.0, 2.0])], "gene long, vec array<double>")
    assert [(r.src, r.dst) for r in neighbors.knn(some, "gene", "vec", 3).orderBy("src").collect()] == [(1, 3), (3, 1)]
    with pytest.raises(Exception, match="different lengths"):
        neighbors.knn(spark.createDataFrame([(1, [0.0]), (2, [0.0, 1.0])], "gene long, vec array<double>"), "gene", "vec", 1).collect()


def test_bounds_hold():
    rng = np.random.default_rng(0)
    x, pivots = rng.normal(size=(200, 5)), rng.normal(size=(4, 5))
    at = metric.squared(x, pivots).argmin(1)
    dist = metric.between(x, pivots[at])
    known = metric.Blocks(pivots, np.arange(4), *(np.array([f(dist[at == p]) for p in range(4)]) for f in (np.min, np.max)),
                          np.bincount(at, minlength=4))
    d = known.to_pivots(x)
    all_d = metric.distances(x, x)
    for p in range(4):
        assert (known.lower(d)[:, p] <= all_d[:, at == p].min(1) + 1e-9).all()
    assert (known.kth_bound(d, 10) >= np.sort(all_d, 1)[:, 9] - 1e-9).all()
    assert np.allclose(all_d, np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), atol=1e-12)
