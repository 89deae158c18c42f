"""Numbers that must be exact at any size, and rows that must never get lost."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cellframe.functions.ranking import checked_broadcast, global_row_number, grouped_row_number
from cellframe.operators import binning, graph, metrics, neighbors, splits, tokens, vectors

N = 300_000


@pytest.fixture(scope="module")
def many(spark):
    """300,000 rows in random order with a payload column, a hot group and a null group."""
    df = spark.range(0, N, numPartitions=6)
    key = F.pmod(F.col("id") * 48271, F.lit(2147483647))
    g = F.when(F.col("id") % 10 < 6, 0).when(F.col("id") % 10 < 9, F.col("id") % 10)
    return df.select(key.alias("k"), g.alias("g"), F.concat(F.lit("payload-"), "id").alias("payload")).cache()


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_global_numbers_are_exact_with_payload(spark, many, reuse):
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        got = global_row_number(many, ["k"], "r", num_partitions=13)
        want = [r.k for r in many.select("k").sort("k").collect()]
        pairs = sorted((r.r, r.k) for r in got.select("r", "k").collect())
        assert [r for r, _ in pairs] == list(range(1, N + 1)) and [k for _, k in pairs] == want
        assert got.where("payload is null").count() == 0
    finally:
        spark.conf.set("spark.sql.exchange.reuse", "true")


def test_grouped_numbers_are_exact_with_null_group(spark, many):
    got = grouped_row_number(many, ["g"], ["k"], "r", num_partitions=11)
    want = many.withColumn("w", F.row_number().over(Window.partitionBy("g").orderBy("k")))
    j = got.join(want.select("k", "w"), "k")
    assert j.count() == N and j.where("r != w").count() == 0


def test_descending_order_and_batches(spark, many):
    got = global_row_number(many, [F.desc("k")], "r", start=0)
    assert got.agg(F.max_by("k", "r")).first()[0] == many.agg(F.min("k")).first()[0]
    sizes = metrics.batch_positions(many, "k", 64).groupBy("batch").count().collect()
    assert len(sizes) == -(-N // 64) and {r["count"] for r in sizes} <= {64, N % 64}


def test_ranking_against_a_vector_with_string_ids(spark):
    rng = np.random.default_rng(0)
    rows = [(f"g{i}", [float(x) for x in rng.normal(size=3)]) for i in range(5000)]
    df = spark.createDataFrame(rows, "gene string, vec array<double>")
    out = vectors.rank_against_vector(df, [1.0, 0.0, 0.5]).collect()
    assert sorted(r["rank"] for r in out) == list(range(1, 5001))
    by = sorted(out, key=lambda r: r["rank"])
    assert all(a.sim >= b.sim for a, b in zip(by, by[1:]))


def test_rows_without_type_are_split(spark):
    rows = [(i, None if i % 4 == 0 else "ab"[i % 2]) for i in range(200)]
    df = spark.createDataFrame(rows, "cell long, celltype string")
    out = splits.split_stratified(df, "cell", "celltype", 1234, 0.1)
    assert out.count() == 200 and out.where("celltype is null").count() == 50
    q = {r.label: r for r in splits.stratified_quotas(df, "celltype", 0.1).collect()}
    got = {r.split: r["count"] for r in out.where("celltype is null").groupBy("split").count().collect()}
    assert got.get("train", 0) == q[None].n_train and got.get("test", 0) == q[None].n_test


def test_nan_does_not_reach_the_range(spark):
    df = spark.createDataFrame([("s", 1, 1, 2.0), ("s", 1, 2, float("nan")), ("s", 1, 3, 8.0), ("t", 2, 1, float("nan"))],
                               "sample string, cell long, gene long, value double")
    r = {x.sample: (x.min_pos, x.max_val) for x in binning.sample_range(df).collect()}
    assert r == {"s": (2.0, 8.0), "t": (None, None)}
    bins = {x.gene: x.bin for x in binning.bin_expression(df.where("sample = 's'")).collect()}
    assert bins == {1: 1, 2: 100, 3: 100}


def test_equal_barcodes_of_two_samples_stay_apart(spark):
    from cellframe.config import Params
    rows = [(s, 7, g, 5.0) for s in ("a", "b") for g in ((1, 2, 3) if s == "a" else (4, 5, 6))]
    e = spark.createDataFrame(rows, "sample string, cell long, gene long, bin double")
    cells = spark.createDataFrame([("a", 7), ("b", 7)], "sample string, cell long")
    vocab = spark.createDataFrame([(g, g) for g in range(1, 7)], "name long, id int")
    out = {r.sample: r for r in tokens.build_tokens(e, cells, vocab, Params(seq_length=4)).collect()}
    assert out["a"].gene_ids == [1, 2, 3, 0] and out["b"].gene_ids == [4, 5, 6, 0]


def test_too_many_genes_are_an_error_not_a_cut(spark):
    e = spark.createDataFrame([("s", 1, g, 1.0) for g in range(10)], "sample string, cell long, gene long, value double")
    vocab = spark.createDataFrame([(g, g + 1) for g in range(10)], "name long, id int")
    assert tokens.dense_genes(e, 10, vocab).first().n_genes == 10
    with pytest.raises(Exception, match="more than 4"):
        tokens.dense_genes(e, 4, vocab).collect()


def test_repeated_keys_are_an_error(spark):
    df = spark.createDataFrame([(1, 2.0)], "cell long, v double")
    table = spark.createDataFrame([(1, "x"), (1, "y")], "cell long, batch string")
    for f in (lambda: tokens.strict_lookup(df, table, "cell", "batch"), lambda: tokens.labelled(df, table, "cell", "batch")):
        with pytest.raises(Exception, match="repeated cell"):
            f().collect()


def test_embedding_header_goes_by_place(spark, tmp_path):
    from cellframe.sources import files
    (tmp_path / "e.txt").write_text("2 1\n7 8\n9 10\n11 12\n")
    got = {r.gene: r.vec for r in files.read_embedding_text(spark, str(tmp_path / "e.txt"), strict=True).collect()}
    assert got == {"7": [8.0], "9": [10.0], "11": [12.0]}
    assert [r.value for r in files.read_embedding_header(spark, str(tmp_path)).collect()] == ["2 1"]


def test_metadata_spellings_of_missing_values(spark, tmp_path):
    from cellframe.sources import files
    (tmp_path / "s.meta.csv").write_text(",celltype\nc1,NaN\nc2,\nc3,T\nc4,N/A\n")
    (tmp_path / "other.csv").write_text(",celltype\nc9,T\n")
    got = {r.cell: r.celltype for r in files.read_metadata(spark, str(tmp_path), "celltype").collect()}
    assert got == {"c1": None, "c2": None, "c3": "T", "c4": None}


def test_keyed_labels_reject_repeats_and_missing_columns(spark, tmp_path):
    from cellframe.sources import files
    (tmp_path / "a.csv").write_text("cell,celltype\nc1,T\nc1,B\n")
    with pytest.raises(Exception, match="repeated cell"):
        files.read_keyed_labels(spark, str(tmp_path)).collect()
    with pytest.raises(ValueError):
        files.read_keyed_labels(spark, str(tmp_path), label="batch")


@pytest.fixture(scope="module")
def named(spark):
    rng = np.random.default_rng(4)
    rows = [(f"AT{i % 5}G{i:03d}", [float(x) for x in rng.normal(size=4) + 4 * (i % 3)], i % 3) for i in range(60)]
    return spark.createDataFrame(rows, "gene string, vec array<double>, cluster int"), rows


def test_string_ids_in_vector_and_graph_operators(spark, named):
    df, rows = named
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    knn = neighbors.knn(df, "gene", "vec", 4, block_size=16)
    got = {}
    for r in knn.collect():
        got.setdefault(r.src, []).append((r.rank, r.dst))
    for i, s in enumerate(ids):
        assert [b for _, b in sorted(got[s])] == list(ids[np.lexsort((ids, d[i]))[:4]])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = u @ u.T
    want = {(min(a, b), max(a, b)) for i, a in enumerate(ids) for j, b in enumerate(ids) if sim[i, j] >= 0.9}
    assert {(r.src, r.dst) for r in neighbors.cosine_pairs(df, "gene", "vec", 0.9, block_size=16).collect()} == want
    assert neighbors.silhouette_score(df, "gene", "vec", "cluster", 16).first().silhouette > 0.3
    edges = graph.knn_multigraph(knn)
    member = graph.communities(edges, df.select(F.col("gene").alias("id")), 1.0)
    assert member.count() == 60
    quality = graph.partition_quality(edges, member).first()
    assert quality.local_optimum and quality.connected
    both = member.join(df.select(F.col("gene").alias("id"), "cluster"), "id")
    assert all(r.n == 1 for r in both.groupBy("community").agg(F.countDistinct("cluster").alias("n")).collect())


@pytest.mark.parametrize("block", [7, 10_000])
def test_every_query_is_answered(spark, named, block):
    df, rows = named
    queries = df.select(F.col("gene").alias("query"), F.col("vec").alias("qvec"))
    out = neighbors.top_similar(df, queries, 3, block_size=block).collect()
    x = np.array([r[1] for r in rows])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim, ids = u @ u.T, np.array([r[0] for r in rows])
    got = {}
    for r in out:
        got.setdefault(r.query, []).append((r.rank, r.gene))
    for i, q in enumerate(ids):
        order = np.lexsort((-np.argsort(np.argsort(ids)), -sim[i]))[:3]
        assert [g for _, g in sorted(got[q])] == list(ids[order])


def test_block_products_stay_small():
    import tracemalloc
    a = np.random.default_rng(0).normal(size=(512, 512))
    tracemalloc.start()
    d = neighbors._distances(a, a)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * neighbors.STRIP_VALUES * 8 + 2 * d.nbytes
    assert np.allclose(d[3, 5], np.linalg.norm(a[3] - a[5]))


def test_broadcast_by_measured_size(spark):
    def hinted(df):
        return "broadcast" in df._jdf.queryExecution().analyzed().toString().lower()

    wide = spark.range(2000).select("id", F.repeat(F.lit("x"), 1000).alias("t"))
    assert hinted(checked_broadcast(wide, 5000)) and not hinted(checked_broadcast(wide, 1999))
    assert not hinted(checked_broadcast(wide, 5000, max_bytes=1 << 20))


def test_scratch_folders_are_shared_and_removed(spark):
    import os

    from cellframe import session
    df = session.materialize(spark.range(3), "probe")
    path = df.inputFiles()[0].rsplit("/", 1)[0]
    local = path.removeprefix("file://")
    assert os.path.isdir(local)
    own = next(p for p in session._WRITTEN if p.split("/")[-1] == local.split("/")[-1])
    session.drop_scratch(spark, own)
    assert not os.path.isdir(local)
    with pytest.raises(ValueError):
        session.drop_scratch(spark, own)
