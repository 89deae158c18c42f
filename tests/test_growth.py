"""What a task holds does not grow with the input: tasks, triggers and blocks follow the number of rows."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellframe import session
from cellframe.functions import ranking
from cellframe.operators import graph, metric, neighbors, vocab
from cellframe.plans.registry import QUERIES, load_all
from cellframe.sources import tables

load_all()


@pytest.fixture
def expression(spark, tmp_path, monkeypatch):
    """Own tables of 900 lines, at most 25 in a task."""
    monkeypatch.setattr(session, "ROWS_PER_TASK", 25)
    made = {
        "region": spark.sql("SELECT 0 AS r_regionkey, 'R' AS r_name UNION ALL SELECT 1, 'S'"),
        "nation": spark.range(2).selectExpr("int(id) AS n_nationkey", "concat('N', id) AS n_name", "int(id) AS n_regionkey"),
        "customer": spark.range(30).selectExpr("id AS c_custkey", "int(id % 2) AS c_nationkey", "'T' AS c_mktsegment"),
        "part": spark.range(40).selectExpr("id AS p_partkey", "int(id + 5) AS p_size"),
        "orders": spark.range(300).selectExpr("id AS o_orderkey", "id % 30 AS o_custkey"),
        "lineitem": spark.range(900).selectExpr("id % 300 AS l_orderkey", "id % 40 AS l_partkey", "double(id % 7 + 1) AS l_quantity",
                                                "'A' AS l_returnflag", "0.01 * (id % 5) AS l_discount"),
    }
    for name, df in made.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [int(n) for n in re.findall(r"Exchange hashpartitioning\([^)]*?, (\d+)\)", plan)]


def test_tasks_follow_the_rows(spark, expression):
    assert session.tasks_for(spark, 10) == 8 and session.tasks_for(spark, 901) == 37
    for df in (tables.expr(spark, expression), tables.expr_zero(spark, expression)):
        assert 36 in shuffles(df)
        assert df.count() > 0
    assert shuffles(QUERIES["sequence_assemble"](spark, expression)).count(36) >= 3


def test_large_vocabulary_is_joined_in_as_many_tasks(spark, expression, monkeypatch):
    few = shuffles(QUERIES["gene_encode"](spark, expression))
    want = sorted(QUERIES["gene_encode"](spark, expression).collect())
    monkeypatch.setattr(vocab, "VOCAB_BROADCAST_MAX_ROWS", 1)
    large = QUERIES["gene_encode"](spark, expression)
    assert shuffles(large).count(36) > few.count(36)
    assert sorted(large.collect()) == want


@pytest.mark.parametrize("name", ["cell_pool", "cell_pool_weighted", "cell_pool_first"])
def test_large_gene_vectors_are_joined_in_as_many_tasks(spark, expression, monkeypatch, name):
    """F24 to F26: vectors too many to send are joined, and summed by cell, in tasks that follow the rows."""
    spark.range(40).selectExpr("id AS vec_id", "array(float(id % 3), float(1), float(id % 5)) AS embedding",
                               "int(id % 2) AS label").write.parquet(f"{expression}/embeddings.parquet")
    want = sorted(QUERIES[name](spark, expression).collect())
    assert len(want) > 0
    monkeypatch.setattr(ranking, "checked_broadcast", lambda df, max_rows, max_bytes=0: df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = QUERIES[name](spark, expression)
        plan = large._jdf.queryExecution().executedPlan().toString()
        got = sorted(large.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    by_gene = re.findall(r"Exchange hashpartitioning\(gene_id#\d+L?, (\d+)\)", plan)
    by_cell = re.findall(r"Exchange hashpartitioning\(cell#\d+L?, (\d+)\)", plan)
    assert len(by_gene) == 2 and set(by_gene + by_cell) == {"36"}, (by_gene, by_cell)
    assert got == want


def test_triggers_do_not_follow_the_files(spark, expression, monkeypatch):
    """Two samples in many files are two triggers, so the vocabulary is sent twice."""
    from cellframe.streaming import jobs
    seen, run = {}, jobs.encode_stream

    def watched(spark, source, *a, **kw):
        seen.update(files=len(spark.read.parquet(source).inputFiles()), each=kw["max_files"])
        return run(spark, source, *a, **kw)

    monkeypatch.setattr(jobs, "encode_stream", watched)
    got = QUERIES["stream_encode"](spark, expression)
    assert got.count() == tables.expr(spark, expression).where(F.col("value") > 0).count()
    assert seen["files"] > 4 and -(-seen["files"] // seen["each"]) == 2


def test_vectors_sent_grow_with_the_vectors(spark):
    """Nothing can be skipped here: twice the vectors are sent twice, not four times, however small the blocks asked for."""
    x = np.random.default_rng(1).normal(size=(1600, 24))
    sent = {}
    for n in (800, 1600):
        df = spark.createDataFrame([(i, [float(v) for v in r], 0) for i, r in enumerate(x[:n])],
                                   "gene long, vec array<double>, cluster int")
        work = neighbors.knn_routing(df, "gene", "vec", 5, 4).first()
        assert work.blocks <= 2 * metric.MAX_BLOCKS and work.n == n
        sent[n] = work.routed
    assert sent[1600] < 2.5 * sent[800]
    labels = df.withColumn("cluster", F.col("gene").cast("int") % 5)
    assert neighbors.silhouette_routing(labels, "gene", "vec", "cluster", 4).first().blocks <= metric.MAX_BLOCKS + 5
    assert metric.fitting_block(10 ** 9, 128, 64) == metric.BLOCK_VALUES // 64
    d = np.sqrt(((x[:, None] - x[None, :40]) ** 2).sum(-1))
    got = {r.src: r.dst for r in neighbors.knn(df, "gene", "vec", 5, 4).where("rank = 1 AND src < 40").collect()}
    assert got == {i: int(np.argsort(d[:, i], kind="stable")[1]) for i in range(40)}


def test_a_graph_of_ten_thousand_nodes_is_one_block():
    """Blocks propose moves side by side and may spoil each other's; so many nodes need no such rounds."""
    assert graph.BLOCK_NODES >= 10_256


def test_degrees_pass_over_the_edges_once(spark):
    edges = spark.createDataFrame([(1, 1, 2.0), (1, 2, 3.0)], "a long, b long, weight double")
    nodes = spark.range(1, 4)
    weighted, plain = graph.degrees(edges, nodes), graph.degrees(edges, nodes, weighted=False)
    assert {r.id: r.degree for r in weighted.collect()} == {1: 7.0, 2: 3.0, 3: 0.0}
    assert {r.id: r.degree for r in plain.collect()} == {1: 3.0, 2: 1.0, 3: 0.0}
    once = spark.range(2).selectExpr("id AS a", "id + 1 AS b", "1.0D AS weight")
    assert graph.degrees(once, nodes)._jdf.queryExecution().optimizedPlan().toString().count("(0, 2,") == 1


def test_community_search_frees_what_it_no_longer_reads(spark, monkeypatch):
    """written tables and shuffle files do not add up over the rounds of a search."""
    rng = np.random.default_rng(3)
    pairs = {(min(a, b), max(a, b)) for a in range(60) for b in rng.choice(60, 3).tolist() if a != b}
    pairs |= {(20 * c + i, 20 * c + j) for c in range(3) for i in range(20) for j in range(i) if (i + j) % 3}
    edges = spark.createDataFrame([(min(p), max(p), 1.0) for p in sorted(pairs)], "a long, b long, weight double")
    before, cleaned = set(session._WRITTEN), []
    write = graph.cut_lineage

    def watched(df, name="state"):
        cleaned.append(spark.conf.get(session.ScratchScope._CLEAN))
        return write(df, name)

    monkeypatch.setattr(graph, "cut_lineage", watched)
    found = graph.communities(edges, spark.range(60), 1.0, block_nodes=30)
    left = set(session._WRITTEN) - before
    assert len(cleaned) > 8 and set(cleaned) == {"true"}
    assert spark.conf.get(session.ScratchScope._CLEAN, "false") == "false"
    assert 0 < len(left) <= 4, left
    rows = found.collect()
    assert sorted(r.id for r in rows) == list(range(60)) and {r.community for r in rows} == set(range(len({r.community for r in rows})))
    assert graph.partition_quality(edges, found).first()[1:] == (True, True)


def test_the_bound_of_a_piece_is_found_in_strips(monkeypatch):
    """distances held at a time stay under STRIP_VALUES however large a block; before, a block's square was held."""
    import tracemalloc
    x = np.random.default_rng(4).normal(size=(2_000, 6))
    pivots = x[:3]
    known = metric.Blocks(pivots, np.arange(3), np.zeros(3), np.full(3, 9.0), np.full(3, 2_000))
    d = known.to_pivots(x)
    _, want = metric.nearest(5)(known, 0, x, d)
    monkeypatch.setattr(metric, "STRIP_VALUES", 40_000)
    tracemalloc.start()
    visit, got = metric.nearest(5)(known, 0, x, d)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * 8 * 40_000, peak  # eight strips; the square is a hundred
    exact = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), 1)[:, 5]
    assert np.allclose(got, want) and np.allclose(got, exact, atol=1e-3) and (got >= exact - 1e-9).all() and visit.all()
    before = np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * (x @ pivots.T), 0)
    assert (metric.squared(x, pivots) == before).all()


def test_modularity_holds_no_square_of_a_block(spark, tmp_path, monkeypatch):
    """the search behind the query, given a block of 6,000 vectors, holds strips of its distances (a square: 288 MB)."""
    import tracemalloc
    x = np.random.default_rng(5).normal(size=(60, 4)).astype(np.float32)
    spark.createDataFrame([(i, [float(v) for v in r], i % 3) for i, r in enumerate(x)],
                          "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    seen, visits = [], metric.visits
    monkeypatch.setattr(metric, "visits", lambda index, pieces, choose: seen.append((index.known, choose)) or visits(
        index, pieces, choose))
    got = QUERIES["modularity"](spark, str(tmp_path)).first()
    d = ((x[:, None].astype(float) - x[None]) ** 2).sum(-1)
    near = np.zeros((60, 60))
    np.put_along_axis(near, d.argsort(1)[:, 1:21], 1, 1)
    a, same = near + near.T, np.arange(60)[:, None] % 3 == np.arange(60) % 3
    k = a.sum(1)
    assert got.m == 1200 and got.modularity == round(((a - np.outer(k, k) / k.sum()) * same).sum() / k.sum(), 6)
    (known, choose), block = seen[0], np.random.default_rng(6).normal(size=(6_000, 4))
    tracemalloc.start()
    choose(known, 0, block, known.to_pivots(block))
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < 100, peak
