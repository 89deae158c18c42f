"""Edge-case fixtures and properties of the operators (hand-made small inputs)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellframe.config import CELLTYPE_DENYLIST
from cellframe.functions.columns import bin_value, cosine, mean_truncating
from cellframe.operators import metrics, splits, tokens, vectors


# ------------------------------------------------------------------ S-01 --
def _ref_bins(x, mn, mx):
    edges = np.linspace(mn, mx, 100)
    return 0 if x == 0 else int(np.digitize(x, edges))


def test_binning_matches_linspace_digitize_on_edges(spark):
    rng = np.random.default_rng(7)
    cases = []
    for mn, mx in [(1.0, 99.0), (0.37, 12345.5), (1e-3, 1.7), (5.0, 5.000001), (2.0, 2.0)]:
        edges = np.linspace(mn, mx, 100)
        vals = list(rng.uniform(mn, mx, 200))
        for e in edges:
            vals += [e, np.nextafter(e, -np.inf), np.nextafter(e, np.inf)]
        vals += [0.0, mn / 2, mx * 2, float("nan")]
        cases += [(mn, mx, float(v)) for v in vals]
    df = spark.createDataFrame(cases, "mn double, mx double, x double")
    got = df.select("mn", "mx", "x", bin_value("x", "mn", "mx").alias("b")).collect()
    bad = [(r.mn, r.mx, r.x, r.b, _ref_bins(r.x, r.mn, r.mx)) for r in got if r.b != _ref_bins(r.x, r.mn, r.mx)]
    assert not bad, bad[:5]


def test_binning_constant_sample_gives_top_bin(spark):
    df = spark.createDataFrame([(3.0,)] * 4, "x double")
    assert {r.b for r in df.select(bin_value("x", F.lit(3.0), F.lit(3.0)).alias("b")).collect()} == {100}


# ----------------------------------------------------------------- PF-01 --
def test_denylist_keeps_null_types(spark):
    df = spark.createDataFrame([(1, None), (2, "Unknow"), (3, "S phase"), (4, "B cell")], "cell int, celltype string")
    kept = sorted(r.cell for r in tokens.drop_denied_types(df, CELLTYPE_DENYLIST).collect())
    assert kept == [1, 4]


# ------------------------------------------------------- W-03 / A-05 -------
def test_sampling_exactly_L_keeps_all_in_gene_order_and_L_plus_one_samples(spark):
    L, k = 5, int(0.75 * 5)
    rows = [(1, g, float(g)) for g in range(1, L + 1)] + [(2, g, float(g)) for g in range(1, L + 2)]
    df = spark.createDataFrame(rows, "cell long, gene long, val double").withColumn("gene_id", F.col("gene").cast("int"))
    chosen = tokens.sample_genes(df, L, k, 1234)
    seqs = {r.cell: r for r in tokens.assemble(chosen, L).collect()}
    assert seqs[1].gene_ids == [1, 2, 3, 4, 5] and seqs[1].n_genes == 5
    assert seqs[2].n_genes == k and len(set(seqs[2].gene_ids[:k])) == k
    assert seqs[2].gene_ids[k:] == [0] * (L - k) and seqs[2].vals[k:] == [-2.0] * (L - k)


def test_cell_without_genes_gets_padded_row(spark):
    cells = spark.createDataFrame([(1,), (2,)], "cell long")
    seqs = spark.createDataFrame([(1, 1, [7, 0, 0], [3.0, -2.0, -2.0])],
                                 "cell long, n_genes long, gene_ids array<int>, vals array<double>")
    out = {r.cell: r for r in tokens.attach_to_cells(cells, seqs, 3).collect()}
    assert out[2].gene_ids == [0, 0, 0] and out[2].vals == [-2.0] * 3 and out[2].n_genes == 0


def test_pad_in_middle_is_flagged(spark):
    df = spark.createDataFrame([(1, [5, 0, 6, 0]), (2, [5, 6, 0, 0]), (3, [0, 0, 0, 0])], "cell int, gene_ids array<int>")
    flags = {r.cell: r.pad_middle for r in tokens.pad_in_middle(df).collect()}
    assert flags == {1: True, 2: False, 3: False}


# ------------------------------------------------------- W-05..W-07 --------
def test_random_split_is_exact_partition(spark):
    df = spark.range(1, 1001).withColumnRenamed("id", "cell")
    out = splits.split_random(df, "cell", 1234, 0.1)
    counts = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert counts == {"train": 900, "valid": 50, "test": 50}
    assert out.select("cell").distinct().count() == 1000


def test_stratified_split_quotas_and_singleton_repair(spark):
    # class "a": 95 rows, class "b": 12 rows -> b keeps >= 2 rows outside train
    rows = [(i, "a") for i in range(95)] + [(100 + i, "b") for i in range(12)]
    df = spark.createDataFrame(rows, "cell long, label string")
    q = {r.label: r for r in splits.stratified_quotas(df, "label", 0.1).collect()}
    for r in q.values():
        assert r.n_train + r.n_test + r.n_valid == r.n
        assert r.n - r.n_train != 1
    out = splits.split_stratified(df, "cell", "label", 1234, 0.1)
    got = {(r.label, r.split): r["count"] for r in out.groupBy("label", "split").count().collect()}
    for lab, r in q.items():
        assert got.get((lab, "train"), 0) == r.n_train
        assert got.get((lab, "test"), 0) == r.n_test
        assert got.get((lab, "valid"), 0) == r.n_valid


def test_bucketed_rank_equals_row_number(spark):
    from pyspark.sql import Window
    from cellframe.functions.columns import hash_order
    df = spark.range(0, 3000).withColumn("g", F.col("id") % 3).withColumn("k", hash_order("id", seed=9))
    a = splits.bucketed_rank(df, ["g"], "k", "r")
    b = df.withColumn("r2", F.row_number().over(Window.partitionBy("g").orderBy("k")))
    j = a.join(b.select("id", "r2"), "id")
    assert j.filter(F.col("r") != F.col("r2")).count() == 0


# ------------------------------------------------------------------ W-04 --
def test_mask_count_is_floor_ratio_of_non_pad(spark):
    vals = [[float(i) for i in range(1, n + 1)] + [-2.0] * (40 - n) for n in (0, 1, 6, 7, 20, 40)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "cell long, vals array<double>")
    for r in splits.random_mask(df, "cell", 1234, 0.15).collect():
        n = sum(1 for v in r.vals if v != -2.0)
        assert sum(r.mask) == math.floor(n * 0.15)
        assert all(v != -2.0 for v, m in zip(r.vals, r.mask) if m)
        assert all((mv == -1.0) if m else (mv == v) for v, mv, m in zip(r.vals, r.masked_vals, r.mask))


# ------------------------------------------------------------ M-01..M-06 --
def test_zero_division_rules(spark):
    # label 2 is predicted but never true, label 3 is true but never predicted
    rows = [(0, 0), (0, 0), (1, 1), (1, 2), (3, 1), (3, 0)]
    df = spark.createDataFrame(rows, "label int, pred int")
    r = metrics.classification_metrics(df).first()
    # per label (tp, n_pred, n_true): 0:(2,3,2) 1:(1,2,2) 2:(0,1,0) 3:(0,0,2)
    prec = np.mean([2 / 3, 1 / 2, 0.0, 1.0])
    rec = np.mean([1.0, 1 / 2, 1.0, 0.0])
    f1 = np.mean([2 * 2 / (4 + 1 + 0), 2 * 1 / (2 + 1 + 1), 0.0, 0.0])
    assert r.accuracy == round(3 / 6, 6)
    assert r.macro_precision == round(prec, 6) and r.macro_recall == round(rec, 6)
    assert r.macro_f1 == round(f1, 6)


def test_masked_relative_error_needs_a_masked_position(spark):
    df = spark.createDataFrame([(1.0, 2.0, False)], "pred double, target double, is_masked boolean")
    with pytest.raises(Exception):
        metrics.masked_errors(df).collect()


# ------------------------------------------------------------------ A-06 --
def test_majority_vote_tie_goes_to_first_seen(spark):
    from cellframe.operators.metagenes import majority_vote
    df = spark.createDataFrame([(1, 0, "b"), (2, 0, "a"), (3, 0, "a"), (4, 0, "b")], "pos int, cluster int, label string")
    assert {r.annotation for r in majority_vote(df, "cluster", "label", "pos").collect()} == {"b"}


# ---------------------------------------------------------- S-06 / J-08 ---
def test_cosine_zero_vector_and_truncating_average(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([1.0, 2.0], [1.0, 2.0])], "a array<double>, b array<double>")
    sims = [r.s for r in df.select(cosine("a", "b").alias("s")).collect()]
    assert sims[0] == 0.0 and abs(sims[1] - 1.0) < 1e-12
    df2 = spark.createDataFrame([([1.0, 2.0, 3.0], [3.0, 4.0])], "a array<double>, b array<double>")
    assert df2.select(mean_truncating("a", "b").alias("m")).first().m == [2.0, 3.0]


def test_average_sets_fails_on_missing_gene(spark):
    a = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "gene long, vec array<double>")
    b = spark.createDataFrame([(1, [3.0])], "gene long, vec array<double>")
    with pytest.raises(Exception):
        vectors.average_sets(a, b).collect()


def test_grouped_and_global_row_number_equal_window_row_number(spark):
    from pyspark.sql import Window
    from cellframe.functions.ranking import global_row_number, grouped_row_number
    # a hot group holding most rows, plus small ones
    df = spark.range(0, 5000).withColumn("g", F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") % 10))
    a = grouped_row_number(df, ["g"], ["id"], "r", num_partitions=7)
    b = df.withColumn("r2", F.row_number().over(Window.partitionBy("g").orderBy("id")))
    assert a.join(b.select("id", "r2"), "id").filter(F.col("r") != F.col("r2")).count() == 0
    c = global_row_number(df, ["id"], "r", num_partitions=5)
    assert c.filter(F.col("r") != F.col("id") + 1).count() == 0


def test_batches_drop_last(spark):
    df = spark.range(0, 150).withColumnRenamed("id", "cell")
    keep = metrics.batch_positions(df, "cell", 64, drop_last=False)
    drop = metrics.batch_positions(df, "cell", 64, drop_last=True)
    assert keep.count() == 150 and {r.batch for r in keep.select("batch").distinct().collect()} == {0, 1, 2}
    assert drop.count() == 128 and {r.batch for r in drop.select("batch").distinct().collect()} == {0, 1}


def test_weighted_vector_needs_a_common_gene(spark):
    e = spark.createDataFrame([(1, [1.0, 2.0])], "gene long, vec array<double>")
    w = spark.createDataFrame([(2, 1.0)], "gene long, w double")
    with pytest.raises(Exception):
        vectors.vector_weighted(e, w).collect()


def test_binning_random_sweep_matches_reference_definition(spark):
    rng = np.random.default_rng(11)
    cases = []
    for _ in range(200):
        lo = 10 ** rng.uniform(-4, 4)
        hi = lo + 10 ** rng.uniform(-6, 5)
        xs = np.concatenate([rng.uniform(lo, hi, 90), rng.uniform(0, lo, 5), rng.uniform(hi, hi * 2, 5)])
        cases += [(float(lo), float(hi), float(x)) for x in xs]
    df = spark.createDataFrame(cases, "mn double, mx double, x double")
    got = df.select("mn", "mx", "x", bin_value("x", "mn", "mx").alias("b")).collect()
    bad = [(r.mn, r.mx, r.x, r.b) for r in got if r.b != _ref_bins(r.x, r.mn, r.mx)]
    assert not bad, bad[:5]
