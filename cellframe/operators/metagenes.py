"""Cluster annotation and metagene analysis (A-06..A-08, A-13, W-10, S-08..S-10).

Votes and lists group by cluster after partial aggregation; the per-cluster
winner tables have one row per cluster and are broadcast back if their measured
size allows it.  Gene-set
scores follow the published control-gene recipe (genes binned by mean
expression, controls drawn from the same bins) with md5 order in place of
a seeded shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellframe.functions.columns import cosine, hash_order, non_finite_to_zero
from cellframe.functions.ranking import checked_broadcast

SIDE_ROWS = 1_000_000  # rows of a per-cluster or member table that may be broadcast (its bytes are measured too)


def majority_vote(df: DataFrame, cluster: str, label: str, pos: str, out: str = "annotation") -> DataFrame:
    """Each cluster gets its most common label; a tie goes to the label seen first (smallest ``pos``)."""
    cnt = df.groupBy(cluster, label).agg(F.count(F.lit(1)).alias("_n"), F.min(pos).alias("_first"))
    w = Window.partitionBy(cluster).orderBy(F.desc("_n"), F.asc("_first"))
    win = (cnt.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1)
           .select(cluster, F.col(label).alias(out)))
    return df.join(checked_broadcast(win, SIDE_ROWS), cluster).select(pos, cluster, out)


def metagene_lists(df: DataFrame, cluster: str, gene: str, order: str) -> DataFrame:
    """cluster -> (pos, gene) in input order, one row per member.

    The position is an exact grouped row number computed without gathering
    a cluster in one task (a cluster may hold a third of all genes).
    """
    from cellframe.functions.ranking import grouped_row_number
    base = df.select(F.col(cluster), F.col(gene).alias("_g"), F.col(order).alias("_o"))
    out = grouped_row_number(base, [cluster], ["_o", "_g"], "pos")
    return out.select(cluster, F.col("pos").cast("long").alias("pos"), F.col("_g").alias(gene))


def cluster_centroids(emb: DataFrame, cluster: str = "cluster", vec: str = "vec") -> DataFrame:
    from cellframe.operators.vectors import _reassemble, group_mean
    return _reassemble(group_mean(emb, [cluster], vec), [cluster], "k", "x", "centroid")


def cluster_top_genes(emb: DataFrame, n: int, cluster: str = "cluster", gene: str = "gene",
                      vec: str = "vec") -> DataFrame:
    """Per cluster, its ``n`` genes closest (cosine) to the cluster centroid, joined by ', '."""
    cen = cluster_centroids(emb, cluster, vec)
    s = emb.join(checked_broadcast(cen, SIDE_ROWS), cluster).withColumn("_sim", cosine(F.col(vec), F.col("centroid")))
    w = Window.partitionBy(cluster).orderBy(F.desc("_sim"), F.desc(gene))
    top = s.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
    return top.groupBy(cluster).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_r", F.col(gene).cast("string").alias("g")))),
        lambda x: x["g"]), ", ").alias("top_genes"))


def score_gene_sets(expr: DataFrame, cells: DataFrame, sets: DataFrame, n_bins: int = 25,
                    ctrl_size: int = 50, seed: int = 0) -> DataFrame:
    """Raw gene-set score per (set, cell): set mean minus control mean.

    * ``expr`` (cell, gene, value) is sparse: an absent row means 0, so a
      mean over genes is the sum of present values over the gene count.
    * ``cells`` (cell) lists all cells; ``sets`` (set, gene) the gene lists,
      restricted here to genes present in the data (PF-10).
    * Genes are ranked by mean expression over all cells (ties share the
      lowest rank) and cut into bins of round(n_genes / (n_bins - 1))
      ranks: cut = rank // n_items.  For every bin touched by a set, the
      first ``ctrl_size`` genes of the bin in md5 order are controls; the
      set's own genes are removed from its controls.
    * A set without genes or without controls scores 0 for every cell.

    Plan shape: the expression table is scanned twice (gene means, then the
    per-(set, cell) sums).  The small tables in between -- one row per gene,
    and the member list (set genes + controls) -- are written once to the
    shared checkpoint folder, so they are not recomputed per use.  The
    gene-rank window runs over the gene table (bounded by the gene universe).
    """
    from cellframe.session import materialize
    n_cells = cells.count()
    gstats = expr.groupBy("gene").agg((F.sum("value") / F.lit(float(n_cells))).alias("avg"))
    # rank(method='min') over all genes without a single-partition window:
    # exact global row number on (avg, gene), then the smallest one per avg
    from cellframe.functions.ranking import global_row_number
    rn = global_row_number(gstats, ["avg", "gene"], "_rn")
    rmin = rn.groupBy("avg").agg(F.min("_rn").alias("_rk"))
    genes = materialize(rn.join(rmin, "avg").select("gene", "avg", "_rk"), "gene-means")
    n_genes = genes.count()
    n_items = max(1, int(round(n_genes / (n_bins - 1))))
    genes = genes.withColumn("cut", F.floor(F.col("_rk") / n_items).cast("int")).drop("_rk")
    set_ids = [r["set"] for r in sets.select("set").distinct().collect()]  # one id per set (parameter-sized)
    valid = sets.select("set", "gene").join(genes.select("gene"), "gene", "left_semi")
    set_bins = valid.join(genes, "gene").select("set", "cut").distinct()
    cand = genes.join(F.broadcast(set_bins), "cut").withColumn("_h", hash_order("gene", seed=seed))
    ctrl = (cand.withColumn("_r", F.row_number().over(Window.partitionBy("set", "cut").orderBy("_h")))
            .filter(F.col("_r") <= ctrl_size).select("set", "gene")
            .join(valid, ["set", "gene"], "left_anti"))
    members = materialize(valid.withColumn("side", F.lit(1)).unionByName(ctrl.withColumn("side", F.lit(0))),
                          "set-members")
    sizes = members.groupBy("set").agg(F.count_if(F.col("side") == 1).alias("_m1"),
                                       F.count_if(F.col("side") == 0).alias("_m0"))
    sums = (expr.join(checked_broadcast(members, SIDE_ROWS), "gene")
            .groupBy("set", "cell").agg(F.sum(F.when(F.col("side") == 1, F.col("value"))).alias("_s1"),
                                        F.sum(F.when(F.col("side") == 0, F.col("value"))).alias("_s0")))
    grid = cells.select("cell", F.explode(F.array(*[F.lit(x) for x in set_ids])
                                          if set_ids else F.array().cast("array<int>")).alias("set"))
    j = grid.join(F.broadcast(sizes), "set", "left").join(sums, ["set", "cell"], "left")
    ok = F.coalesce((F.col("_m1") > 0) & (F.col("_m0") > 0), F.lit(False))
    raw = (F.coalesce(F.col("_s1"), F.lit(0.0)) / F.col("_m1")
           - F.coalesce(F.col("_s0"), F.lit(0.0)) / F.col("_m0"))
    return j.select("set", "cell", F.when(ok, raw).otherwise(F.lit(0.0)).alias("score"))


def metagene_scores(expr: DataFrame, cells: DataFrame, sets: DataFrame, **kw) -> DataFrame:
    """A-13: scores min-max scaled over cells per set; any non-finite result gives 0.

    One aggregate per set gives min, max and the invalid count together.
    """
    raw = score_gene_sets(expr, cells, sets, **kw)
    v = F.col("score")
    stats = raw.groupBy("set").agg(F.min(v).alias("_mn"), F.max(v).alias("_mx"),
                                   F.count_if(F.isnan(v) | (F.abs(v) == float("inf"))).alias("_bad"))
    j = raw.join(F.broadcast(stats), "set")
    scaled = (F.when((F.col("_bad") > 0) | (F.col("_mx") == F.col("_mn")), F.lit(0.0))
              .otherwise((v - F.col("_mn")) / (F.col("_mx") - F.col("_mn"))))
    return j.select("set", "cell", "score", scaled.alias("scaled"))


def min_max_scale(df: DataFrame, group: str, value: str, out: str) -> DataFrame:
    """(v - min) / (max - min) within ``group``; a constant group gives 0."""
    rng = df.groupBy(group).agg(F.min(value).alias("_mn"), F.max(value).alias("_mx"))
    j = df.join(F.broadcast(rng), group)
    return (j.withColumn(out, F.when(F.col("_mx") == F.col("_mn"), F.lit(0.0))
                         .otherwise((F.col(value) - F.col("_mn")) / (F.col("_mx") - F.col("_mn"))))
            .drop("_mn", "_mx"))


def group_means_matrix(scores: DataFrame, set_col: str, group_col: str, value: str) -> DataFrame:
    """A-08: mean score per (set, group value); non-finite means become 0."""
    g = scores.groupBy(set_col, group_col).agg(F.avg(value).alias("mean"))
    return g.withColumn("mean", non_finite_to_zero(F.col("mean")))
