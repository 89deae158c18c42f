"""Embedding-table queries: similarity search, vector aggregates, pooling, votes."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellframe.config import SIMILARITY_TEMPERATURE, Params
from cellframe.functions.columns import argmax, l2_normalize
from cellframe.operators import neighbors, tokens, vectors
from cellframe.plans.oracle_views import with_views
from cellframe.plans.q_build import RANGE_SQL, BINNED_SQL, SAMPLED_SQL, _ctes, _encoded_expressed
from cellframe.plans.registry import query
from cellframe.sources import tables as T

P = Params()
TOPK = P.top_k
EX_SQL = "SELECT gene, cluster, unnest(generate_series(1, len(vec))) AS k, unnest(vec) AS x FROM v_emb"


def _r6(c):
    return F.round(c, 6)


# ------------------------------------------------------------ J-09 / W-01 --
QSEL_SQL = {
    "q": "SELECT cluster, MIN(gene) AS query FROM v_emb GROUP BY cluster",
    "qv": "SELECT q.query, e.vec AS qvec FROM q JOIN v_emb e ON e.gene = q.query",
}


def query_vectors(spark, sf):
    """One query gene per cluster: its smallest gene id (derived from the table)."""
    e = T.emb(spark, sf)
    q = e.groupBy("cluster").agg(F.min("gene").alias("query"))
    return q.join(e.select(F.col("gene").alias("query"), F.col("vec").alias("qvec")), "query")


def _sim_sql(targets: str, scale: str = "") -> str:
    return with_views(
        f"SELECT query, gene, CAST(rank AS INT) AS rank, ROUND(sim{scale}, 6) AS sim FROM ("
        "SELECT *, ROW_NUMBER() OVER (PARTITION BY query ORDER BY sim DESC, gene DESC) AS rank FROM ("
        "SELECT qv.query, e.gene, list_cosine_similarity(qv.qvec, e.vec) AS sim "
        f"FROM qv, ({targets}) e) s) r WHERE rank <= {TOPK}", QSEL_SQL)


@query("similar_genes", _sim_sql("SELECT gene, vec FROM v_emb"))
def q_similar_genes(spark, sf):
    out = neighbors.top_similar(T.emb(spark, sf), query_vectors(spark, sf), TOPK)
    return out.select("query", "gene", "rank", _r6(F.col("sim")).alias("sim"))


ALL_SQL = {"qv": "SELECT gene AS query, vec AS qvec FROM v_emb WHERE gene % 20 = 0"}


@query("similar_genes_all", with_views(
    "SELECT query, gene, CAST(rank AS INT) AS rank, ROUND(sim, 6) AS sim FROM ("
    "SELECT *, ROW_NUMBER() OVER (PARTITION BY query ORDER BY sim DESC, gene DESC) AS rank FROM ("
    "SELECT qv.query, e.gene, list_cosine_similarity(qv.qvec, e.vec) AS sim FROM qv, v_emb e) s) r "
    f"WHERE rank <= {TOPK}", ALL_SQL))
def q_similar_genes_all(spark, sf):
    """Every gene whose id is divisible by 20, against all genes: the query table goes through Spark."""
    queries = T.emb(spark, sf).where(F.col("gene") % 20 == 0).select(
        F.col("gene").alias("query"), F.col("vec").alias("qvec"))
    out = neighbors.top_similar(T.emb(spark, sf), queries, TOPK)
    return out.select("query", "gene", "rank", _r6(F.col("sim")).alias("sim"))


# ---------------------------------------------------------------- S-07 ----
@query("similar_genes_temp", _sim_sql("SELECT gene, vec FROM v_emb", f" / {SIMILARITY_TEMPERATURE!r}"))
def q_similar_genes_temp(spark, sf):
    out = neighbors.top_similar(T.emb(spark, sf), query_vectors(spark, sf), TOPK,
                                temperature=SIMILARITY_TEMPERATURE)
    return out.select("query", "gene", "rank", _r6(F.col("sim")).alias("sim"))


# ---------------------------------------------------------------- U-02 ----
@query("similar_genes_subset", _sim_sql(
    "SELECT gene, vec FROM v_emb WHERE gene IN (SELECT gene FROM v_emb WHERE cluster < 5)"))
def q_similar_genes_subset(spark, sf):
    """Targets = known genes intersected with a subset (genes of clusters 0-4)."""
    e = T.emb(spark, sf)
    subset = e.filter(F.col("cluster") < 5).select("gene")
    targets = e.join(subset, "gene", "left_semi")
    out = neighbors.top_similar(targets, query_vectors(spark, sf), TOPK)
    return out.select("query", "gene", "rank", _r6(F.col("sim")).alias("sim"))


# ---------------------------------------------------------------- J-10 ----
@query("similar_to_vector", with_views(
    "SELECT gene, CAST(ROW_NUMBER() OVER (ORDER BY sim DESC, gene DESC) AS BIGINT) AS rank, ROUND(sim, 6) AS sim "
    "FROM (SELECT e.gene, list_cosine_similarity(e.vec, m.v) AS sim FROM v_emb e, "
    "(SELECT list(x ORDER BY k) AS v FROM (SELECT k, AVG(x) AS x FROM ex WHERE cluster = 0 GROUP BY k) t) m) s",
    {"ex": EX_SQL}))
def q_similar_to_vector(spark, sf):
    """Every gene ranked by cosine to one vector (the mean of cluster 0's genes)."""
    e = T.emb(spark, sf)
    mean = vectors.vector_mean(e, e.filter(F.col("cluster") == 0).select("gene"))
    v = [r["x"] for r in mean.orderBy("k").collect()]  # one vector: width numbers
    out = vectors.rank_against_vector(e, v)
    return out.select("gene", "rank", _r6(F.col("sim")).alias("sim"))


# ---------------------------------------------------------- A-09 / A-12 ---
@query("vector_mean", with_views(
    "SELECT cluster, CAST(k AS BIGINT) AS k, ROUND(AVG(x), 6) AS x FROM ex GROUP BY cluster, k", {"ex": EX_SQL}))
def q_vector_mean(spark, sf):
    e = T.emb(spark, sf)
    out = vectors.vector_mean(e, e.select("cluster", "gene"), group="cluster")
    return out.select("cluster", "k", _r6(F.col("x")).alias("x"))


@query("label_centroid", with_views(
    "SELECT label, CAST(k AS BIGINT) AS k, ROUND(AVG(x), 6) AS x FROM ("
    "SELECT label, unnest(generate_series(1, len(logits))) AS k, unnest(logits) AS x FROM v_pred) t "
    "GROUP BY label, k"))
def q_label_centroid(spark, sf):
    out = vectors.group_mean(T.pred(spark, sf), ["label"], "logits")
    return out.select("label", "k", _r6(F.col("x")).alias("x"))


# ---------------------------------------------------------------- A-10 ----
@query("vector_weighted", with_views(
    "SELECT CAST(k AS BIGINT) AS k, ROUND(SUM((cluster + 1) * x) / SUM(cluster + 1), 6) AS x "
    "FROM ex WHERE cluster IN (1, 2) GROUP BY k", {"ex": EX_SQL}))
def q_vector_weighted(spark, sf):
    """Genes of clusters 1 and 2, weight = cluster + 1."""
    e = T.emb(spark, sf)
    w = e.filter(F.col("cluster").isin(1, 2)).select("gene", (F.col("cluster") + 1).cast("double").alias("w"))
    out = vectors.vector_weighted(e, w)
    return out.select("k", _r6(F.col("x")).alias("x"))


# ---------------------------------------------------------------- A-11 ----
@query("vector_signed", with_views(
    "SELECT CAST(k AS BIGINT) AS k, ROUND(SUM(CASE WHEN cluster = 1 THEN 1.0 ELSE -1.0 END * (cluster + 1) * x), 6) "
    "AS x FROM ex WHERE cluster IN (1, 2) GROUP BY k", {"ex": EX_SQL}))
def q_vector_signed(spark, sf):
    """Set = cluster 1, markers = clusters 1 and 2, weight = cluster + 1 (all genes weighted)."""
    e = T.emb(spark, sf)
    genes = e.filter(F.col("cluster") == 1).select("gene")
    markers = e.filter(F.col("cluster").isin(1, 2)).select("gene")
    w = e.select("gene", (F.col("cluster") + 1).cast("double").alias("w"))
    out = vectors.vector_signed(e, genes, markers, w)
    return out.select("k", _r6(F.col("x")).alias("x"))


# ---------------------------------------------------------- J-08 / IO-11 --
AVG_SQL = {
    "b": "SELECT gene, list_transform(vec, lambda v: v / sqrt(list_sum(list_transform(vec, lambda w: w * w))))[1:48] "
         "AS vec FROM v_emb",
    "avg": "SELECT a.gene, list_transform(list_zip(a.vec[1:least(len(a.vec), len(b.vec))], "
           "b.vec[1:least(len(a.vec), len(b.vec))]), lambda p: (p[1] + p[2]) / 2) AS vec "
           "FROM v_emb a JOIN b ON a.gene = b.gene",
}


def second_set(spark, sf):
    """Second embedding set derived from the first: unit vectors cut to 48 values."""
    e = T.emb(spark, sf)
    return e.select("gene", F.slice(l2_normalize("vec"), 1, 48).alias("vec"))


@query("emb_average", with_views(
    "SELECT gene, CAST(k AS BIGINT) AS k, ROUND(x, 6) AS x FROM ("
    "SELECT gene, unnest(generate_series(1, len(vec))) AS k, unnest(vec) AS x FROM avg) t", AVG_SQL))
def q_emb_average(spark, sf):
    out = vectors.average_sets(T.emb(spark, sf).select("gene", "vec"), second_set(spark, sf))
    ex = vectors.exploded(out, ["gene"], "vec")
    return ex.select("gene", "k", _r6(F.col("x")).alias("x"))


# ---------------------------------------------------------------- A-14 ----
@query("cell_pool", with_views(
    "SELECT cell, CAST(k AS BIGINT) AS k, ROUND(x / sqrt(SUM(x * x) OVER (PARTITION BY cell)), 6) AS x FROM ("
    "SELECT c.cell, ex.k, AVG(ex.x) AS x FROM chosen c JOIN ex ON ex.gene = c.gene_id "
    "WHERE c.gene_id <> 0 GROUP BY c.cell, ex.k) t",
    {**_ctes(RANGE_SQL, BINNED_SQL), **SAMPLED_SQL, "ex": EX_SQL}))
def q_cell_pool(spark, sf):
    """Cells' sampled tokens pooled over gene embeddings (mean, then unit length)."""
    chosen = tokens.sample_genes(_encoded_expressed(spark, sf), P.seq_length, P.sample_size, P.seed)
    pooled = vectors.pool_cells(chosen.select("cell", "gene_id"), T.emb(spark, sf), tasks=T.expr_tasks(spark, sf))
    ex = vectors.exploded(pooled, ["cell"], "cell_vec")
    return ex.select("cell", "k", _r6(F.col("x")).alias("x"))


@query("cell_pool_weighted", with_views(
    "SELECT cell, CAST(k AS BIGINT) AS k, ROUND(x / sqrt(SUM(x * x) OVER (PARTITION BY cell)), 6) AS x FROM ("
    "SELECT c.cell, ex.k, SUM(c.val * ex.x) AS x FROM chosen c JOIN ex ON ex.gene = c.gene_id "
    "WHERE c.gene_id <> 0 GROUP BY c.cell, ex.k) t",
    {**_ctes(RANGE_SQL, BINNED_SQL), **SAMPLED_SQL, "ex": EX_SQL}))
def q_cell_pool_weighted(spark, sf):
    """Cells' sampled tokens pooled with their expression bins as weights."""
    return _pooled(spark, sf, "weighted")


@query("cell_pool_first", with_views(
    "SELECT c.cell, CAST(ex.k AS BIGINT) AS k, ROUND(ex.x, 6) AS x FROM chosen c JOIN ex ON ex.gene = c.gene_id "
    "WHERE c.gene_id <> 0 AND c.pos = 1",
    {**_ctes(RANGE_SQL, BINNED_SQL), **SAMPLED_SQL, "ex": EX_SQL}))
def q_cell_pool_first(spark, sf):
    """The vector of each cell's first token."""
    return _pooled(spark, sf, "first")


def _pooled(spark, sf, mode):
    chosen = tokens.sample_genes(_encoded_expressed(spark, sf), P.seq_length, P.sample_size, P.seed)
    pooled = vectors.pool_cells(chosen.select("cell", "gene_id", "val", "pos"), T.emb(spark, sf), mode=mode,
                                tasks=T.expr_tasks(spark, sf))
    return vectors.exploded(pooled, ["cell"], "cell_vec").select("cell", "k", _r6(F.col("x")).alias("x"))


# ---------------------------------------------------------------- A-06 ----
VOTE_SQL = {
    "pc": "SELECT e.gene AS cell, e.cluster, CAST(list_position(p.logits, list_max(p.logits)) - 1 AS INT) AS label "
          "FROM v_emb e JOIN v_pred p ON p.cell = e.gene",
    "cnt": "SELECT cluster, label, COUNT(*) AS n, MIN(cell) AS first_pos FROM pc GROUP BY cluster, label",
    "win": "SELECT cluster, label AS annotation FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY cluster "
           "ORDER BY n DESC, first_pos ASC) AS r FROM cnt) t WHERE r = 1",
}


def cluster_predictions(spark, sf):
    e = T.emb(spark, sf).select(F.col("gene").alias("cell"), "cluster")
    p = T.pred(spark, sf).select("cell", argmax("logits").alias("label"))
    return e.join(p, "cell")


@query("majority_vote", with_views(
    "SELECT pc.cell, pc.cluster, win.annotation FROM pc JOIN win ON win.cluster = pc.cluster", VOTE_SQL))
def q_majority_vote(spark, sf):
    from cellframe.operators.metagenes import majority_vote
    return majority_vote(cluster_predictions(spark, sf), "cluster", "label", "cell")


# ---------------------------------------------------------------- A-07 ----
@query("metagene_lists", with_views(
    "SELECT cluster, CAST(ROW_NUMBER() OVER (PARTITION BY cluster ORDER BY gene) AS BIGINT) AS pos, gene FROM v_emb"))
def q_metagene_lists(spark, sf):
    from cellframe.operators.metagenes import metagene_lists
    return metagene_lists(T.emb(spark, sf), "cluster", "gene", "gene")


# ---------------------------------------------------------------- W-10 ----
@query("cluster_top_genes", with_views(
    "SELECT cluster, string_agg(CAST(gene AS VARCHAR), ', ' ORDER BY rank) AS top_genes FROM ("
    "SELECT *, ROW_NUMBER() OVER (PARTITION BY cluster ORDER BY sim DESC, gene DESC) AS rank FROM ("
    "SELECT e.gene, e.cluster, list_cosine_similarity(e.vec, m.v) AS sim FROM v_emb e JOIN "
    "(SELECT cluster, list(x ORDER BY k) AS v FROM (SELECT cluster, k, AVG(x) AS x FROM ex GROUP BY cluster, k) t "
    "GROUP BY cluster) m ON m.cluster = e.cluster) s) r WHERE rank <= 20 GROUP BY cluster", {"ex": EX_SQL}))
def q_cluster_top_genes(spark, sf):
    from cellframe.operators.metagenes import cluster_top_genes
    return cluster_top_genes(T.emb(spark, sf), 20)
