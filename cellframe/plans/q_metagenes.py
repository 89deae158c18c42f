"""Metagene scoring queries: gene-set scores, group-mean matrix, row scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellframe.operators import metagenes
from cellframe.plans.oracle_views import with_views
from cellframe.plans.registry import query
from cellframe.sources import tables as T

N_BINS, CTRL, SEED = 25, 50, 0
SCORE_SQL = {
    "ncell": "SELECT COUNT(*) AS n FROM v_cells",
    "gm": "SELECT gene, SUM(value) / (SELECT CAST(n AS DOUBLE) FROM ncell) AS avg FROM v_expr GROUP BY gene",
    "items": f"SELECT GREATEST(1, CAST(round_even(COUNT(*) / {float(N_BINS - 1)}, 0) AS BIGINT)) AS ni FROM gm",
    "cuts": "SELECT gene, avg, CAST(FLOOR(RANK() OVER (ORDER BY avg) / (SELECT ni FROM items)) AS INT) AS cut FROM gm",
    "sets_all": "SELECT DISTINCT cluster AS set FROM v_emb",
    "sets": "SELECT cluster AS set, gene FROM v_emb WHERE gene IN (SELECT gene FROM gm)",
    "sb": "SELECT DISTINCT s.set, c.cut FROM sets s JOIN cuts c ON c.gene = s.gene",
    "cand": f"SELECT sb.set, c.gene, ROW_NUMBER() OVER (PARTITION BY sb.set, sb.cut ORDER BY md5(concat(c.gene, ':{SEED}'))) "
            "AS r FROM sb JOIN cuts c ON c.cut = sb.cut",
    "ctrl": f"SELECT set, gene FROM cand WHERE r <= {CTRL} AND (set, gene) NOT IN (SELECT (set, gene) FROM sets)",
    "mem": "SELECT set, gene, 1 AS side FROM sets UNION ALL SELECT set, gene, 0 AS side FROM ctrl",
    "sz": "SELECT set, COUNT(*) FILTER (WHERE side = 1) AS m1, COUNT(*) FILTER (WHERE side = 0) AS m0 FROM mem GROUP BY set",
    "sums": "SELECT m.set, e.cell, SUM(CASE WHEN side = 1 THEN e.value END) AS s1, "
            "SUM(CASE WHEN side = 0 THEN e.value END) AS s0 FROM v_expr e JOIN mem m ON m.gene = e.gene GROUP BY m.set, e.cell",
    "raw": "SELECT g.set, c.cell, CASE WHEN COALESCE(sz.m1, 0) > 0 AND COALESCE(sz.m0, 0) > 0 THEN "
           "COALESCE(su.s1, 0.0) / sz.m1 - COALESCE(su.s0, 0.0) / sz.m0 ELSE 0.0 END AS score "
           "FROM sets_all g CROSS JOIN v_cells c LEFT JOIN sz ON sz.set = g.set "
           "LEFT JOIN sums su ON su.set = g.set AND su.cell = c.cell",
    "scaled": "SELECT r.set, r.cell, r.score, CASE WHEN mx = mn THEN 0.0 ELSE (r.score - mn) / (mx - mn) END AS scaled "
              "FROM raw r JOIN (SELECT set, MIN(score) AS mn, MAX(score) AS mx FROM raw GROUP BY set) b ON b.set = r.set",
}


def scores(spark, sf):
    e = T.expr(spark, sf).select("cell", "gene", "value")
    sets = T.emb(spark, sf).select(F.col("cluster").alias("set"), "gene")
    return metagenes.metagene_scores(e, T.cells(spark, sf).select("cell"), sets,
                                     n_bins=N_BINS, ctrl_size=CTRL, seed=SEED)


# ---------------------------------------------------------- A-13 / S-08 ---
@query("metagene_score", with_views(
    "SELECT set, cell, ROUND(score, 6) AS score, ROUND(scaled, 6) AS scaled FROM scaled", SCORE_SQL))
def q_metagene_score(spark, sf):
    s = scores(spark, sf)
    return s.select("set", "cell", F.round("score", 6).alias("score"), F.round("scaled", 6).alias("scaled"))


# ---------------------------------------------------------- A-08 / S-10 ---
PIVOT_SQL = {
    **SCORE_SQL,
    "pv": "SELECT s.set, c.celltype, AVG(s.scaled) AS mean FROM scaled s JOIN v_cells c ON c.cell = s.cell "
          "GROUP BY s.set, c.celltype",
}


def pivot(spark, sf):
    s = scores(spark, sf).join(T.cells(spark, sf).select("cell", "celltype"), "cell")
    return metagenes.group_means_matrix(s, "set", "celltype", "scaled")


@query("metagene_pivot", with_views(
    "SELECT set, celltype, ROUND(CASE WHEN isfinite(mean) THEN mean ELSE 0.0 END, 6) AS mean FROM pv", PIVOT_SQL))
def q_metagene_pivot(spark, sf):
    return pivot(spark, sf).select("set", "celltype", F.round("mean", 6).alias("mean"))


# ---------------------------------------------------------------- S-09 ----
@query("metagene_pivot_scaled", with_views(
    "SELECT p.set, p.celltype, ROUND(CASE WHEN mx = mn THEN 0.0 ELSE (mean - mn) / (mx - mn) END, 6) AS scaled "
    "FROM pv p JOIN (SELECT set, MIN(mean) AS mn, MAX(mean) AS mx FROM pv GROUP BY set) b ON b.set = p.set",
    PIVOT_SQL))
def q_metagene_pivot_scaled(spark, sf):
    """Each metagene row scaled to 0..1 across cell types."""
    p = pivot(spark, sf)
    return metagenes.min_max_scale(p, "set", "mean", "scaled").select(
        "set", "celltype", F.round("scaled", 6).alias("scaled"))
