"""Per-sample gene statistics: variable genes (W-02) and their union (U-04)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_variable_genes(expr: DataFrame, n_cells: DataFrame, k: int) -> DataFrame:
    """Top ``k`` genes per sample by sample variance over all cells (zeros included).

    Sparse input: absent rows are zeros, so the variance comes from sums
    (n * sum(x^2) - sum(x)^2) / (n (n - 1)) with n the sample's cell count.
    The rank uses the numerator (exact for whole-number counts); ties go to
    the smaller gene.  Sums are partial-aggregated per (sample, gene) before
    the shuffle, and the ranking window sees one row per gene of a sample.
    """
    g = expr.groupBy("sample", "gene").agg(F.sum("value").alias("s"),
                                          F.sum(F.col("value") * F.col("value")).alias("ss"))
    g = g.join(F.broadcast(n_cells), "sample")
    n = F.col("n_cells")
    score = n * F.col("ss") - F.col("s") * F.col("s")
    g = g.withColumn("score", score).withColumn(
        "var", F.round(F.try_divide(F.col("score"), n * (n - F.lit(1.0))), 6))
    w = Window.partitionBy("sample").orderBy(F.desc("score"), F.asc("gene"))
    return (g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .withColumn("rank", F.col("rank").cast("int")))


def ready_ranked_genes(ranked: DataFrame, k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` genes of each sample of a list that is ranked already (rank from 1)."""
    return ranked.filter(F.col(rank) <= k)
