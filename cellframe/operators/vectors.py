"""Vector aggregates and joins on embedding tables (A-09..A-12, A-14, J-08, J-10).

Element-wise group means are computed on exploded (group, position, x)
rows with partial aggregation, so the shuffle carries at most
groups x width values per partition whatever the group sizes; the arrays
are reassembled per group afterwards (bounded by the width).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.functions.columns import cosine, l2_normalize, mean_truncating


def _reassemble(df: DataFrame, keys: list[str], k: str, x: str, out: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(k), F.col(x)))), lambda s: s[x]).alias(out))


def exploded(df: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """(keys..., k, x) with k from 1."""
    return (df.select(*keys, F.posexplode(vec).alias("_k", "x"))
            .select(*keys, (F.col("_k") + 1).cast("long").alias("k"), "x"))


def group_mean(df: DataFrame, keys: list[str], vec: str, weight: str | None = None) -> DataFrame:
    """Element-wise (weighted) mean vector per group, exploded: (keys..., k, x)."""
    cols = [*keys] + ([weight] if weight else [])
    e = df.select(*cols, F.posexplode(vec).alias("_k", "_x"))
    if weight:
        g = e.groupBy(*keys, "_k").agg((F.sum(F.col(weight) * F.col("_x")) / F.sum(weight)).alias("x"))
    else:
        g = e.groupBy(*keys, "_k").agg(F.avg("_x").alias("x"))
    return g.select(*keys, (F.col("_k") + 1).cast("long").alias("k"), "x")


def vector_mean(emb: DataFrame, genes: DataFrame, key: str = "gene", vec: str = "vec",
                group: str | None = None) -> DataFrame:
    """A-09: mean vector of a gene set (optionally one set per ``group``).

    ``genes`` lists (group?, gene); an empty set is an error.
    """
    keys = [group] if group else []
    j = emb.select(key, vec).join(genes.select(*keys, key), key, "left_semi" if not group else "inner")
    if j.limit(1).count() == 0:
        raise ValueError("empty gene set")
    return group_mean(j, keys, vec)


def vector_weighted(emb: DataFrame, weights: DataFrame, key: str = "gene", vec: str = "vec") -> DataFrame:
    """A-10: sum(w v) / sum(w) over genes present in both the set and the weights.

    No gene in both is an error (the reference asserts a non-empty set).
    """
    j = emb.join(weights.select(key, "w"), key)
    if j.limit(1).count() == 0:
        raise ValueError("no gene in both the set and the weights")
    return group_mean(j, [], vec, "w")


def vector_signed(emb: DataFrame, genes: DataFrame, markers: DataFrame, weights: DataFrame,
                  key: str = "gene", vec: str = "vec") -> DataFrame:
    """A-11: sum of +w v over set genes and -w v over markers outside the set."""
    j = (emb.join(weights.select(key, "w"), key)
         .join(genes.select(key, F.lit(True).alias("_in")), key, "left")
         .join(markers.select(key, F.lit(True).alias("_mk")), key, "left"))
    sign = F.when(F.col("_in"), F.lit(1.0)).when(F.col("_mk"), F.lit(-1.0))
    j = j.withColumn("_s", sign * F.col("w")).filter(F.col("_s").isNotNull())
    e = j.select("_s", F.posexplode(vec).alias("_k", "_x"))
    return (e.groupBy("_k").agg(F.sum(F.col("_s") * F.col("_x")).alias("x"))
            .select((F.col("_k") + 1).cast("long").alias("k"), "x"))


def average_sets(a: DataFrame, b: DataFrame, key: str = "gene", vec: str = "vec") -> DataFrame:
    """J-08: per gene of ``a``, (a + b) / 2 over the common prefix; a gene missing in ``b`` fails."""
    j = a.select(key, F.col(vec).alias("_a")).join(b.select(key, F.col(vec).alias("_b")), key, "left")
    j = j.withColumn("_b", F.when(F.col("_b").isNotNull(), F.col("_b")).otherwise(
        F.raise_error(F.concat(F.lit("gene missing in second set: "), F.col(key).cast("string")))))
    return j.select(key, mean_truncating("_a", "_b").alias(vec))


def rank_against_vector(emb: DataFrame, vector: list[float], key: str = "gene", vec: str = "vec") -> DataFrame:
    """J-10: cosine of every row with one literal vector; full ranking (ties: later row first)."""
    from cellframe.functions.ranking import global_row_number
    q = F.lit([float(x) for x in vector]).cast("array<double>")
    s = emb.select(key, cosine(F.col(vec), q).alias("sim"))
    return global_row_number(s, [F.desc("sim"), F.desc(key)], "rank")


def pool_cells(tokens: DataFrame, emb: DataFrame, gene_id: str = "gene_id", key: str = "gene",
               vec: str = "vec", pad_id: int = 0, max_broadcast_values: int = 8_000_000,
               mode: str = "mean", weight: str = "val", pos: str = "pos", tasks: int | None = None) -> DataFrame:
    """A-14: one vector per cell from its tokens' gene vectors.

    ``mode``: 'mean' (then unit length), 'weighted' (sum of weight x vector,
    then unit length) or 'first' (the vector of the token at position 1).
    Pad / unknown ids are dropped first.  Vectors are summed as vectors,
    with partial sums before the shuffle; no row per (token, dimension).  The gene-vector table is
    broadcast only when rows x width is under ``max_broadcast_values``;
    otherwise it is a shuffle join, in ``tasks`` tasks where they are given
    (for tables of tokens that grow), as is the sum by cell that follows;
    without ``tasks`` hot genes are split by AQE skew join.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    from cellframe.functions.ranking import checked_broadcast
    if mode not in ("mean", "weighted", "first"):
        raise ValueError(f"unknown pooling {mode!r}: use 'mean', 'weighted' or 'first'")
    width = emb.select(F.size(vec).alias("w")).agg(F.max("w")).first()[0] or 1
    v = emb.select(F.col(key).alias(gene_id), F.col(vec).alias("_v"))
    ev = checked_broadcast(v, max(1, max_broadcast_values // width))
    t = tokens.filter(F.col(gene_id) != pad_id)
    if mode == "first":
        t = t.filter(F.col(pos) == 1)
    shuffled = ev is v and tasks
    if shuffled:
        t, ev = t.repartition(tasks, gene_id), v.repartition(tasks, gene_id)
    t = t.join(ev, gene_id)
    if mode == "first":
        return t.select("cell", F.col("_v").alias("cell_vec"))
    t = (t.repartition(tasks, "cell") if shuffled else t).withColumn("_v", array_to_vector("_v"))
    # the weighted mean has the direction of the weighted sum
    mean = Summarizer.mean(F.col("_v"), F.col(weight).cast("double")) if mode == "weighted" else Summarizer.mean(F.col("_v"))
    m = t.groupBy("cell").agg(vector_to_array(mean).alias("mean_vec"))
    return m.select("cell", l2_normalize("mean_vec").alias("cell_vec"))
