"""Prediction-table metrics, scoring and per-row array expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellframe.config import PAD_VALUE, Params
from cellframe.functions.columns import argmax, l2_normalize, softmax
from cellframe.operators import metrics, scoring, splits
from cellframe.plans.oracle_views import with_views
from cellframe.plans.q_splits import MASK_SQL, sequences
from cellframe.plans.registry import query
from cellframe.sources import tables as T

P = Params()
ARGMAX_SQL = "CAST(list_position(logits, list_max(logits)) - 1 AS INT)"
LSE_SQL = "(list_max(logits) + ln(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits))))))"
INTERVAL = 3  # batches per log interval in the test (the reference logs every 100)


def predictions(spark, sf):
    p = T.pred(spark, sf)
    return p.withColumn("pred", argmax("logits"))


PRED_SQL = {"p": f"SELECT cell, label, logits, {ARGMAX_SQL} AS pred FROM v_pred"}
PER_LABEL_SQL = {
    **PRED_SQL,
    "t": "SELECT label AS c, COUNT(*) AS n_true FROM p GROUP BY label",
    "pp": "SELECT pred AS c, COUNT(*) AS n_pred FROM p GROUP BY pred",
    "tp": "SELECT label AS c, COUNT(*) AS tp FROM p WHERE label = pred GROUP BY label",
    "per": "SELECT COALESCE(t.c, pp.c) AS c, COALESCE(n_true, 0) AS n_true, COALESCE(n_pred, 0) AS n_pred "
           "FROM t FULL JOIN pp ON t.c = pp.c",
    "per2": "SELECT per.*, COALESCE(tp.tp, 0) AS tp FROM per LEFT JOIN tp ON tp.c = per.c",
}


# ---------------------------------------------------------- M-01..M-05 ----
@query("cls_metrics", with_views(
    "SELECT ROUND(SUM(tp) / SUM(n_true), 6) AS accuracy, ROUND(1 - SUM(tp) / SUM(n_true), 6) AS error_rate, "
    "ROUND(AVG(CASE WHEN n_pred = 0 THEN 1.0 ELSE tp / n_pred END), 6) AS macro_precision, "
    "ROUND(AVG(CASE WHEN n_true = 0 THEN 1.0 ELSE tp / n_true END), 6) AS macro_recall, "
    "ROUND(AVG(CASE WHEN 2 * tp + (n_pred - tp) + (n_true - tp) = 0 THEN 0.0 "
    "ELSE 2 * tp / (2 * tp + (n_pred - tp) + (n_true - tp)) END), 6) AS macro_f1, "
    "ROUND(SUM(tp) / SUM(n_true), 6) AS micro_f1, CAST(SUM(n_true) AS BIGINT) AS n FROM per2", PER_LABEL_SQL))
def q_cls_metrics(spark, sf):
    return metrics.classification_metrics(predictions(spark, sf))


# ---------------------------------------------------------------- M-06 ----
@query("confusion", with_views("SELECT label, pred, COUNT(*) AS n FROM p GROUP BY label, pred", PRED_SQL))
def q_confusion(spark, sf):
    return metrics.confusion(predictions(spark, sf))


# ---------------------------------------------------------------- M-09 ----
@query("cross_entropy", with_views(
    f"SELECT COUNT(*) AS n, ROUND(AVG({LSE_SQL} - logits[label + 1]), 6) AS cross_entropy FROM v_pred"))
def q_cross_entropy(spark, sf):
    p = T.pred(spark, sf)
    return p.agg(F.count(F.lit(1)).alias("n"),
                 F.round(F.avg(metrics.cross_entropy_rows(p)), 6).alias("cross_entropy"))


# ---------------------------------------------------------- S-04 / S-05 ---
@query("softmax_argmax", with_views(
    "SELECT cell, pred, CAST(k AS BIGINT) AS k, ROUND(prob, 6) AS prob FROM ("
    "SELECT cell, pred, unnest(generate_series(1, len(logits))) AS k, "
    "unnest(list_transform(logits, lambda x: exp(x - list_max(logits)) / "
    "list_sum(list_transform(logits, lambda y: exp(y - list_max(logits)))))) AS prob FROM p) t", PRED_SQL))
def q_softmax_argmax(spark, sf):
    p = predictions(spark, sf).withColumn("probs", softmax("logits"))
    return (p.select("cell", "pred", F.posexplode("probs").alias("k", "prob"))
            .select("cell", "pred", (F.col("k") + 1).cast("long").alias("k"), F.round("prob", 6).alias("prob")))


# ---------------------------------------------------------------- S-03 ----
@query("l2_normalize", with_views(
    "SELECT gene, CAST(k AS BIGINT) AS k, ROUND(x, 6) AS x FROM ("
    "SELECT gene, unnest(generate_series(1, len(vec))) AS k, "
    "unnest(list_transform(vec, lambda v: v / sqrt(list_sum(list_transform(vec, lambda w: w * w))))) AS x FROM v_emb) t"))
def q_l2_normalize(spark, sf):
    e = T.emb(spark, sf).withColumn("u", l2_normalize("vec"))
    return (e.select("gene", F.posexplode("u").alias("k", "x"))
            .select("gene", (F.col("k") + 1).cast("long").alias("k"), F.round("x", 6).alias("x")))


# ---------------------------------------------------------- M-07 / M-08 ---
@query("masked_metrics", with_views(
    "SELECT COUNT(*) AS n_masked, ROUND(SUM((pred - val) * (pred - val)) / COUNT(*), 6) AS mse, "
    "ROUND(AVG(ABS(pred - val) / (val + 1e-6)), 6) AS mre FROM ("
    "SELECT m.*, COALESCE(cm.mu, 0.0) AS pred FROM masked m LEFT JOIN "
    "(SELECT cell, AVG(val) AS mu FROM masked WHERE NOT is_masked AND val <> -2.0 GROUP BY cell) cm "
    "ON cm.cell = m.cell WHERE m.is_masked) t", MASK_SQL))
def q_masked_metrics(spark, sf):
    """Targets at masked positions vs a per-cell mean of the unmasked values."""
    m = splits.random_mask(sequences(spark, sf), "cell", P.seed, P.mask_ratio, P.mask_value, P.pad_value)
    z = F.arrays_zip(F.col("vals").alias("v"), F.col("mask").alias("m"))
    kept = F.filter(z, lambda s: ~s["m"] & (s["v"] != PAD_VALUE))
    mu = F.try_divide(F.aggregate(kept, F.lit(0.0), lambda acc, s: acc + s["v"]), F.size(kept))
    rows = (m.withColumn("pred", F.coalesce(mu, F.lit(0.0)))
            .select("pred", F.explode(F.filter(z, lambda s: s["m"])).alias("s"))
            .select("pred", F.col("s.v").alias("target"), F.lit(True).alias("is_masked")))
    return metrics.masked_errors(rows)


# ---------------------------------------------------------- M-10 / W-09 ---
BATCH_SQL = {
    "pb": f"SELECT cell, label, {ARGMAX_SQL} = label AS correct, {LSE_SQL} - logits[label + 1] AS loss, "
          f"CAST(FLOOR((ROW_NUMBER() OVER (ORDER BY cell) - 1) / {P.batch_size}) AS BIGINT) AS batch FROM v_pred",
    "bt": "SELECT batch, AVG(loss) AS b_loss, AVG(CAST(correct AS DOUBLE)) AS b_acc, COUNT(*) AS b_rows "
          "FROM pb GROUP BY batch",
}


def batched_predictions(spark, sf, drop_last: bool = False):
    p = T.pred(spark, sf)
    p = p.select("cell", "label", (argmax("logits") == F.col("label")).alias("correct"),
                 metrics.cross_entropy_rows(p).alias("loss"))
    return metrics.batch_positions(p, "cell", P.batch_size, drop_last)


@query("interval_metrics", with_views(
    f"SELECT CAST(FLOOR(batch / {INTERVAL}) AS BIGINT) AS interval, COUNT(*) AS n_batches, "
    "CAST(SUM(b_rows) AS BIGINT) AS n_rows, ROUND(AVG(b_loss), 6) AS mean_loss, ROUND(AVG(b_acc), 6) AS mean_acc "
    f"FROM bt GROUP BY FLOOR(batch / {INTERVAL})", BATCH_SQL))
def q_interval_metrics(spark, sf):
    return metrics.interval_metrics(batched_predictions(spark, sf), INTERVAL)


# ---------------------------------------------------------------- M-11 ----
@query("weighted_loss", with_views(
    "SELECT CAST(SUM(b_rows) AS BIGINT) AS n_rows, COUNT(*) AS n_batches, "
    "ROUND(SUM(b_loss * b_rows) / SUM(b_rows), 6) AS loss FROM bt", BATCH_SQL))
def q_weighted_loss(spark, sf):
    return metrics.weighted_loss(batched_predictions(spark, sf))


# ---------------------------------------------------------------- F-01 ----
SCORE_SQL = {
    "ex": "SELECT gene, cluster, unnest(generate_series(1, len(vec))) AS k, unnest(vec) AS x FROM v_emb",
    "cen": "SELECT cluster AS c, k, AVG(x) AS w FROM ex GROUP BY cluster, k",
    "lg": "SELECT ex.gene, ex.cluster, cen.c, SUM(ex.x * cen.w) AS logit FROM ex JOIN cen ON cen.k = ex.k "
          "GROUP BY ex.gene, ex.cluster, cen.c",
    "mx": "SELECT gene, MAX(logit) AS m FROM lg GROUP BY gene",
}


def centroid_weights(spark, sf) -> list[list[float]]:
    """Linear head weights = per-class mean embedding (classes x width).

    The collected object is the model parameter: classes x width numbers,
    bounded by the label count, not by the data size.
    """
    e = T.emb(spark, sf)
    cen = (e.select("cluster", F.posexplode("vec").alias("k", "x"))
           .groupBy("cluster", "k").agg(F.avg("x").alias("w")))
    rows = cen.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("k", "w"))).alias("ws")) \
              .orderBy("cluster").collect()
    return [[s["w"] for s in r["ws"]] for r in rows]


@query("score_linear", with_views(
    "SELECT lg.gene AS cell, lg.cluster AS label, CAST(MIN(c) FILTER (WHERE logit = m) AS INT) AS pred, "
    "ROUND(1.0 / SUM(exp(logit - m)), 6) AS p_max FROM lg JOIN mx ON mx.gene = lg.gene "
    "GROUP BY lg.gene, lg.cluster", SCORE_SQL))
def q_score_linear(spark, sf):
    w = centroid_weights(spark, sf)
    e = T.emb(spark, sf).select(F.col("gene").alias("cell"), F.col("cluster").alias("label"),
                                F.col("vec").alias("emb"))
    s = scoring.score_linear(e, w)
    return s.select("cell", "label", "pred", F.round("p_max", 6).alias("p_max"))


@query("score_model", with_views(
    "SELECT lg.gene AS cell, lg.cluster AS label, CAST(MIN(c) FILTER (WHERE logit = m) AS INT) AS pred, "
    "ROUND(1.0 / SUM(exp(logit - m)), 6) AS p_max FROM lg JOIN mx ON mx.gene = lg.gene "
    "GROUP BY lg.gene, lg.cluster", SCORE_SQL))
def q_score_model(spark, sf):
    """F-01 with a caller-supplied Python model (numpy matrix product) over Arrow batches."""
    import numpy as np
    w = np.asarray(centroid_weights(spark, sf), dtype=np.float64)
    e = T.emb(spark, sf).select(F.col("gene").alias("cell"), F.col("cluster").alias("label"),
                                F.col("vec").alias("emb"))
    s = scoring.score_with_model(e, lambda x: x @ w.T, key="cell", extra=["label"])
    return s.select("cell", "label", "pred", F.round("p_max", 6).alias("p_max"))
