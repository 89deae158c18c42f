"""Evaluation aggregates over prediction tables (M-01..M-11, PF-06).

All metrics are grouped aggregates with partial aggregation; the per-label
tables have one row per label, so the final macro averages run over a
table bounded by the label count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.config import RELATIVE_ERROR_EPS
from cellframe.functions.columns import logsumexp


def confusion(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """M-06: (label, pred, n)."""
    return df.groupBy(F.col(label).alias("label"), F.col(pred).alias("pred")).agg(
        F.count(F.lit(1)).alias("n"))


def classification_metrics(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """One row: accuracy, error rate, macro precision/recall (zero division -> 1),
    macro F1 (0 when a label has no true positive) and micro F1.

    Labels are those that occur as truth or prediction.
    """
    tp = df.filter(F.col(label) == F.col(pred)).groupBy(F.col(label).alias("c")).agg(
        F.count(F.lit(1)).alias("tp"))
    t = df.groupBy(F.col(label).alias("c")).agg(F.count(F.lit(1)).alias("n_true"))
    p = df.groupBy(F.col(pred).alias("c")).agg(F.count(F.lit(1)).alias("n_pred"))
    per = (t.join(p, "c", "full").join(tp, "c", "left")
           .fillna(0, ["tp", "n_true", "n_pred"]))
    prec = F.when(F.col("n_pred") == 0, 1.0).otherwise(F.col("tp") / F.col("n_pred"))
    rec = F.when(F.col("n_true") == 0, 1.0).otherwise(F.col("tp") / F.col("n_true"))
    den = 2 * F.col("tp") + (F.col("n_pred") - F.col("tp")) + (F.col("n_true") - F.col("tp"))
    f1 = F.when(den == 0, 0.0).otherwise(2 * F.col("tp") / den)
    return per.agg(
        F.round(F.sum("tp") / F.sum("n_true"), 6).alias("accuracy"),
        F.round(1 - F.sum("tp") / F.sum("n_true"), 6).alias("error_rate"),
        F.round(F.avg(prec), 6).alias("macro_precision"),
        F.round(F.avg(rec), 6).alias("macro_recall"),
        F.round(F.avg(f1), 6).alias("macro_f1"),
        F.round(F.sum("tp") / F.sum("n_true"), 6).alias("micro_f1"),
        F.sum("n_true").alias("n"),
    )


def cross_entropy_rows(df: DataFrame, logits: str = "logits", label: str = "label") -> F.Column:
    """Per-row cross-entropy: logsumexp(logits) - logits[label] (label 0-based)."""
    return logsumexp(logits) - F.element_at(F.col(logits), F.col(label) + 1)


def masked_errors(df: DataFrame, pred: str = "pred", target: str = "target",
                  mask: str = "is_masked") -> DataFrame:
    """M-07 masked MSE and M-08 masked relative error over exploded positions.

    The relative error needs at least one masked position; with none the
    job fails, like the reference's assertion.
    """
    m = df.filter(F.col(mask))
    diff = F.col(pred) - F.col(target)
    out = m.agg(
        F.count(F.lit(1)).alias("n_masked"),
        F.round(F.try_divide(F.sum(diff * diff), F.count(F.lit(1))), 6).alias("mse"),
        F.round(F.avg(F.abs(diff) / (F.col(target) + F.lit(RELATIVE_ERROR_EPS))), 6).alias("mre"),
    )
    return out.withColumn("n_masked", F.when(F.col("n_masked") > 0, F.col("n_masked"))
                          .otherwise(F.raise_error(F.lit("no masked position"))))


def batch_positions(df: DataFrame, order_col: str, batch_size: int, drop_last: bool = False) -> DataFrame:
    """W-09: rows in ``order_col`` order cut into batches of ``batch_size`` (from 0).

    With ``drop_last`` the trailing partial batch is removed.
    """
    from cellframe.functions.ranking import global_row_number
    r = global_row_number(df, [order_col], "_rn", start=0)
    r = r.withColumn("batch", F.floor(F.col("_rn") / batch_size).cast("long")).drop("_rn")
    if drop_last:
        # only the last batch can be short: keep batches below n // batch_size
        n_full = df.count() // batch_size
        r = r.filter(F.col("batch") < n_full)
    return r


def interval_metrics(batched: DataFrame, interval: int, loss: str = "loss", correct: str = "correct") -> DataFrame:
    """M-10: per-batch mean loss and accuracy, averaged over each ``interval`` batches.

    The divisor is the real number of batches in the interval.
    """
    per_batch = batched.groupBy("batch").agg(F.avg(loss).alias("b_loss"), F.avg(F.col(correct).cast("double"))
                                             .alias("b_acc"), F.count(F.lit(1)).alias("b_rows"))
    return (per_batch.groupBy(F.floor(F.col("batch") / interval).cast("long").alias("interval"))
            .agg(F.count(F.lit(1)).alias("n_batches"), F.sum("b_rows").alias("n_rows"),
                 F.round(F.avg("b_loss"), 6).alias("mean_loss"), F.round(F.avg("b_acc"), 6).alias("mean_acc")))


def weighted_loss(batched: DataFrame, loss: str = "loss") -> DataFrame:
    """M-11: sum(batch mean loss * batch rows) / sum(rows)."""
    per_batch = batched.groupBy("batch").agg(F.avg(loss).alias("b_loss"), F.count(F.lit(1)).alias("b_rows"))
    return per_batch.agg(F.sum("b_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_batches"),
                         F.round(F.sum(F.col("b_loss") * F.col("b_rows")) / F.sum("b_rows"), 6).alias("loss"))
