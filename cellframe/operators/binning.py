"""Per-sample expression range (A-01) and expression binning (S-01).

The range is a grouped aggregate with map-side partial aggregation, so a
sample holding a third of all rows is still reduced in parallel before the
shuffle; the result has one row per sample file and is broadcast back.
A window partitioned by sample would instead put a whole sample into one
task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.config import BIN_EDGES
from cellframe.functions.columns import bin_value


def sample_range(expr: DataFrame, sample: str = "sample", value: str = "value") -> DataFrame:
    """(sample, min_pos, max_val): min over positive values, max over all values.

    Computed per sample file before any cell filter, like the reference.
    NaN values are left out of both (Spark would order NaN above all numbers).
    """
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    return expr.groupBy(sample).agg(
        F.min(F.when(v > 0, v)).alias("min_pos"),
        F.max(v).alias("max_val"),
    )


def bin_expression(expr: DataFrame, n_edges: int = BIN_EDGES, sample: str = "sample",
                   value: str = "value", out: str = "bin") -> DataFrame:
    """Add ``out`` = bin index (0..n_edges) of ``value`` within its sample's range.

    The range table has one row per sample file (bounded by the file count),
    so it is broadcast; the expression table is never shuffled here.
    """
    rng = sample_range(expr, sample, value)
    return (expr.join(F.broadcast(rng), sample)
            .withColumn(out, bin_value(F.col(value), F.col("min_pos"), F.col("max_val"), n_edges))
            .drop("min_pos", "max_val"))
