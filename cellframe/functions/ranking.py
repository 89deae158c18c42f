"""Exact numbering of any size, and size-checked broadcasting.

Rows are range-partitioned on the order, sorted, and written once with the
partition and the place they have there; counts per partition come from
those same files.  So the offsets and the rows always see one layout,
whatever columns the frame has and whatever the optimizer reuses.  No window
ever runs over a whole table or a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellframe.session import materialize


def _laid_out(df: DataFrame, keys: list[str | Column], num_partitions: int | None) -> DataFrame:
    """``df`` in key order, written, with ``_pid`` and ``_mid`` (rising inside a partition) as stored columns."""
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
              .withColumn("_pid", F.spark_partition_id())
              # (partition << 33) + index in the sorted partition
              .withColumn("_mid", F.monotonically_increasing_id()))
    return materialize(ranged, "numbered")


def global_row_number(df: DataFrame, order: list[str | Column], name: str = "rn",
                      start: int = 1, num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = ``start``-based position of every row in the given order.

    ``order`` holds column names or expressions (``F.desc(...)``); give a
    unique order for a deterministic result.  The table of offsets has one
    row per partition, a proven bound, so it is broadcast.
    """
    rows = _laid_out(df, order, num_partitions)
    per = rows.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
    before = Window.partitionBy(F.lit(0)).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("_pid", "_m0", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (rows.join(F.broadcast(offsets), "_pid")
            .withColumn(name, F.col("_off") + F.col("_mid") - F.col("_m0") + F.lit(start))
            .drop("_pid", "_mid", "_m0", "_off"))


def grouped_row_number(df: DataFrame, group_cols: list[str], order: list[str | Column], name: str = "rn",
                       start: int = 1, num_partitions: int | None = None) -> DataFrame:
    """Exact ``row_number() over (partition by group order by order)`` without
    putting a group in one task.

    Rows are laid out by (group, order), so a hot group spreads over many
    partitions; inside one its rows lie together.  A table with one row per
    (partition, group) gives each group's offset.  Null groups are groups
    like any other; (group, order) must be unique for a fixed numbering.
    """
    if not group_cols:
        return global_row_number(df, order, name, start, num_partitions)
    rows = _laid_out(df, [*group_cols, *order], num_partitions)
    firsts = rows.groupBy("_pid", *group_cols).agg(F.min("_mid").alias("_m0"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = firsts.select(F.col("_pid").alias("_opid"), *[F.col(c).alias(f"_o_{c}") for c in group_cols], "_m0",
                         F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    same = F.col("_pid") == F.col("_opid")
    for c in group_cols:
        same = same & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    return (rows.join(offs, same)
            .withColumn(name, F.col("_off") + (F.col("_mid") - F.col("_m0")) + F.lit(start))
            .drop("_pid", "_mid", "_m0", "_off", "_opid", *[f"_o_{c}" for c in group_cols]))


def checked_broadcast(df: DataFrame, max_rows: int, max_bytes: int = 64 << 20) -> DataFrame:
    """Broadcast ``df`` only if its measured size is small.

    One bounded job counts at most ``max_rows + 1`` rows and the length of
    their values as text.  Beyond either bound the DataFrame is returned
    unchanged, so the join is a shuffle join (and AQE may still convert it
    by the size it measures at run time).
    """
    few = df.limit(max_rows + 1).select(F.length(F.to_json(F.struct("*"))).alias("b"))
    r = few.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if r["n"] <= max_rows and r["b"] <= max_bytes else df
