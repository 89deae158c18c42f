"""Train / valid / test splits (W-05..W-08, U-03), chunking (IO-10) and masking (W-04).

Random order is md5('key:seed') so every engine agrees on it.  Exact ranks
never use one window per label (a label may hold a third of all rows): they
come from ``grouped_row_number``, whose range layout grows with the data.
Rows without a label are a class of their own.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellframe.config import MASK_RATIO, MASK_VALUE, PAD_VALUE
from cellframe.functions.columns import hash_order
from cellframe.functions.ranking import checked_broadcast, grouped_row_number

MAX_CLASSES = 100_000  # class tables up to so many rows are broadcast


def bucketed_rank(df: DataFrame, group_cols: list[str], key: str, out: str = "rank") -> DataFrame:
    """Exact 1-based rank of ``key`` (unique) within ``group_cols``; a null group is a group."""
    return grouped_row_number(df, group_cols, [key], out).withColumn(out, F.col(out).cast("long"))


def split_sizes(n: int, test_size: float) -> tuple[int, int, int]:
    """(train, valid, test) row counts of the two-stage shuffle split."""
    remain = math.ceil(test_size * n) if test_size > 0 else n
    train = n - remain if test_size > 0 else 0
    valid = math.ceil(remain / 2) if test_size > 0 else 0
    return train, valid, remain - valid


def split_random(df: DataFrame, key: str, seed: int, test_size: float) -> DataFrame:
    """Add ``split``: first train rows in md5 order, then valid, then test."""
    if test_size <= 0:
        return split_none(df)
    n = df.count()
    train, valid, _ = split_sizes(n, test_size)
    r = bucketed_rank(df.withColumn("_k", hash_order(key, seed=seed)), [], "_k", "_r")
    return (r.withColumn("split", F.when(F.col("_r") <= train, "train")
                         .when(F.col("_r") <= train + valid, "valid").otherwise("test"))
            .drop("_k", "_r"))


def split_none(df: DataFrame) -> DataFrame:
    return df.withColumn("split", F.lit("test"))


def _largest_remainder(counts: DataFrame, total_col: str, draws: F.Column, out: str) -> DataFrame:
    """Per-class quota of ``draws`` rows: floor share + 1 for the largest remainders.

    ``counts`` has one row per class (``label``, ``total_col``) plus the
    per-split totals; the windows run over that small class table only.
    Ties in remainder go to the smaller label (documented deterministic rule).
    """
    cont = F.col(total_col) * draws / F.col("_n_all")
    c = counts.withColumn("_cont", cont).withColumn("_floor", F.floor("_cont"))
    c = c.withColumn("_rem", F.col("_cont") - F.col("_floor"))
    one = Window.partitionBy(F.lit(0))
    c = c.withColumn("_need", draws - F.sum("_floor").over(one))
    c = c.withColumn("_rrank", F.row_number().over(one.orderBy(F.desc("_rem"), F.asc("label"))))
    return (c.withColumn(out, (F.col("_floor") + F.when(F.col("_rrank") <= F.col("_need"), 1).otherwise(0))
                         .cast("long"))
            .drop("_cont", "_floor", "_rem", "_need", "_rrank"))


def stratified_quotas(df: DataFrame, label: str, test_size: float) -> DataFrame:
    """Class table (label, n, n_train, n_test, n_valid) of the two-stage split.

    Stage 1 keeps ``n - ceil(test_size*n)`` rows for train with
    largest-remainder class quotas; a class with exactly one row left
    outside train gets one more row moved out of train (singleton repair).
    Stage 2 splits the remainder in halves the same way: the first part is
    test (floor half), the second valid (ceil half).
    """
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    one = Window.partitionBy(F.lit(0))
    c = counts.withColumn("_n_all", F.sum("n").over(one))
    n_train = F.col("_n_all") - F.ceil(F.col("_n_all") * F.lit(test_size))
    c = _largest_remainder(c, "n", n_train, "n_train")
    c = c.withColumn("_remain", F.col("n") - F.col("n_train"))
    fix = (F.col("_remain") == 1) & (F.col("n_train") > 0)
    c = (c.withColumn("n_train", F.when(fix, F.col("n_train") - 1).otherwise(F.col("n_train")))
         .withColumn("_remain", F.when(fix, F.col("_remain") + 1).otherwise(F.col("_remain"))))
    c = c.withColumn("_n_all", F.sum("_remain").over(one))
    n_first = F.col("_n_all") - F.ceil(F.col("_n_all") * F.lit(0.5))
    c = _largest_remainder(c, "_remain", n_first, "n_test")
    return c.select("label", "n", "n_train", "n_test",
                    (F.col("_remain") - F.col("n_test")).cast("long").alias("n_valid"))


def split_stratified(df: DataFrame, key: str, label: str, seed: int, test_size: float) -> DataFrame:
    """Add ``split`` with exact per-class quotas (md5 order inside each class)."""
    if test_size <= 0:
        return split_none(df)
    q = stratified_quotas(df, label, test_size)
    r = bucketed_rank(df.withColumn("_k", hash_order(key, seed=seed)), [label], "_k", "_r")
    q = checked_broadcast(q.withColumnRenamed("label", "_label"), MAX_CLASSES)
    j = r.join(q, r[label].eqNullSafe(q["_label"]))  # one row per class
    return (j.withColumn("split", F.when(F.col("_r") <= F.col("n_train"), "train")
                         .when(F.col("_r") <= F.col("n_train") + F.col("n_test"), "test")
                         .otherwise("valid"))
            .drop("_k", "_r", "_label", "n", "n_train", "n_test", "n_valid"))


def chunk_plan(df: DataFrame, key: str, seed: int, chunk_rows: int) -> DataFrame:
    """Add ``chunk`` (from 1) and ``row_in_split``: md5-ordered rows cut into chunks per split."""
    r = bucketed_rank(df.withColumn("_k", hash_order(key, seed=seed)), ["split"], "_k", "row_in_split")
    return (r.withColumn("chunk", (F.floor((F.col("row_in_split") - 1) / chunk_rows) + 1).cast("int"))
            .drop("_k"))


def write_chunks(df: DataFrame, path: str, compression: str = "zstd", tasks: int | None = None) -> None:
    """Write split chunks as parquet partitioned by split and chunk, in ``tasks`` tasks (default: as the session has)."""
    (df.repartition(*([tasks] if tasks else []), "split", "chunk").write.mode("overwrite").option("compression", compression)
     .partitionBy("split", "chunk").parquet(path))


def read_chunks(spark, path: str, split: str, start_chunk: int, num_chunks: int | None = None,
                end_chunk: int | None = None) -> DataFrame:
    """Read chunks ``start..end`` of one split (``end_chunk`` wins over ``num_chunks``).

    The filters are on partition columns, so only those folders are listed
    and read; a requested chunk that does not exist is an error.
    """
    if split not in ("train", "valid", "test"):
        raise ValueError("split must be 'train', 'valid' or 'test'")
    if num_chunks is None and end_chunk is None:
        raise ValueError("give num_chunks or end_chunk")
    end = end_chunk if end_chunk is not None else start_chunk + num_chunks - 1
    df = spark.read.parquet(path).filter((F.col("split") == split)
                                         & F.col("chunk").between(start_chunk, end))
    # chunk numbers come from the folder names, not from the rows
    present = {int(m[1]) for f in df.inputFiles() if (m := re.search(r"/chunk=(\d+)/", f))}
    missing = set(range(start_chunk, end + 1)) - present
    if missing:
        raise FileNotFoundError(f"missing {split} chunks {sorted(missing)}")
    return df


# ---------------------------------------------------------------- masking --
def random_mask(seqs: DataFrame, key: str = "cell", seed: int = 1234, ratio: float = MASK_RATIO,
                mask_value: float = MASK_VALUE, pad_value: float = PAD_VALUE) -> DataFrame:
    """W-04: per row, floor(ratio * non-pad count) non-pad positions set to ``mask_value``.

    Positions are drawn in md5('key:position:seed') order, entirely inside
    the row's arrays (no shuffle).  Adds ``masked_vals`` and ``mask``
    (boolean per position); ``vals`` is left unchanged.

    Cost per row is O(L log L): the md5 keys are computed once per position
    and sorted once; the chosen / not-chosen halves are cut with ``slice``
    (row-level arguments), never with a lookup evaluated per element.
    """
    keyed = F.transform("vals", lambda v, i: F.struct(
        (v == pad_value).alias("pad"),
        F.md5(F.concat(F.col(key).cast("string"), F.lit(":"), (i + 1).cast("string"),
                       F.lit(f":{seed}"))).alias("k"),
        (i + 1).alias("p")))
    out = seqs.withColumn("_ks", F.array_sort(keyed))  # real positions first, in md5 order
    n_real = F.size(F.filter("vals", lambda v: v != pad_value))
    out = out.withColumn("_nm", F.floor(n_real * F.lit(ratio)).cast("int"))
    chosen = F.transform(F.slice("_ks", 1, F.col("_nm")), lambda s: F.struct(s["p"].alias("p"), F.lit(True).alias("m")))
    rest = F.transform(F.slice("_ks", F.col("_nm") + 1, F.size("_ks")),
                       lambda s: F.struct(s["p"].alias("p"), F.lit(False).alias("m")))
    out = out.withColumn("mask", F.transform(F.array_sort(F.concat(chosen, rest)), lambda s: s["m"]))
    out = out.withColumn("masked_vals", F.zip_with("vals", "mask", lambda v, m: F.when(m, F.lit(mask_value))
                                                    .otherwise(v)))
    return out.drop("_ks", "_nm")
