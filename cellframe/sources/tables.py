"""Parquet sources and the long-form views the pipeline runs on.

The driver's tables stand in for single-cell inputs (see FIXTURES.md):
customer = cell, region = sample file, nation = batch, market segment =
cell type, part = gene, quantity = expression.  Each view is a lazy
DataFrame: only the projected columns reach the parquet scan and filters
are pushed into it by Catalyst.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellframe.session import tasks_for

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_cells: sample, cell, batch, celltype, row_pos (one row per cell)."""
    c = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf_dir, "region", "r_regionkey", "r_name")
    return (c.join(n, c.c_nationkey == n.n_nationkey)
            .join(r, n.n_regionkey == r.r_regionkey)
            .select(F.col("r_name").alias("sample"), F.col("c_custkey").alias("cell"),
                    F.col("n_name").alias("batch"), F.col("c_mktsegment").alias("celltype"),
                    F.col("c_custkey").alias("row_pos")))


def expr_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks of a shuffle of expression rows; the rows are counted from the files' footers."""
    return tasks_for(spark, table(spark, sf_dir, "lineitem").count())


def expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_expr: long sparse expression (sample, cell, gene, value), no zeros.

    The cell -> sample join happens before the (cell, gene) aggregation, so
    the hash partitioning on ``cell`` also serves the aggregation
    (its keys contain ``cell``) and every later per-cell step (windows,
    sequence assembly): one shuffle on ``cell`` for the whole per-cell
    pipeline.  Shuffles have as many tasks as the rows need, so that what a
    task holds does not grow with the table.
    """
    tasks = expr_tasks(spark, sf_dir)
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_quantity").repartition(tasks, "l_orderkey")
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").repartition(tasks, "o_orderkey")
    rows = li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("cell"), F.col("l_partkey").alias("gene"), "l_quantity").repartition(tasks, "cell")
    return (rows.join(cell_sample(spark, sf_dir), "cell")
            .groupBy("sample", "cell", "gene").agg(F.sum("l_quantity").alias("value")))


def cell_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell -> sample map (customer joined with the two tiny dimensions)."""
    c = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    r = table(spark, sf_dir, "region", "r_regionkey", "r_name")
    return (c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
            .join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
            .select(F.col("c_custkey").alias("cell"), F.col("r_name").alias("sample")))


def expr_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_expr_zero: expression with explicit zeros (sample, cell, gene, value).

    Hash-partitioned on (sample, cell) before aggregating: that partitioning
    satisfies this (sample, cell, gene) aggregate and every later per-cell
    step of keep-zero mode, so they share one shuffle.
    """
    li = table(spark, sf_dir, "lineitem", "l_returnflag", "l_orderkey", "l_partkey", "l_discount")
    li = li.select(F.col("l_returnflag").alias("sample"), F.col("l_orderkey").alias("cell"),
                   F.col("l_partkey").alias("gene"), "l_discount").repartition(
                       expr_tasks(spark, sf_dir), "sample", "cell")
    return (li.groupBy("sample", "cell", "gene")
            .agg(F.max(F.round(F.col("l_discount") * 100)).alias("value")))


def gene_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_gene_vocab: partial gene vocabulary (gene, id), ids dense from 1.

    Numbered with a range-partitioned global row number, never a window
    over a single partition, because the part table grows with the data.
    """
    from cellframe.functions.ranking import global_row_number
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _GENE_VOCABS:  # numbered once per application: the numbering is a written table
        p = (table(spark, sf_dir, "part", "p_partkey", "p_size").filter(F.col("p_size") <= 40)
             .select(F.col("p_partkey").alias("gene")))
        _GENE_VOCABS[key] = global_row_number(p, ["gene"], "id").select("gene", F.col("id").cast("int").alias("id"))
    return _GENE_VOCABS[key]


_GENE_VOCABS: dict[tuple[str, str], DataFrame] = {}


def label_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_label_vocab: (name, id) of market segments in first-seen order from 0.

    The window runs over the distinct names only (one row per type).
    """
    from pyspark.sql import Window as W
    c = table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    first = c.groupBy(F.col("c_mktsegment").alias("name")).agg(F.min("c_custkey").alias("first_pos"))
    return first.select("name", (F.row_number().over(W.orderBy("first_pos")) - 1).cast("int").alias("id"))


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_emb: gene embeddings (gene, vec array<double>, cluster)."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    return e.select(F.col("vec_id").alias("gene"),
                    F.transform("embedding", lambda x: x.cast("double")).alias("vec"),
                    F.col("label").alias("cluster"))


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_pred: per-cell logits (cell, logits array<double>(10), label)."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    return e.select(F.col("vec_id").alias("cell"),
                    F.slice(F.transform("embedding", lambda x: x.cast("double")), 1, 10).alias("logits"),
                    F.col("label"))


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
