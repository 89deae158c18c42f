"""Source / sink queries: each writes data derived from the tables, reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellframe.functions.columns import argmax
from cellframe.operators import vocab
from cellframe.plans.oracle_views import with_views
from cellframe.plans.q_vectors import AVG_SQL, second_set
from cellframe.plans.q_vocab import BATCH_VOCAB_SQL, batch_vocab
from cellframe.plans.registry import query
from cellframe.session import scratch_path
from cellframe.sources import files
from cellframe.sources import tables as T


# ---------------------------------------------------------------- IO-01 ---
@query("scan_expr", with_views("SELECT sample, cell, gene, value FROM v_expr"))
def q_scan_expr(spark, sf):
    """Expression written one folder per sample, scanned back as one table."""
    path = scratch_path(spark, "samples")
    T.expr(spark, sf).write.mode("overwrite").partitionBy("sample").parquet(path)
    return files.scan_samples(spark, path).select("sample", "cell", "gene", "value")


# ---------------------------------------------------------------- IO-02 ---
@query("melt_wide", with_views(
    "SELECT l_orderkey AS cell, 'g' || CAST(l_linenumber AS VARCHAR) AS gene, SUM(l_quantity) AS value "
    "FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING SUM(l_quantity) <> 0"))
def q_melt_wide(spark, sf):
    """A wide cells x genes frame (one column per line number, summed quantity) melted back to long form."""
    li = T.table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    lines = [r[0] for r in li.select("l_linenumber").distinct().orderBy("l_linenumber").collect()]
    wide = (li.groupBy(F.col("l_orderkey").alias("cell"))
            .pivot("l_linenumber", lines).agg(F.sum("l_quantity")))
    wide = wide.select("cell", *[F.coalesce(F.col(str(x)), F.lit(0.0)).alias(f"g{x}") for x in lines])
    return files.melt_wide(wide, ["cell"], "gene", "value")


# ---------------------------------------------------------- IO-03 / U-01 --
NO_TYPE_SAMPLE = "EUROPE"  # its metadata files carry no celltype column (skip rule)


@query("meta_union", with_views(
    f"SELECT cell, celltype FROM v_cells WHERE sample <> '{NO_TYPE_SAMPLE}'"))
def q_meta_union(spark, sf):
    """Per-sample metadata CSVs (one sample lacking the column) stacked back into (cell, celltype)."""
    path = scratch_path(spark, "meta")
    c = T.cells(spark, sf)
    files.write_labels(c.filter(F.col("sample") != NO_TYPE_SAMPLE)
                       .select(F.col("cell").cast("string").alias("cell_name"),
                               F.col("batch").alias("orig.ident"), "celltype", "sample"),
                       f"{path}/typed")
    files.write_labels(c.filter(F.col("sample") == NO_TYPE_SAMPLE)
                       .select(F.col("cell").cast("string").alias("cell_name"),
                               F.col("batch").alias("orig.ident"), "sample"),
                       f"{path}/untyped")
    m = files.read_metadata(spark, path, "celltype", suffix=".csv")
    return m.select(F.col("cell").cast("long").alias("cell"), "celltype")


# ---------------------------------------------------------------- IO-04 ---
@query("keyed_labels", with_views("SELECT CAST(cell AS VARCHAR) AS cell, celltype FROM v_cells"))
def q_keyed_labels(spark, sf):
    """A label table written as CSV and read back by key, each cell once."""
    path = scratch_path(spark, "labels")
    files.write_labels(T.cells(spark, sf).select(F.col("cell").cast("string").alias("cell"), "celltype"), path)
    return files.read_keyed_labels(spark, path)


# ---------------------------------------------------------- IO-06 / IO-11 -
@query("emb_header_copy", with_views(
    "SELECT CAST(COUNT(*) AS VARCHAR) || ' ' || CAST(MAX(len(vec)) AS VARCHAR) AS header, COUNT(*) AS n_rows FROM v_emb"))
def q_emb_header_copy(spark, sf):
    """The header of an embedding text table, copied to the averaged table and read from there."""
    from cellframe.operators import vectors
    first, second = scratch_path(spark, "embtext"), scratch_path(spark, "embtext")
    e = T.emb(spark, sf).select("gene", "vec")
    files.write_embedding_text(e, first)
    avg = vectors.average_sets(e, second_set(spark, sf))
    files.write_embedding_text(avg, second, header=files.read_embedding_header(spark, first))
    body = files.read_embedding_text(spark, f"{second}/body", strict=True, header=False)
    head = files.read_embedding_header(spark, second).select(F.col("value").alias("header"), F.lit(0).alias("n"))
    both = head.unionByName(body.select(F.lit(None).cast("string").alias("header"), F.lit(1).alias("n")))
    return both.agg(F.max("header").alias("header"), F.sum("n").alias("n_rows"))


# ---------------------------------------------------------- IO-05 / IO-09 -
@query("vocab_roundtrip", with_views(BATCH_VOCAB_SQL))
def q_vocab_roundtrip(spark, sf):
    """Batch vocabulary written as a JSON object and read back."""
    path = scratch_path(spark, "vocab")
    files.write_vocab_json(batch_vocab(spark, sf), path)
    return files.read_vocab_json(spark, path)


# ---------------------------------------------------------- IO-06 / IO-11 -
@query("emb_text_read", with_views(
    "SELECT gene, CAST(k AS BIGINT) AS k, ROUND(x, 6) AS x FROM ("
    "SELECT gene, unnest(generate_series(1, len(vec))) AS k, unnest(vec) AS x FROM avg) t", AVG_SQL))
def q_emb_text_read(spark, sf):
    """Averaged embeddings written as text ("gene v1 ... vd", header line) and parsed back."""
    from cellframe.operators import vectors
    path = scratch_path(spark, "embtext")
    avg = vectors.average_sets(T.emb(spark, sf).select("gene", "vec"), second_set(spark, sf))
    files.write_embedding_text(avg, path)
    back = files.read_embedding_text(spark, f"{path}/body", strict=True, key_type="long", header=False)
    ex = vectors.exploded(back, ["gene"], "vec")
    return ex.select("gene", "k", F.round("x", 6).alias("x"))


# ---------------------------------------------------------------- IO-13 ---
@query("annotate_result", with_views(
    "SELECT p.cell, l.name AS pred_name, c.batch FROM v_pred p "
    "LEFT JOIN v_label_vocab l ON l.id = CAST(list_position(p.logits, list_max(p.logits)) - 1 AS INT) "
    "LEFT JOIN v_cells c ON c.cell = p.cell"))
def q_annotate_result(spark, sf):
    """Result table (cell, predicted type name, batch name) written as parquet and read back."""
    p = T.pred(spark, sf).select("cell", argmax("logits").alias("pred"))
    p = vocab.decode_labels(p, T.label_vocab(spark, sf), "pred", "pred_name")
    bv = batch_vocab(spark, sf)
    c = vocab.encode_labels(T.cells(spark, sf).select("cell", "batch"), bv, "batch", "batch_id")
    res = p.join(c.select("cell", "batch_id"), "cell", "left")
    res = vocab.decode_labels(res, bv, "batch_id", "batch")
    path = scratch_path(spark, "result")
    res.select("cell", "pred_name", "batch").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
