"""Vocabulary queries: build, bounds, encode, decode, data-quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellframe.config import MODEL_N_BATCHES, MODEL_N_TYPES, MODEL_NTOKEN
from cellframe.operators import vocab
from cellframe.plans.oracle_views import with_views
from cellframe.plans.registry import query
from cellframe.sources import tables as T

BATCH_VOCAB_SQL = (
    "SELECT batch AS name, CAST(ROW_NUMBER() OVER (ORDER BY MIN(gpos)) - 1 AS INT) AS id "
    "FROM (SELECT batch, ROW_NUMBER() OVER (ORDER BY sample, row_pos) AS gpos FROM v_cells) t GROUP BY batch")


def batch_vocab(spark, sf):
    return vocab.vocab_build(T.cells(spark, sf), "batch", ["sample", "row_pos"])


def gene_vocab(spark, sf):
    return T.gene_vocab(spark, sf).select(F.col("gene").alias("name"), "id")


# ---------------------------------------------------------------- A-02 ----
@query("vocab_build", with_views(BATCH_VOCAB_SQL))
def q_vocab_build(spark, sf):
    return batch_vocab(spark, sf)


# ---------------------------------------------------------------- A-03 ----
@query("vocab_bounds", with_views(
    "SELECT MIN(id) AS min_id, MAX(id) AS max_id, COUNT(*) AS n_entries FROM v_gene_vocab"))
def q_vocab_bounds(spark, sf):
    return vocab.vocab_bounds(T.gene_vocab(spark, sf))


# ---------------------------------------------------------------- J-05 ----
@query("label_encode", with_views(
    "SELECT c.cell, b.id AS batch_id, l.id AS label_id FROM v_cells c "
    "LEFT JOIN bv b ON b.name = c.batch LEFT JOIN v_label_vocab l ON l.name = c.celltype",
    {"bv": BATCH_VOCAB_SQL}))
def q_label_encode(spark, sf):
    c = T.cells(spark, sf)
    c = vocab.encode_labels(c, batch_vocab(spark, sf), "batch", "batch_id")
    c = vocab.encode_labels(c, T.label_vocab(spark, sf), "celltype", "label_id")
    return c.select("cell", "batch_id", "label_id")


# ---------------------------------------------------------------- J-06 ----
ARGMAX_SQL = "CAST(list_position(logits, list_max(logits)) - 1 AS INT)"


@query("label_decode", with_views(
    f"SELECT p.cell, {ARGMAX_SQL} AS pred, l.name AS pred_name FROM v_pred p "
    f"LEFT JOIN v_label_vocab l ON l.id = {ARGMAX_SQL}"))
def q_label_decode(spark, sf):
    from cellframe.functions.columns import argmax
    p = T.pred(spark, sf).select("cell", argmax("logits").alias("pred"))
    return vocab.decode_labels(p, T.label_vocab(spark, sf), "pred", "pred_name")


# ---------------------------------------------------------------- J-07 ----
# Per-species vocabularies: the types first seen in each of two samples get
# their own numbering (like the per-species heads); others use the generic one.
SPECIES = ("AMERICA", "ASIA")
SPECIES_VOCABS_SQL = (
    "SELECT sample AS species, celltype AS name, "
    "CAST(ROW_NUMBER() OVER (PARTITION BY sample ORDER BY MIN(row_pos)) - 1 AS INT) AS id "
    f"FROM v_cells WHERE sample IN ('{SPECIES[0]}', '{SPECIES[1]}') GROUP BY sample, celltype "
    "UNION ALL SELECT 'generic' AS species, name, id FROM v_label_vocab")


def species_vocabs(spark, sf):
    from pyspark.sql import Window
    c = T.cells(spark, sf).filter(F.col("sample").isin(*SPECIES))
    first = c.groupBy("sample", "celltype").agg(F.min("row_pos").alias("f"))
    own = first.select(F.col("sample").alias("species"), F.col("celltype").alias("name"),
                       (F.row_number().over(Window.partitionBy("sample").orderBy("f")) - 1)
                       .cast("int").alias("id"))
    gen = T.label_vocab(spark, sf).select(F.lit("generic").alias("species"), "name", "id")
    return own.unionByName(gen)


@query("species_decode", with_views(
    f"SELECT p.cell, c.sample AS species, {ARGMAX_SQL} AS pred, "
    "CASE WHEN c.sample IN (SELECT species FROM sv) THEN o.name ELSE g.name END AS pred_name "
    "FROM v_pred p LEFT JOIN v_cells c ON c.cell = p.cell "
    f"LEFT JOIN sv o ON o.species = c.sample AND o.id = {ARGMAX_SQL} "
    f"LEFT JOIN sv g ON g.species = 'generic' AND g.id = {ARGMAX_SQL}",
    {"sv": SPECIES_VOCABS_SQL}))
def q_species_decode(spark, sf):
    from cellframe.functions.columns import argmax
    p = T.pred(spark, sf).select("cell", argmax("logits").alias("pred"))
    p = p.join(T.cells(spark, sf).select("cell", F.col("sample").alias("species")), "cell", "left")
    out = vocab.decode_by_species(p, species_vocabs(spark, sf), "species", "pred", "pred_name")
    return out.select("cell", "species", "pred", "pred_name")


# ---------------------------------------------------------------- J-13 ----
@query("cell_index", with_views(
    "SELECT batch AS cell_name, MAX(row_pos) AS idx FROM v_cells GROUP BY batch"))
def q_cell_index(spark, sf):
    """Name -> row position where names repeat: the last position wins."""
    c = T.cells(spark, sf)
    return c.groupBy(F.col("batch").alias("cell_name")).agg(F.max("row_pos").alias("idx"))


# ---------------------------------------------------------------- W-12 ----
@query("row_positions", with_views(
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, "
    "ROW_NUMBER() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS pos FROM lineitem"))
def q_row_positions(spark, sf):
    """The position of every line item in key order, from 0."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return vocab.row_positions(T.table(spark, sf, "lineitem", *keys), keys)


@query("file_positions", with_views(
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(ROW_NUMBER() OVER () - 1 AS BIGINT) AS pos FROM lineitem"))
def q_file_positions(spark, sf):
    """The place of every line item in its files, without a sort."""
    from cellframe.sources.files import file_positions
    rows = T.table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return file_positions(rows)


@query("cell_name_back", with_views(
    "SELECT p.cell AS idx, ix.cell FROM v_pred p LEFT JOIN "
    "(SELECT cell, ROW_NUMBER() OVER (ORDER BY sample, row_pos) - 1 AS idx FROM v_cells) ix ON ix.idx = p.cell"))
def q_cell_name_back(spark, sf):
    """Row positions back to cell names (a position beyond the table has none)."""
    index = vocab.row_positions(T.cells(spark, sf).select("sample", "row_pos", "cell"), ["sample", "row_pos"], "idx")
    return vocab.names_at(T.pred(spark, sf).select(F.col("cell").alias("idx")), index, "idx", "cell")


# ---------------------------------------------------------------- DQ-01 ---
@query("dup_cells", with_views(
    "SELECT cell, COUNT(*) AS n FROM (SELECT DISTINCT sample, cell FROM v_expr_zero) t "
    "GROUP BY cell HAVING COUNT(*) > 1"))
def q_dup_cells(spark, sf):
    """Cell keys that occur in more than one label row (one per sample file)."""
    rows = T.expr_zero(spark, sf).select("sample", "cell").distinct()
    return rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


# ---------------------------------------------------------------- DQ-03 ---
@query("unknown_genes", with_views(
    "SELECT e.sample, COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE g.gene IS NULL) AS n_unknown, "
    "COUNT(DISTINCT CASE WHEN g.gene IS NULL THEN e.gene END) AS n_unknown_genes "
    "FROM v_expr e LEFT JOIN v_gene_vocab g ON e.gene = g.gene GROUP BY e.sample"))
def q_unknown_genes(spark, sf):
    # one row per (sample, gene) before the join: a gene that every cell has is no hot key
    e = T.expr(spark, sf).groupBy("sample", "gene").agg(F.count(F.lit(1)).alias("n"))
    gv = gene_vocab(spark, sf).select(F.col("name").alias("gene"), F.lit(True).alias("_known"))
    j = e.join(gv, "gene", "left")
    unk = F.col("_known").isNull()
    return j.groupBy("sample").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(unk, F.col("n"))), F.lit(0)).alias("n_unknown"),
        F.count_if(unk).alias("n_unknown_genes"))


# ---------------------------------------------------------------- DQ-04 ---
@query("id_range", with_views(
    f"SELECT 'batch' AS field, COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE b.id < 0 OR b.id >= {MODEL_N_BATCHES}) AS n_bad "
    "FROM v_cells c LEFT JOIN bv b ON b.name = c.batch "
    f"UNION ALL SELECT 'label', COUNT(*), COUNT(*) FILTER (WHERE l.id < 0 OR l.id >= {MODEL_N_TYPES}) "
    "FROM v_cells c LEFT JOIN v_label_vocab l ON l.name = c.celltype "
    f"UNION ALL SELECT 'gene', COUNT(*), COUNT(*) FILTER (WHERE id < 0 OR id >= {MODEL_NTOKEN}) FROM v_gene_vocab",
    {"bv": BATCH_VOCAB_SQL}))
def q_id_range(spark, sf):
    """Ids outside the model's vocabulary sizes, one report row per field."""
    c = T.cells(spark, sf)
    c = vocab.encode_labels(c, batch_vocab(spark, sf), "batch", "batch_id")
    c = vocab.encode_labels(c, T.label_vocab(spark, sf), "celltype", "label_id")

    def report(df, field, col, bound):
        v = F.col(col)
        return df.agg(F.lit(field).alias("field"), F.count(F.lit(1)).alias("n_rows"),
                      F.count_if((v < 0) | (v >= bound)).alias("n_bad"))
    return (report(c, "batch", "batch_id", MODEL_N_BATCHES)
            .unionByName(report(c, "label", "label_id", MODEL_N_TYPES))
            .unionByName(report(T.gene_vocab(spark, sf), "gene", "id", MODEL_NTOKEN)))


# ---------------------------------------------------------------- A-04 ----
@query("class_counts", with_views("SELECT celltype, COUNT(*) AS n FROM v_cells GROUP BY celltype"))
def q_class_counts(spark, sf):
    return T.cells(spark, sf).groupBy("celltype").agg(F.count(F.lit(1)).alias("n"))
