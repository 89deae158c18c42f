"""Build-path queries: range, binning, filters, sampling, sequence assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellframe.config import CELLTYPE_DENYLIST, Params
from cellframe.functions.columns import bin_value_sql, hash_order_sql
from cellframe.operators import binning, tokens, vocab
from cellframe.plans.oracle_views import with_views
from cellframe.plans.registry import query
from cellframe.sources import tables as T

P = Params()
L = P.seq_length
K = P.sample_size
DENY_SQL = ", ".join("'" + x.replace("'", "''") + "'" for x in CELLTYPE_DENYLIST)

RANGE_SQL = ("rng AS (SELECT sample, MIN(CASE WHEN value > 0 THEN value END) AS min_pos, "
             "MAX(value) AS max_val FROM v_expr GROUP BY sample)")
BINNED_SQL = ("binned AS (SELECT e.sample, e.cell, e.gene, e.value, "
              f"{bin_value_sql('e.value', 'r.min_pos', 'r.max_val')} AS bin "
              "FROM v_expr e JOIN rng r ON e.sample = r.sample)")


def _ctes(*items: str) -> dict[str, str]:
    out = {}
    for it in items:
        name, body = it.split(" AS (", 1)
        out[name.strip()] = body.rsplit(")", 1)[0]
    return out


# ---------------------------------------------------------------- A-01 ----
@query("sample_range", with_views(
    "SELECT sample, MIN(CASE WHEN value > 0 THEN value END) AS min_pos, MAX(value) AS max_val "
    "FROM v_expr GROUP BY sample"))
def q_sample_range(spark, sf):
    return binning.sample_range(T.expr(spark, sf))


# ---------------------------------------------------------------- S-01 ----
@query("bin_expression", with_views(
    "SELECT sample, cell, gene, value, bin FROM binned", _ctes(RANGE_SQL, BINNED_SQL)))
def q_bin_expression(spark, sf):
    return binning.bin_expression(T.expr(spark, sf)).select("sample", "cell", "gene", "value", "bin")


# ---------------------------------------------------------------- PF-01 ---
@query("celltype_denylist", with_views(
    f"SELECT sample, cell, batch, celltype FROM v_cells WHERE celltype IS NULL OR celltype NOT IN ({DENY_SQL})"))
def q_celltype_denylist(spark, sf):
    return tokens.drop_denied_types(T.cells(spark, sf), CELLTYPE_DENYLIST).select(
        "sample", "cell", "batch", "celltype")


# ---------------------------------------------------------------- PF-02 ---
@query("nonzero_genes", with_views(
    "SELECT sample, cell, gene, value FROM v_expr_zero "
    "WHERE value IS NOT NULL AND NOT isnan(value) AND value <> 0"))
def q_nonzero_genes(spark, sf):
    return tokens.expressed(T.expr_zero(spark, sf), "value")


# ---------------------------------------------------------- J-02 / J-03 ---
@query("labelled_cells", with_views(
    "SELECT e.cell, e.gene, e.value, c.celltype FROM v_expr e JOIN v_cells c ON e.cell = c.cell "
    f"WHERE c.celltype IS NULL OR c.celltype NOT IN ({DENY_SQL})"))
def q_labelled_cells(spark, sf):
    cells = tokens.drop_denied_types(T.cells(spark, sf), CELLTYPE_DENYLIST)
    return tokens.labelled(T.expr(spark, sf).select("cell", "gene", "value"), cells)


# ---------------------------------------------------------------- J-01 ----
@query("batch_lookup", with_views(
    "SELECT e.cell, e.gene, c.batch FROM v_expr e LEFT JOIN v_cells c ON e.cell = c.cell"))
def q_batch_lookup(spark, sf):
    return tokens.strict_lookup(T.expr(spark, sf).select("cell", "gene"), T.cells(spark, sf),
                                "cell", "batch")


# ---------------------------------------------------------------- J-04 ----
@query("gene_encode", with_views(
    "SELECT e.cell, e.gene, CAST(COALESCE(g.id, 0) AS INT) AS gene_id "
    "FROM v_expr e LEFT JOIN v_gene_vocab g ON e.gene = g.gene"))
def q_gene_encode(spark, sf):
    gv = T.gene_vocab(spark, sf).select(F.col("gene").alias("name"), "id")
    return vocab.encode_genes(T.expr(spark, sf).select("cell", "gene"), gv, tasks=T.expr_tasks(spark, sf))


# ---------------------------------------------------------------- W-03 ----
SAMPLED_SQL = {
    "expressed": "SELECT b.cell, b.gene, CAST(b.bin AS DOUBLE) AS val, CAST(COALESCE(g.id, 0) AS INT) AS gene_id "
                 "FROM binned b LEFT JOIN v_gene_vocab g ON b.gene = g.gene WHERE b.bin <> 0",
    "counted": "SELECT *, COUNT(*) OVER (PARTITION BY cell) AS n_expressed FROM expressed",
    "ranked": "SELECT *, ROW_NUMBER() OVER (PARTITION BY cell ORDER BY "
              f"CASE WHEN n_expressed > {L} THEN {hash_order_sql('cell', 'gene', seed=P.seed)} END "
              "ASC NULLS FIRST, gene ASC) AS pos FROM counted",
    "chosen": f"SELECT * FROM ranked WHERE pos <= CASE WHEN n_expressed > {L} THEN {K} ELSE {L} END",
}


@query("gene_sample", with_views(
    "SELECT cell, gene, gene_id, val, CAST(n_expressed AS BIGINT) AS n_expressed, CAST(pos AS BIGINT) AS pos "
    "FROM chosen", {**_ctes(RANGE_SQL, BINNED_SQL), **SAMPLED_SQL}))
def q_gene_sample(spark, sf):
    e = _encoded_expressed(spark, sf)
    out = tokens.sample_genes(e, L, K, P.seed)
    return out.select("cell", "gene", "gene_id", "val", F.col("n_expressed").cast("long").alias("n_expressed"),
                      F.col("pos").cast("long").alias("pos"))


def _encoded_expressed(spark, sf, cells=None):
    b = binning.bin_expression(T.expr(spark, sf))
    e = tokens.expressed(b, "bin")
    if cells is not None:
        e = e.join(cells.select("cell"), "cell", "left_semi")
    gv = T.gene_vocab(spark, sf).select(F.col("gene").alias("name"), "id")
    return vocab.encode_genes(e, gv, tasks=T.expr_tasks(spark, sf)).withColumn("val", F.col("bin").cast("double"))


# ---------------------------------------------------------- A-05 / S-11 ---
SEQ_SQL = {
    "nsel": "SELECT cell, COUNT(*) AS n_genes FROM chosen GROUP BY cell",
    "pos_grid": f"SELECT CAST(range AS BIGINT) AS pos FROM range(1, {L + 1})",
}


def _seq_body(cells_from: str, extra_cols: str = "") -> str:
    return (f"SELECT k.cell{extra_cols}, CAST(COALESCE(ns.n_genes, 0) AS BIGINT) AS n_genes, p.pos, "
            "CAST(COALESCE(c.gene_id, 0) AS INT) AS gene_id, COALESCE(c.val, -2.0) AS val "
            f"FROM {cells_from} k CROSS JOIN pos_grid p "
            "LEFT JOIN nsel ns ON ns.cell = k.cell "
            "LEFT JOIN chosen c ON c.cell = k.cell AND c.pos = p.pos")


@query("sequence_assemble", with_views(
    _seq_body("(SELECT DISTINCT cell FROM chosen)"),
    {**_ctes(RANGE_SQL, BINNED_SQL), **SAMPLED_SQL, **SEQ_SQL}))
def q_sequence_assemble(spark, sf):
    chosen = tokens.sample_genes(_encoded_expressed(spark, sf), L, K, P.seed)
    seqs = tokens.assemble(chosen, L, P.pad_id, P.pad_value)
    return tokens.explode_sequences(seqs, ["cell", "n_genes"])


# ------------------------------------------------------- flagship (7.1) ---
ANNOTATE_SQL = {
    "kept": f"SELECT * FROM v_cells WHERE celltype IS NULL OR celltype NOT IN ({DENY_SQL})",
    "batch_vocab": "SELECT batch AS name, CAST(ROW_NUMBER() OVER (ORDER BY MIN(gpos)) - 1 AS INT) AS id "
                   "FROM (SELECT batch, ROW_NUMBER() OVER (ORDER BY sample, row_pos) AS gpos FROM v_cells) t "
                   "GROUP BY batch",
    "expressed": "SELECT b.cell, b.gene, CAST(b.bin AS DOUBLE) AS val, CAST(COALESCE(g.id, 0) AS INT) AS gene_id "
                 "FROM binned b LEFT JOIN v_gene_vocab g ON b.gene = g.gene "
                 "WHERE b.bin <> 0 AND b.cell IN (SELECT cell FROM kept)",
}


@query("annotate_tokens", with_views(
    "SELECT k.sample, k.cell, bv.id AS batch_id, lv.id AS label_id, "
    "CAST(COALESCE(ns.n_genes, 0) AS BIGINT) AS n_genes, p.pos, "
    "CAST(COALESCE(c.gene_id, 0) AS INT) AS gene_id, COALESCE(c.val, -2.0) AS val "
    "FROM kept k CROSS JOIN pos_grid p "
    "LEFT JOIN batch_vocab bv ON bv.name = k.batch LEFT JOIN v_label_vocab lv ON lv.name = k.celltype "
    "LEFT JOIN nsel ns ON ns.cell = k.cell LEFT JOIN chosen c ON c.cell = k.cell AND c.pos = p.pos",
    {**_ctes(RANGE_SQL, BINNED_SQL), **ANNOTATE_SQL,
     **{k: v for k, v in SAMPLED_SQL.items() if k != "expressed"}, **SEQ_SQL}))
def q_annotate_tokens(spark, sf):
    return tokens.explode_sequences(annotate_tokens(spark, sf),
                                    ["sample", "cell", "batch_id", "label_id", "n_genes"])


def annotate_tokens(spark, sf, p: Params = P):
    """Flagship: expression -> range -> bins -> filters -> ids -> sampling -> padded rows."""
    cells = tokens.drop_denied_types(T.cells(spark, sf), p.denylist)
    bvocab = vocab.vocab_build(T.cells(spark, sf), "batch", ["sample", "row_pos"])
    cells = vocab.encode_labels(cells, bvocab, "batch", "batch_id")
    cells = vocab.encode_labels(cells, T.label_vocab(spark, sf), "celltype", "label_id")
    binned = binning.bin_expression(T.expr(spark, sf))
    gv = T.gene_vocab(spark, sf).select(F.col("gene").alias("name"), "id")
    seqs = tokens.build_tokens(binned, cells.select("sample", "cell", "batch_id", "label_id"), gv, p,
                               tasks=T.expr_tasks(spark, sf))
    return seqs.select("sample", "cell", "batch_id", "label_id", "n_genes", "gene_ids", "vals")
