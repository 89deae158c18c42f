"""Split, chunk, mask and sequence-recode queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellframe.config import CELLTYPE_DENYLIST, CLS_ID_DEFAULT, MASK_RATIO, MASK_VALUE, N_BINS, Params
from cellframe.functions.columns import hash_order_sql
from cellframe.operators import splits, tokens
from cellframe.plans.oracle_views import with_views
from cellframe.plans.q_build import (DENY_SQL, RANGE_SQL, SAMPLED_SQL, SEQ_SQL, _ctes,
                                     _encoded_expressed, _seq_body)
from cellframe.plans.registry import query
from cellframe.session import scratch_path
from cellframe.sources import tables as T

P = Params()
L = P.seq_length
TEST = P.test_size
CHUNK_ROWS = 100  # small chunk size so the test tables span several chunks
KEY_SQL = hash_order_sql("cell", seed=P.seed)
NULL_TYPE = "FURNITURE"  # cells of this type are taken as cells without a type, a class of their own
KEPT_SQL = (f"SELECT * REPLACE (NULLIF(celltype, '{NULL_TYPE}') AS celltype) FROM v_cells "
            f"WHERE celltype IS NULL OR celltype NOT IN ({DENY_SQL})")


def kept_cells(spark, sf):
    return tokens.drop_denied_types(T.cells(spark, sf), CELLTYPE_DENYLIST).select(
        "cell", F.nullif("celltype", F.lit(NULL_TYPE)).alias("celltype"))


# ---------------------------------------------------------------- W-05 ----
SPLIT_RANDOM_SQL = {
    "kept": KEPT_SQL,
    "sz": f"SELECT n, n - CEIL(n * CAST({TEST!r} AS DOUBLE)) AS n_train, "
          f"CEIL(CEIL(n * CAST({TEST!r} AS DOUBLE)) / 2) AS n_valid FROM (SELECT COUNT(*) AS n FROM kept) t",
    "rk": f"SELECT cell, celltype, ROW_NUMBER() OVER (ORDER BY {KEY_SQL}) AS r FROM kept",
}


@query("split_random", with_views(
    "SELECT cell, celltype, CASE WHEN r <= n_train THEN 'train' WHEN r <= n_train + n_valid THEN 'valid' "
    "ELSE 'test' END AS split FROM rk, sz", SPLIT_RANDOM_SQL))
def q_split_random(spark, sf):
    return splits.split_random(kept_cells(spark, sf), "cell", P.seed, TEST)


# ---------------------------------------------------------- W-06 / W-07 ---
def _lr(prefix: str, src: str, count_col: str, total_col: str, draws: str, out: str) -> dict[str, str]:
    return {
        f"{prefix}a": f"SELECT *, {count_col} * ({draws}) / {total_col} AS cont FROM {src}",
        f"{prefix}b": f"SELECT *, FLOOR(cont) AS fl, cont - FLOOR(cont) AS rem, "
                      f"({draws}) - SUM(FLOOR(cont)) OVER () AS need FROM {prefix}a",
        f"{prefix}c": f"SELECT *, ROW_NUMBER() OVER (ORDER BY rem DESC, label ASC NULLS FIRST) AS rr FROM {prefix}b",
        f"{prefix}d": f"SELECT * EXCLUDE (cont, fl, rem, need, rr), "
                      f"CAST(fl + CASE WHEN rr <= need THEN 1 ELSE 0 END AS BIGINT) AS {out} FROM {prefix}c",
    }


STRAT_SQL = {
    "kept": KEPT_SQL,
    "cls": "SELECT celltype AS label, COUNT(*) AS n, SUM(COUNT(*)) OVER () AS n_all FROM kept GROUP BY celltype",
    **_lr("s1", "cls", "n", "n_all", f"n_all - CEIL(n_all * CAST({TEST!r} AS DOUBLE))", "n_train0"),
    "rep": "SELECT label, n, CASE WHEN n - n_train0 = 1 AND n_train0 > 0 THEN n_train0 - 1 ELSE n_train0 END "
           "AS n_train FROM s1d",
    "s2": "SELECT *, n - n_train AS remain, SUM(n - n_train) OVER () AS r_all FROM rep",
    **_lr("s2", "s2", "remain", "r_all", "r_all - CEIL(r_all * 0.5)", "n_test"),
    "quota": "SELECT label, n, n_train, n_test, remain - n_test AS n_valid FROM s2d",
    "rk": f"SELECT cell, celltype, ROW_NUMBER() OVER (PARTITION BY celltype ORDER BY {KEY_SQL}) AS r FROM kept",
}


@query("split_stratified", with_views(
    "SELECT cell, celltype, CASE WHEN r <= n_train THEN 'train' WHEN r <= n_train + n_test THEN 'test' "
    "ELSE 'valid' END AS split FROM rk JOIN quota ON quota.label IS NOT DISTINCT FROM rk.celltype", STRAT_SQL))
def q_split_stratified(spark, sf):
    return splits.split_stratified(kept_cells(spark, sf), "cell", "celltype", P.seed, TEST)


@query("split_quotas", with_views("SELECT label, n, n_train, n_test, n_valid FROM quota", STRAT_SQL))
def q_split_quotas(spark, sf):
    return splits.stratified_quotas(kept_cells(spark, sf), "celltype", TEST)


# ---------------------------------------------------------------- W-08 ----
@query("split_none", with_views("SELECT cell, celltype, 'test' AS split FROM kept", {"kept": KEPT_SQL}))
def q_split_none(spark, sf):
    return splits.split_none(kept_cells(spark, sf))


# ---------------------------------------------------------------- IO-10 ---
CHUNK_SQL = {
    **STRAT_SQL,
    "assigned": "SELECT cell, celltype, CASE WHEN r <= n_train THEN 'train' WHEN r <= n_train + n_test "
                "THEN 'test' ELSE 'valid' END AS split FROM rk JOIN quota ON quota.label IS NOT DISTINCT FROM rk.celltype",
    "chunked": f"SELECT cell, celltype, split, ROW_NUMBER() OVER (PARTITION BY split ORDER BY {KEY_SQL}) "
               "AS row_in_split FROM assigned",
}
CHUNK_BODY = (f"SELECT cell, celltype, split, row_in_split, CAST(FLOOR((row_in_split - 1) / {CHUNK_ROWS}) + 1 AS INT) "
              "AS chunk FROM chunked")


def chunked(spark, sf):
    s = splits.split_stratified(kept_cells(spark, sf), "cell", "celltype", P.seed, TEST)
    return splits.chunk_plan(s, "cell", P.seed, CHUNK_ROWS)


@query("chunk_plan", with_views(CHUNK_BODY, CHUNK_SQL))
def q_chunk_plan(spark, sf):
    return chunked(spark, sf).select("cell", "celltype", "split", "row_in_split", "chunk")


# ---------------------------------------------------------------- IO-07 ---
@query("chunk_range", with_views(
    f"SELECT cell, celltype, split, chunk FROM ({CHUNK_BODY}) t WHERE split = 'train' AND chunk >= 2",
    CHUNK_SQL))
def q_chunk_range(spark, sf):
    """Write the chunked split as parquet, then read train chunks 2..last (pruned by partition).

    The last chunk follows from the train row count (ceil(n_train / chunk_rows)),
    so the requested range exists at every scale.
    """
    path = scratch_path(spark, "chunks")
    plan = chunked(spark, sf).select("cell", "celltype", "split", "chunk")
    splits.write_chunks(plan, path)
    n_train = spark.read.parquet(path).filter(F.col("split") == "train").count()
    last = max(2, -(-n_train // CHUNK_ROWS))
    return splits.read_chunks(spark, path, "train", 2, end_chunk=last).select("cell", "celltype", "split", "chunk")


# ---------------------------------------------------------- sequences -----
def _seq_ctes() -> dict[str, str]:
    from cellframe.plans.q_build import BINNED_SQL
    d = {**_ctes(RANGE_SQL, BINNED_SQL), **SAMPLED_SQL, **SEQ_SQL}
    d["seq"] = _seq_body("(SELECT DISTINCT cell FROM chosen)")
    return d


def sequences(spark, sf):
    chosen = tokens.sample_genes(_encoded_expressed(spark, sf), L, P.sample_size, P.seed)
    return tokens.assemble(chosen, L, P.pad_id, P.pad_value)


# ---------------------------------------------------------------- W-04 ----
MASK_SQL = {
    **_seq_ctes(),
    "mk": "SELECT *, COUNT(*) FILTER (WHERE val <> -2.0) OVER (PARTITION BY cell) AS n_real, "
          "CASE WHEN val <> -2.0 THEN ROW_NUMBER() OVER (PARTITION BY cell, val <> -2.0 ORDER BY "
          f"{hash_order_sql('cell', 'pos', seed=P.seed)}) END AS mr FROM seq",
    "masked": f"SELECT cell, pos, gene_id, val, COALESCE(mr <= FLOOR(n_real * CAST({MASK_RATIO!r} AS DOUBLE)), false) "
              "AS is_masked FROM mk",
}


@query("random_mask", with_views(
    f"SELECT cell, pos, val, CASE WHEN is_masked THEN {MASK_VALUE!r} ELSE val END AS masked_val, is_masked "
    "FROM masked", MASK_SQL))
def q_random_mask(spark, sf):
    m = splits.random_mask(sequences(spark, sf), "cell", P.seed, MASK_RATIO, MASK_VALUE, P.pad_value)
    z = F.arrays_zip(F.col("vals").alias("val"), F.col("masked_vals").alias("masked_val"),
                     F.col("mask").alias("is_masked"))
    return (m.select("cell", F.posexplode(z).alias("p", "z"))
            .select("cell", (F.col("p") + 1).cast("long").alias("pos"), "z.val", "z.masked_val", "z.is_masked"))


# ---------------------------------------------------------------- S-02 ----
@query("prepend_cls", with_views(
    "SELECT cell, pos + 1 AS pos, gene_id, val FROM seq UNION ALL "
    f"SELECT DISTINCT cell, CAST(1 AS BIGINT), {CLS_ID_DEFAULT}, 0.0 FROM seq", _seq_ctes()))
def q_prepend_cls(spark, sf):
    return tokens.explode_sequences(tokens.prepend_cls(sequences(spark, sf)), ["cell"])


# ---------------------------------------------------------------- PF-04 ---
@query("pad_recode", with_views(
    f"SELECT cell, pos, gene_id, CASE WHEN val = -2.0 THEN {float(N_BINS)} ELSE val END AS val FROM seq",
    _seq_ctes()))
def q_pad_recode(spark, sf):
    return tokens.explode_sequences(tokens.pad_recode(sequences(spark, sf)), ["cell"])


# ---------------------------------------------------------------- PF-05 ---
@query("pad_mask", with_views("SELECT cell, pos, gene_id = 0 AS is_pad FROM seq", _seq_ctes()))
def q_pad_mask(spark, sf):
    m = tokens.pad_mask(sequences(spark, sf))
    return (m.select("cell", F.posexplode("pad_mask").alias("p", "is_pad"))
            .select("cell", (F.col("p") + 1).cast("long").alias("pos"), "is_pad"))


# ---------------------------------------------------------------- DQ-02 ---
@query("pad_middle", with_views(
    "SELECT COUNT(*) AS n_cells, COUNT(*) FILTER (WHERE min_pad < max_real) AS n_pad_middle FROM "
    "(SELECT cell, MIN(CASE WHEN gene_id = 0 THEN pos END) AS min_pad, "
    "MAX(CASE WHEN gene_id <> 0 THEN pos END) AS max_real FROM seq GROUP BY cell) t", _seq_ctes()))
def q_pad_middle(spark, sf):
    return tokens.pad_in_middle(sequences(spark, sf)).agg(
        F.count(F.lit(1)).alias("n_cells"), F.count_if("pad_middle").alias("n_pad_middle"))


# ---------------------------------------------------------------- PF-03 ---
# line numbers are the genes here (7 at any scale, so every gene of a sample has its place)
DENSE_SQL = {
    "lines": "SELECT l_returnflag AS sample, l_orderkey AS cell, CAST(l_linenumber AS BIGINT) AS gene, "
             "MAX(ROUND(l_discount * 100)) AS value FROM lineitem GROUP BY 1, 2, 3",
    "placed": "SELECT sample, gene, ROW_NUMBER() OVER (PARTITION BY sample ORDER BY gene) AS pos "
              "FROM (SELECT DISTINCT sample, gene FROM lines) t",
    "ng": "SELECT sample, COUNT(*) AS n_genes FROM placed GROUP BY sample",
    "sc": "SELECT DISTINCT sample, cell FROM lines",
    "pos_grid": f"SELECT CAST(range AS BIGINT) AS pos FROM range(1, {L + 1})",
}


@query("dense_genes", with_views(
    "SELECT c.sample, c.cell, CAST(ng.n_genes AS BIGINT) AS n_genes, p.pos, "
    "CAST(CASE WHEN pl.gene IS NULL THEN 0 ELSE COALESCE(g.id, 0) END AS INT) AS gene_id, "
    "CAST(CASE WHEN pl.gene IS NULL THEN -2.0 ELSE COALESCE(e.value, 0.0) END AS DOUBLE) AS val "
    "FROM sc c CROSS JOIN pos_grid p JOIN ng ON ng.sample = c.sample "
    "LEFT JOIN placed pl ON pl.sample = c.sample AND pl.pos = p.pos "
    "LEFT JOIN lines e ON e.sample = c.sample AND e.cell = c.cell AND e.gene = pl.gene "
    "LEFT JOIN v_gene_vocab g ON g.gene = pl.gene", DENSE_SQL))
def q_dense_genes(spark, sf):
    gv = T.gene_vocab(spark, sf).select(F.col("gene").alias("name"), "id")
    li = T.table(spark, sf, "lineitem", "l_returnflag", "l_orderkey", "l_linenumber", "l_discount")
    lines = (li.groupBy(F.col("l_returnflag").alias("sample"), F.col("l_orderkey").alias("cell"),
                        F.col("l_linenumber").cast("long").alias("gene"))
             .agg(F.max(F.round(F.col("l_discount") * 100)).alias("value")))
    d = tokens.dense_genes(lines, L, gv, P.pad_id, P.pad_value)
    return tokens.explode_sequences(d, ["sample", "cell", "n_genes"])


# ---------------------------------------------------------------- W-02 ----
HVG_K = 20
HVG_SQL = {
    "ncell": "SELECT sample, COUNT(*) AS n FROM v_cells GROUP BY sample",
    "gs": "SELECT e.sample, e.gene, SUM(e.value) AS s, SUM(e.value * e.value) AS ss, MAX(nc.n) AS n "
          "FROM v_expr e JOIN ncell nc ON nc.sample = e.sample GROUP BY e.sample, e.gene",
    "hv": "SELECT sample, gene, n * ss - s * s AS score, ROUND((n * ss - s * s) / (n * (n - 1.0)), 6) AS var, "
          "ROW_NUMBER() OVER (PARTITION BY sample ORDER BY n * ss - s * s DESC, gene ASC) AS rank FROM gs",
}


@query("hvg_topk", with_views(
    f"SELECT sample, gene, CAST(rank AS INT) AS rank, var FROM hv WHERE rank <= {HVG_K}", HVG_SQL))
def q_hvg_topk(spark, sf):
    from cellframe.operators.genes import top_variable_genes
    n_cells = T.cells(spark, sf).groupBy("sample").agg(F.count(F.lit(1)).alias("n_cells"))
    return top_variable_genes(T.expr(spark, sf), n_cells, HVG_K).select("sample", "gene", "rank", "var")


@query("hvg_ranked", with_views(
    f"SELECT sample, gene, rank FROM (SELECT sample, gene, ROW_NUMBER() OVER (PARTITION BY sample "
    f"ORDER BY COUNT(*) DESC, gene) AS rank FROM v_expr GROUP BY sample, gene) t WHERE rank <= {HVG_K}"))
def q_hvg_ranked(spark, sf):
    """The head of a ready ranked list (here: genes by the number of cells that express them)."""
    from cellframe.functions.ranking import grouped_row_number
    from cellframe.operators.genes import ready_ranked_genes
    n = T.expr(spark, sf).groupBy("sample", "gene").agg(F.count(F.lit(1)).alias("n"))
    ranked = grouped_row_number(n, ["sample"], [F.desc("n"), "gene"], "rank").select("sample", "gene", "rank")
    return ready_ranked_genes(ranked, HVG_K)


# ---------------------------------------------------------- build (IO-10) --
def _build_sql() -> str:
    import re

    from cellframe.plans.q_build import ANNOTATE_SQL, BINNED_SQL

    def own(sql):  # the split's cells have types taken away, the tokens' cells have not
        return re.sub(r"\bkept\b", "kept_all", sql)

    ctes = {**_ctes(RANGE_SQL, BINNED_SQL), **{own(k): own(v) for k, v in ANNOTATE_SQL.items()},
            **{k: v for k, v in SAMPLED_SQL.items() if k != "expressed"}, **SEQ_SQL, **CHUNK_SQL}
    return with_views(
        "SELECT k.cell, bv.id AS batch_id, lv.id AS label_id, p.pos, ch.split, ch.chunk, "
        "CAST(COALESCE(c.gene_id, 0) AS INT) AS gene_id, COALESCE(c.val, -2.0) AS val "
        f"FROM kept_all k CROSS JOIN pos_grid p JOIN ({CHUNK_BODY}) ch ON ch.cell = k.cell "
        "LEFT JOIN batch_vocab bv ON bv.name = k.batch LEFT JOIN v_label_vocab lv ON lv.name = k.celltype "
        "LEFT JOIN chosen c ON c.cell = k.cell AND c.pos = p.pos", ctes)


@query("build_dataset", _build_sql())
def q_build_dataset(spark, sf):
    """The whole build: token rows -> split -> chunks written with all fields, read back split by split."""
    from cellframe.plans.q_build import annotate_tokens
    path = scratch_path(spark, "dataset")
    plan = chunked(spark, sf).select("cell", "split", "chunk")
    splits.write_chunks(annotate_tokens(spark, sf).join(plan, "cell"), path, tasks=T.expr_tasks(spark, sf))
    parts = []
    for split in ("train", "valid", "test"):
        last = spark.read.parquet(path).where(F.col("split") == split).agg(F.max("chunk")).first()[0]
        if last:
            parts.append(splits.read_chunks(spark, path, split, 1, end_chunk=last))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return tokens.explode_sequences(rows, ["cell", "batch_id", "label_id", "split", "chunk"])


# ---------------------------------------------------------------- U-04 ----
@query("hvg_union", with_views(f"SELECT DISTINCT gene FROM hv WHERE rank <= {HVG_K}", HVG_SQL))
def q_hvg_union(spark, sf):
    """Union of the per-sample variable genes, written as a gene-list CSV and read back."""
    from cellframe.sources.files import write_labels
    path = scratch_path(spark, "hvg-union")
    write_labels(q_hvg_topk(spark, sf).select("gene").distinct(), path)
    return spark.read.option("header", True).schema("gene long").csv(path)
