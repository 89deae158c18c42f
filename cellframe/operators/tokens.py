"""Cell filters, gene sampling and fixed-length sequence assembly.

PF-01 denylist, PF-02 expressed genes, PF-03 keep-zero mode, J-02/J-03
labelled cells, J-01 strict batch lookup, W-03 gene sampling, A-05 / S-11
assembly with padding, S-02 CLS prefix, PF-04 pad recode, PF-05 pad mask.

Partitioning: everything per cell shares ONE shuffle on the cell's key.  The
window that counts and ranks a cell's genes requires hash partitioning on
that key; the assembly aggregate and the join with the cell table reuse it.
A cell's group is bounded by the number of distinct genes (a cell has at
most one row per gene), so no group is unbounded even if one sample or
batch holds a third of all rows.  Arrays are cut to ``seq_length`` before
they are collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellframe.config import CLS_ID_DEFAULT, CLS_VALUE, N_BINS, PAD_TOKEN_ID, PAD_VALUE, Params
from cellframe.functions.columns import hash_order, pad_right


# ---------------------------------------------------------------- filters --
def drop_denied_types(cells: DataFrame, denylist, col: str = "celltype") -> DataFrame:
    """Drop listed cell types; a null type is kept (plain NOT IN would drop it)."""
    c = F.col(col)
    return cells.filter(c.isNull() | ~c.isin(list(denylist)))


def expressed(df: DataFrame, value: str = "value") -> DataFrame:
    """Keep genes whose value is neither 0, null nor NaN."""
    v = F.col(value).cast("double")
    return df.filter(v.isNotNull() & ~F.isnan(v) & (v != 0))


def one_per_key(table: DataFrame, key: str, col: str) -> DataFrame:
    """(key, col) with each key once; a key that occurs twice fails the job (DQ-01)."""
    t = table.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.first(col).alias(col))
    return t.select(key, F.when(F.col("_n") == 1, F.col(col)).otherwise(F.raise_error(
        F.concat(F.lit(f"repeated {key}: "), F.col(key).cast("string")))).alias(col))


def labelled(expr: DataFrame, labels: DataFrame, key: str = "cell",
             label_col: str = "celltype") -> DataFrame:
    """Rows of labelled cells with their label attached; a cell with two labels is an error."""
    return expr.join(one_per_key(labels, key, label_col), key, "inner")


def strict_lookup(df: DataFrame, table: DataFrame, key: str, col: str) -> DataFrame:
    """Left join that fails the job when a key has no match (KeyError in the reference)."""
    j = df.join(one_per_key(table, key, col), key, "left")
    return j.withColumn(col, F.when(F.col(col).isNotNull(), F.col(col)).otherwise(
        F.raise_error(F.concat(F.lit(f"missing {col} for {key} "), F.col(key).cast("string")))))


# --------------------------------------------------------------- sampling --
def sample_genes(df: DataFrame, seq_length: int, sample_size: int, seed: int,
                 cell: str = "cell", gene: str = "gene", sample: str | None = None) -> DataFrame:
    """Choose each cell's genes and their sequence positions (``pos`` from 1).

    More than ``seq_length`` expressed genes: the first ``sample_size`` in
    md5 order of 'cell:gene:seed' (a draw without replacement), placed in
    that order.  Otherwise: every gene, in gene order.  ``n_expressed`` is
    the cell's count before sampling.  With ``sample`` a cell is identified
    by (sample, cell), so equal barcodes of two samples stay apart.
    """
    per_cell = Window.partitionBy(*([sample] if sample else []), cell)
    df = df.withColumn("n_expressed", F.count(F.lit(1)).over(per_cell))
    big = F.col("n_expressed") > seq_length
    key = F.when(big, hash_order(cell, gene, seed=seed))
    ranked = df.withColumn(
        "pos", F.row_number().over(per_cell.orderBy(key.asc_nulls_first(), F.col(gene).asc())))
    return ranked.filter(F.col("pos") <= F.when(big, F.lit(sample_size)).otherwise(F.lit(seq_length)))


# --------------------------------------------------------------- assembly --
def assemble(chosen: DataFrame, seq_length: int, pad_id: int = PAD_TOKEN_ID,
             pad_value: float = PAD_VALUE, cell: str = "cell", gene_id: str = "gene_id",
             value: str = "val", sample: str | None = None) -> DataFrame:
    """One row per cell: ``gene_ids`` / ``vals`` arrays right-padded to ``seq_length``."""
    keys = [*([sample] if sample else []), cell]
    g = chosen.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col("pos"), F.col(gene_id).alias("g"),
                                             F.col(value).cast("double").alias("v")))).alias("_t"))
    return g.select(
        *keys,
        F.size("_t").cast("long").alias("n_genes"),
        pad_right(F.transform("_t", lambda s: s["g"]), seq_length, pad_id).alias("gene_ids"),
        pad_right(F.transform("_t", lambda s: s["v"]), seq_length, pad_value).alias("vals"),
    )


def of_cell(left: DataFrame, right: DataFrame, cell: str = "cell", sample: str | None = None, how: str = "left") -> DataFrame:
    """Join on the cell, and on the sample where it tells cells apart.

    The sample is compared as a range, not as a join key: a layout on the
    cell then serves the join, so expression rows that were shuffled on the
    cell for their view are not shuffled again on (sample, cell).
    """
    if not sample:
        return left.join(right, cell, how)
    r = right.withColumnsRenamed({cell: "_cell", sample: "_sample"})
    same = (F.col(cell) == F.col("_cell")) & (F.col(sample) >= F.col("_sample")) & (F.col(sample) <= F.col("_sample"))
    return left.join(r, same, how).drop("_cell", "_sample")


def attach_to_cells(cells: DataFrame, seqs: DataFrame, seq_length: int,
                    pad_id: int = PAD_TOKEN_ID, pad_value: float = PAD_VALUE,
                    cell: str = "cell", sample: str | None = None) -> DataFrame:
    """Left join cells to sequences; a cell with no expressed gene gets an all-pad row."""
    j = of_cell(cells, seqs, cell, sample)
    return (j.withColumn("n_genes", F.coalesce(F.col("n_genes"), F.lit(0).cast("long")))
            .withColumn("gene_ids", F.coalesce(F.col("gene_ids"),
                                               F.array_repeat(F.lit(pad_id), seq_length)))
            .withColumn("vals", F.coalesce(F.col("vals"),
                                           F.array_repeat(F.lit(float(pad_value)), seq_length))))


def explode_sequences(seqs: DataFrame, keep: list[str]) -> DataFrame:
    """One row per (cell, position) with position from 1 (for checks and hashing)."""
    z = F.arrays_zip(F.col("gene_ids").alias("gene_id"), F.col("vals").alias("val"))
    return (seqs.select(*keep, F.posexplode(z).alias("_p", "_z"))
            .select(*keep, (F.col("_p") + 1).cast("long").alias("pos"),
                    F.col("_z.gene_id").cast("int").alias("gene_id"),
                    F.col("_z.val").alias("val")))


# ----------------------------------------------------------- composition --
def build_tokens(expr_binned: DataFrame, cells: DataFrame, gene_vocab: DataFrame,
                 p: Params, value: str = "bin", tasks: int | None = None) -> DataFrame:
    """Binned long expression + cell table -> one padded sequence row per cell.

    ``cells`` must already be filtered (denylist) and carry the label ids to
    keep; ``gene_vocab`` is ``(name, id)``.  Both tables carry ``sample``:
    a cell is one row of one sample file.  ``tasks`` is the number of tasks
    for shuffles of single genes, where the vocabulary is too large to send.
    """
    from cellframe.operators.vocab import encode_genes
    e = of_cell(expressed(expr_binned, value), cells.select("sample", "cell"), "cell", "sample", "left_semi")
    e = encode_genes(e, gene_vocab, "gene", "gene_id", p.pad_id, tasks)
    chosen = sample_genes(e.withColumn("val", F.col(value).cast("double")),
                          p.seq_length, p.sample_size, p.seed, sample="sample")
    seqs = assemble(chosen, p.seq_length, p.pad_id, p.pad_value, sample="sample")
    return attach_to_cells(cells, seqs, p.seq_length, p.pad_id, p.pad_value, sample="sample")


def dense_genes(expr_zero: DataFrame, seq_length: int, gene_vocab: DataFrame,
                pad_id: int = PAD_TOKEN_ID, pad_value: float = PAD_VALUE) -> DataFrame:
    """Keep-zero mode (PF-03): every gene of the cell's sample, zeros included.

    A sample's gene columns are the distinct genes seen in it, in gene order.
    A sample with more genes than ``seq_length`` is an error, never a cut.
    Each cell's values are collected into a map (at most ``seq_length``
    entries) in one shuffle on (sample, cell); missing genes read as 0.
    """
    from cellframe.operators.vocab import encode_genes
    genes = expr_zero.select("sample", "gene").distinct()
    n = F.count(F.lit(1)).over(Window.partitionBy("sample"))
    too_many = F.raise_error(F.concat(F.lit("sample "), F.col("sample").cast("string"), F.lit(" has "),
                                      F.col("_n").cast("string"), F.lit(f" genes, more than {seq_length}")))
    placed = (genes.withColumn("_n", n)
              .withColumn("pos", F.when(F.col("_n") > seq_length, too_many.cast("int")).otherwise(
                  F.row_number().over(Window.partitionBy("sample").orderBy("gene")))).drop("_n"))
    placed = encode_genes(placed, gene_vocab, "gene", "gene_id", pad_id)
    lists = placed.groupBy("sample").agg(
        F.array_sort(F.collect_list(F.struct("pos", "gene", "gene_id"))).alias("_genes"))
    per_cell = expr_zero.groupBy("sample", "cell").agg(F.map_from_entries(F.collect_list(
        F.struct(F.col("gene"), F.col("value").cast("double")))).alias("_m"))
    j = per_cell.join(lists, "sample")
    ids = F.transform("_genes", lambda s: s["gene_id"])
    vals = F.transform("_genes", lambda s: F.coalesce(F.element_at(F.col("_m"), s["gene"]), F.lit(0.0)))
    return j.select("sample", "cell", F.size("_genes").cast("long").alias("n_genes"),
                    pad_right(ids, seq_length, pad_id).alias("gene_ids"),
                    pad_right(vals, seq_length, float(pad_value)).alias("vals"))


# ---------------------------------------------------------- array recodes --
def prepend_cls(seqs: DataFrame, cls_id: int = CLS_ID_DEFAULT) -> DataFrame:
    """S-02: value 0 and the <cls> id in front of every sequence."""
    return (seqs.withColumn("vals", F.concat(F.array(F.lit(CLS_VALUE)), F.col("vals")))
            .withColumn("gene_ids", F.concat(F.array(F.lit(cls_id)), F.col("gene_ids"))))


def pad_recode(seqs: DataFrame, pad_value: float = PAD_VALUE, n_bins: int = N_BINS) -> DataFrame:
    """PF-04: pad value -> n_bins for categorical value input."""
    return seqs.withColumn("vals", F.transform("vals", lambda v: F.when(v == pad_value, float(n_bins))
                                               .otherwise(v)))


def pad_mask(seqs: DataFrame, pad_id: int = PAD_TOKEN_ID) -> DataFrame:
    """PF-05: boolean per position, true where the gene id is the pad id."""
    return seqs.withColumn("pad_mask", F.transform("gene_ids", lambda g: g == pad_id))


def pad_in_middle(seqs: DataFrame, pad_id: int = PAD_TOKEN_ID) -> DataFrame:
    """DQ-02: flag rows where a pad id comes before a real id (padding must be at the end).

    Unknown genes also carry the pad id, so they are reported here too.
    """
    ids = F.col("gene_ids")
    real = F.transform(ids, lambda g: g != pad_id)
    first_pad = F.array_position(ids, pad_id)
    last_real = F.when(F.array_contains(real, True),
                       F.size(ids) - F.array_position(F.reverse(real), True) + 1).otherwise(0)
    return seqs.withColumn("pad_middle", (first_pad > 0) & (first_pad < last_real))
