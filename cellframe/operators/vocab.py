"""Vocabularies: build (A-02), bounds (A-03), encode (J-04, J-05), decode (J-06, J-07).

A vocabulary is a DataFrame ``(name string, id int)``.  Building one only
shuffles the distinct names (partial aggregation first), and the window
that numbers them runs over that distinct set, whose size is the number of
labels.  Encoding joins against the vocabulary with a size-checked
broadcast; beyond the bound it is an ordinary shuffle join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellframe.config import PAD_TOKEN_ID
from cellframe.functions.ranking import checked_broadcast

# Vocabularies above this many entries are joined by shuffle, not broadcast.
VOCAB_BROADCAST_MAX_ROWS = 2_000_000


def vocab_build(df: DataFrame, name_col: str, order_cols: list[str],
                start: int = 0) -> DataFrame:
    """Distinct names numbered by first appearance (``order_cols`` order).

    A null name becomes the text ``nan``, as writing it to a names file does.
    """
    name = F.coalesce(F.col(name_col).cast("string"), F.lit("nan"))
    first = (df.select(name.alias("name"), F.struct(*order_cols).alias("_first"))
             .groupBy("name").agg(F.min("_first").alias("_first")))
    return first.select(
        "name", (F.row_number().over(Window.orderBy("_first")) - 1 + start).cast("int").alias("id"))


def vocab_bounds(vocab: DataFrame) -> DataFrame:
    return vocab.agg(F.min("id").alias("min_id"), F.max("id").alias("max_id"),
                     F.count(F.lit(1)).alias("n_entries"))


def _vocab_side(vocab: DataFrame, key: str, val: str) -> DataFrame:
    v = vocab.select(F.col("name").alias(key), F.col("id").alias(val))
    return checked_broadcast(v, VOCAB_BROADCAST_MAX_ROWS)


def encode_genes(df: DataFrame, vocab: DataFrame, gene: str = "gene",
                 out: str = "gene_id", pad_id: int = PAD_TOKEN_ID, tasks: int | None = None,
                 layout: str = "cell") -> DataFrame:
    """gene -> id; genes missing from the vocabulary get the pad id.

    A vocabulary beyond the broadcast's bound is joined in ``tasks`` tasks,
    and the rows go back to as many by ``layout`` for what follows per cell.
    """
    v = vocab.select(F.col("name").alias("_g"), F.col("id").alias("_id"))
    side = checked_broadcast(v, VOCAB_BROADCAST_MAX_ROWS)
    if side is v and tasks:
        joined = df.repartition(tasks, gene).join(v.repartition(tasks, "_g"), F.col(gene) == F.col("_g"), "left")
        joined = joined.repartition(tasks, layout)
    else:
        joined = df.join(side, df[gene] == side["_g"], "left")
    return (joined.withColumn(out, F.coalesce(F.col("_id"), F.lit(pad_id)).cast("int"))
            .drop("_g", "_id"))


def encode_labels(df: DataFrame, vocab: DataFrame, col: str, out: str) -> DataFrame:
    """name -> id; unknown names give null.

    Label vocabularies are broadcast after their size is measured, so the
    cell table is not shuffled on a handful of hot names.
    """
    v = checked_broadcast(vocab.select(F.col("name").alias("_name"), F.col("id").alias(out)), VOCAB_BROADCAST_MAX_ROWS)
    return df.join(v, df[col] == v["_name"], "left").drop("_name")


def invert_vocab(vocab: DataFrame) -> DataFrame:
    """id -> name; when an id appears twice the later entry (largest order) wins.

    ``vocab`` may carry an ``ord`` column giving entry order; otherwise the
    name order is used.
    """
    order = F.col("ord") if "ord" in vocab.columns else F.col("name")
    return vocab.groupBy("id").agg(F.max_by("name", order).alias("name"))


def decode_labels(df: DataFrame, vocab: DataFrame, col: str, out: str) -> DataFrame:
    inv = invert_vocab(vocab).select(F.col("id").alias("_id"), F.col("name").alias(out))
    inv = checked_broadcast(inv, VOCAB_BROADCAST_MAX_ROWS)
    return df.join(inv, df[col] == inv["_id"], "left").drop("_id")


def decode_by_species(df: DataFrame, vocabs: DataFrame, species: str, col: str,
                      out: str, generic: str = "generic") -> DataFrame:
    """Decode ``col`` with the vocabulary of the row's species.

    ``vocabs`` is ``(species, name, id)``; a species without its own
    vocabulary falls back to the ``generic`` one.
    """
    own = checked_broadcast(vocabs.select(F.col("species").alias("_sp"), F.col("id").alias("_id"),
                                          F.col("name").alias("_own")), VOCAB_BROADCAST_MAX_ROWS)
    gen = checked_broadcast(vocabs.filter(F.col("species") == generic)
                            .select(F.col("id").alias("_gid"), F.col("name").alias("_gen")),
                            VOCAB_BROADCAST_MAX_ROWS)
    known = checked_broadcast(vocabs.select(F.col("species").alias("_ks")).distinct(), 10_000)
    j = (df.join(known, df[species] == known["_ks"], "left")
         .join(own, (F.col("_ks") == own["_sp"]) & (df[col] == own["_id"]), "left")
         .join(gen, df[col] == gen["_gid"], "left"))
    return (j.withColumn(out, F.when(F.col("_ks").isNotNull(), F.col("_own")).otherwise(F.col("_gen")))
            .drop("_sp", "_id", "_own", "_gid", "_gen", "_ks"))


def row_positions(df: DataFrame, order: list[str], name: str = "pos") -> DataFrame:
    """W-12: every row's position in ``order`` (a unique order), from 0, for tables of any size."""
    from cellframe.functions.ranking import global_row_number
    return global_row_number(df, order, name, start=0)


def names_at(positions: DataFrame, index: DataFrame, pos: str, name: str) -> DataFrame:
    """J-13 back: the name at each position, null where the index has none."""
    return positions.select(pos).join(index.select(pos, name), pos, "left")
