"""Corpus pipeline: quality, language, near-duplicates, benchmark passages, sampled pieces.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written and read again as the next stage's ``docs``.  All but the last
return the columns of ``docs``; a row is identified by its id and its text,
so repeated ids are judged row by row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellframe.llm import decontaminate, langid, pieces, pu_quality, simhash
from cellframe.llm.common import crc_fold
from cellframe.llm.queries import table, tokenizer_file
from cellframe.session import ensure_checkpoint_dir, materialize

#: No stage can be stated in SQL from the first on (a fitted network); the stages are tested one by one.
ORACLE_SQL = None


def _carried(docs: DataFrame, judge: Callable[[DataFrame, tuple[str, ...]], DataFrame]) -> DataFrame:
    """Run ``judge(docs, keep)`` with all columns of ``docs`` carried under names that cannot clash, restore them."""
    safe = {c: c if c in ("doc_id", "text") else f"_c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.toDF(*safe.values())
    kept = judge(plain, tuple(n for n in safe.values() if n != "doc_id"))
    return kept.select(*[F.col(n).alias(c) for c, n in safe.items()])


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a hash of the text that identifies a row beside its id."""
    name = "_text_hash"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, F.xxhash64(F.col("text"), F.col("text").isNull())), name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of quality.

    Null and empty texts are scored like any other (they have no words); whole texts of any length are scored; equal
    rows get equal scores and stay or go together; without labels of quality all score 0.5 and stay; no documents
    give no rows.
    """
    ensure_checkpoint_dir(spark)
    learn = F.coalesce(crc_fold("doc_id", 3) != 1, F.lit(False))
    net = pu_quality.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), learn)
    return _carried(docs, lambda d, keep: pu_quality.score(d, net, keep=keep).where("predicted = 1"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known (not ``und``).

    Null and empty texts and texts without a letter have none and go, and so do all where no row has a language; whole
    texts are parsed; ties go to the language whose name sorts first; repeated rows are judged alike.
    """
    ensure_checkpoint_dir(spark)
    learn = F.coalesce(crc_fold("doc_id", 4) != 2, F.lit(False))
    automata = langid.fit(docs, learn)
    return _carried(docs, lambda d, keep: langid.identify(d, automata, keep=keep).where("lang_pred != 'und'"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: the one with the smallest id (one row of it).

    Null, empty and blank texts have fingerprint 0 and are one group; whole texts are hashed; of repeated rows and of
    rows with equal ids the one with the least text hash stays; a null id is the smallest; no rows give none.
    """
    rows, h = _keyed(docs)
    found = materialize(simhash.simhash_dedup(rows.select("doc_id", "text", h), keep=(h,)), "near-duplicates")
    stays = (found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
             .groupBy("root", "doc_id").agg(F.min(h).alias(h)).select("doc_id", h))
    twice = found.groupBy("doc_id", h).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", h)
    kept = _match(rows, stays, h, "left_semi")
    # texts are shuffled for repeated rows only
    once = _match(kept, twice, h, "left_anti")
    again = _match(kept, twice, h, "left_semi").dropDuplicates(["doc_id", h])
    return once.unionByName(again).select(*docs.columns)


def _match(rows: DataFrame, ids: DataFrame, h: str, how: str) -> DataFrame:
    ids = ids.select(F.col("doc_id").alias("_id"), F.col(h).alias("_h"))
    return rows.join(ids, rows["doc_id"].eqNullSafe(ids["_id"]) & (rows[h] == ids["_h"]), how)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark items.

    Null and empty texts have no words and stay; whole texts are searched; rows are judged by id and text, so repeated
    rows stay or go together; without items or documents nothing goes.
    """
    rows, h = _keyed(docs)
    judged = decontaminate.decontaminate(rows.select(F.struct("doc_id", h).alias("id"), "text"),
                                         table(spark, sf_dir, "benchmark"), id_col="id")
    bad = materialize(judged.where("contaminated").select("id.doc_id", f"id.{h}").distinct(), "contaminated")
    return _match(rows, bad, h, "left_anti").select(*docs.columns)


def sampled_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with sampled segmentations that decode to their texts.

    A null text has null pieces, an empty one none; whole texts are segmented; rows with equal id and text get equal
    pieces; no rows give none.
    """
    out = pieces.encode(docs, tokenizer_file("piece_bpe_32k.model"), keep=("text",))
    return out.select("doc_id", "text", "ids", "n_pieces", "lossless")


STAGES = [
    ("quality classifier", quality),
    ("language id", language),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("sentencepiece encoding", sampled_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
