"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellframe.session import ensure_checkpoint_dir

# characters of text handed to an operator's Python code at a time
BATCH_CHARS = 4_000_000


def text_rows(df: DataFrame, key: str, text: str, keep: Iterable[str] = ()) -> DataFrame:
    """The key and the text as ``_key`` and ``_text``, and the columns in ``keep`` under names of their own
    (``_k0`` ...); nothing else is read, so no name of the input can clash."""
    return df.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"),
                     *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)])


def row_schema(rows: DataFrame, outputs: str) -> T.StructType:
    """The schema of an operator's rows: the key, the kept columns and the outputs (as DDL)."""
    return T.StructType([f for f in rows.schema if f.name != "_text"] + T.StructType.fromDDL(outputs).fields)


def carried(rb: pa.RecordBatch) -> dict:
    """The key and the kept columns of a batch of ``text_rows``, for the output."""
    return {n: rb.column(i) for i, n in enumerate(rb.schema.names) if n != "_text"}


def named(df: DataFrame, key: str, keep: Iterable[str] = ()) -> DataFrame:
    """Give the key and the kept columns their names; a kept column that has an output's name is left out."""
    own = {f"_k{i}": c for i, c in enumerate(keep)}
    outputs = [c for c in df.columns if c != "_key" and c not in own]
    return df.select(F.col("_key").alias(key), *outputs,
                     *[F.col(n).alias(c) for n, c in own.items() if c not in outputs and c != key])


def batches(table: Iterator[pa.RecordBatch], text: int = 1, max_chars: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that no more than ``max_chars`` bytes of text are handled at a time (one row at least)."""
    for rb in table:
        n = rb.num_rows
        if not n:
            continue
        lengths = pc.fill_null(pc.binary_length(rb.column(text)), 0).to_pylist()
        start, held = 0, 0
        for i, size in enumerate(lengths):
            if i > start and held + size > max_chars:
                yield rb.slice(start, i - start)
                start, held = i, 0
            held += size
        yield rb.slice(start)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str | T.StructType,
                text: int = 1, max_chars: int = BATCH_CHARS) -> DataFrame:
    """``mapInArrow`` with bounded batches: ``fn`` maps one batch to columns (name -> values).

    ``fn`` may return None for a batch that makes no rows.  The code is shipped to the executors first.
    """
    ensure_checkpoint_dir(df.sparkSession)
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow(fields)

    def run(table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches(table, text, max_chars):
            out = fn(rb)
            if out is not None:
                yield pa.RecordBatch.from_arrays(
                    [x if isinstance(x, pa.Array) else pa.array(x, f.type) for f, x in
                     ((f, out[f.name]) for f in arrow)], schema=arrow)

    return df.mapInArrow(run, fields)


def split_words(texts: list[bytes | None], table: bytes) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts as one binary array, and the number of words of each text.

    ``table`` translates bytes; what it makes a space separates words.  No Python object is made per word.
    """
    line = b" ".join([(t or b"").translate(table) for t in texts] + [b""])
    inside = np.frombuffer(line, np.uint8) != 32
    step = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(
        line.replace(b" ", b""))])
    begin = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])
    return words, np.diff(np.searchsorted(start, begin))


def to_arrow(fields: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(fields)


def crc_fold(key: str, folds: int):
    """crc32 of the key as text, modulo ``folds`` (null keys: null)."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds
