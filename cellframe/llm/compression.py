"""Quality rules: word and symbol counts, and compression bands over whole documents and fixed chunks.

A text's ratio is its UTF-8 bytes over their zstandard size.  Repetitive
text compresses too well and random text hardly at all, so the ratio of
ordinary prose lies in a band that rises with the length (a longer text
gives the compressor more to refer to).  A document is rejected when its
whole ratio lies outside the band for its length, or when more than
``max_bad_share`` of its bytes lie in chunks outside the band for theirs.

Edge cases: a null or blank text has no words, all counts 0, ratio null,
``base_failed`` true.  Rows are never merged (repeated rows and null ids
give one row each); texts of any length are handled whole, chunk by chunk.
Other columns of the input are not carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.llm.common import map_batches, text_rows

SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))  # UTF-8 bytes that do not begin a code point
LEVEL = 3
CHUNK_BYTES = 4096
# (bytes from which the limits hold, least ratio, greatest ratio) for prose at zstandard level 3; from 1 KB on the least
# ratio is above that of random base64, in lines or words (1.36 at most)
LIMITS = ((0, 0.30, 3.0), (256, 1.00, 3.0), (1024, 1.40, 3.5), (4096, 1.45, 4.5), (16384, 1.50, 5.5), (65536, 1.50, 6.5))
MAX_BAD_SHARE = 0.25

SCHEMA = ("_key string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "n_bytes long, ratio double, chunk_ratios array<float>, bad_share double")


def repeated_words(words: list[bytes], n: int = 3) -> int:
    """Words inside any n-word window that occurs at least twice."""
    if len(words) <= n:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    # windows as numbers: (first two words -> dense id), then with the third
    windows, base = code, len(ids) + 1
    for k in range(1, n):
        windows = np.unique(windows[:-1] * base + code[k:], return_inverse=True)[1]
    twice = np.bincount(windows)[windows] > 1
    edge = np.zeros(len(words) + 1, np.int32)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def outside(n_bytes: int, ratio: float, limits=LIMITS) -> bool:
    low, high = next((lo, hi) for least, lo, hi in reversed(limits) if n_bytes >= least)
    return not low <= ratio <= high


def measure(text: bytes, compress, chunk_bytes: int, limits) -> tuple:
    words = text.split()  # bytes: cut at space, tab, line and page ends only
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.translate(None, CONTINUATION))
    symbols = len(joined) - len(joined.translate(None, SYMBOLS))
    ratio = len(text) / len(compress(text)) if text else None
    ratios, bad = [], 0
    for i in range(0, len(text), chunk_bytes):
        part = text[i:i + chunk_bytes]
        r = len(part) / len(compress(part))
        ratios.append(r)
        bad += len(part) * outside(len(part), r, limits)
    return (len(words), chars, symbols, duplicate_lines(text), repeated_words(words), len(text), ratio, ratios,
            bad / len(text) if text else 0.0)


def compression_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES,
                      limits=LIMITS, max_bad_share: float = MAX_BAD_SHARE, min_words: int = 50,
                      max_repeat: float = 0.5) -> DataFrame:
    """One row per document: id, the counts, ``ratio``, ``chunk_ratios``, ``bad_share``, ``base_failed``, ``kept``."""

    def fn(rb: pa.RecordBatch) -> dict:
        import zstandard
        compress = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False).compress
        rows = [measure((t or "").encode(), compress, chunk_bytes, limits) for t in rb.column(1).to_pylist()]
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bytes", "ratio",
                 "chunk_ratios", "bad_share"]
        return {"_key": rb.column(0)} | dict(zip(names, map(list, zip(*rows))))

    schema = SCHEMA.replace("_key string", f"_key {docs.schema[id_col].dataType.simpleString()}")
    rows = map_batches(text_rows(docs, id_col, text_col), fn, schema)
    low = F.lit(None).cast("double")
    high = F.lit(None).cast("double")
    for least, lo, hi in limits:
        low = F.when(F.col("n_bytes") >= least, lo).otherwise(low)
        high = F.when(F.col("n_bytes") >= least, hi).otherwise(high)
    base = (F.col("n_words") < min_words) | (F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    bands = F.coalesce(F.col("ratio").between(low, high), F.lit(False)) & (F.col("bad_share") <= max_bad_share)
    return (rows.withColumn("base_failed", base).withColumn("kept", ~base & bands)
            .withColumnRenamed("_key", id_col))
