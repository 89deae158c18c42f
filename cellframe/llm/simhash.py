"""SimHash near-duplicates through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments (22, 21 and 21 bits).  If two
fingerprints differ in at most two bits, some segment is equal and the next
one (in cyclic order) differs in at most one bit.  So three cyclic pairs of
segments (exact, near) cover every way to spread two errors.

The near segment, padded to 23 bits, is decoded with the perfect binary
Golay code: every word has one nearest codeword, at most 3 bits away, and a
word one bit off has that codeword within 4 bits.  A word has one codeword
within 4 bits, or six if its own is 3 away.  So each fingerprint is stored
under three keys (exact segment, index of the nearest codeword) and asks
under up to eighteen (exact segment, index of each codeword within 4 bits);
an equi-join on the key meets every linked pair, and the bit distance
verifies it.

Keys that hold many fingerprints (dense groups of near copies) are not
joined pair by pair.  The fingerprints under them are linked exactly through
midpoints: two fingerprints differ in at most two bits if and only if some
64-bit value differs from each in at most one, so every fingerprint names
its 65 values and all that name the same value (65 at most) are joined to
the smallest.  No pair is lost, and rows grow with the group, not its square.

Equal fingerprints are one node from the start.  Components come from
alternating large-star and small-star rounds until nothing changes; each
round is written to the shared folder.

Edge cases: a null or blank text has fingerprint zero and is linked like any
other; a text of fewer words than the shingle is one shingle; null ids are
carried and never become a component's id unless all its ids are null.
Repeated rows stay.  Other columns of the input are carried only if named
in ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.llm.common import carried, map_batches, named, row_schema, text_rows
from cellframe.session import drop_scratch, ensure_checkpoint_dir, materialize, scratch_path

SEED = 42
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # (shift, width)
GENERATOR = 0xC75                         # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
HOT_PAIRS = 4096                          # a key with more (stored x asking) pairs goes through midpoints
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash: a bit is set if it is set in over half of the shingles' hashes."""
    import xxhash
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    line, hash64 = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return hash64(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[:len(words) - shingle + 1].tolist()
    h = np.array([hash64(line[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1:] - 1).tolist())], np.uint64)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(h), 16384):
        part = h[at:at + 16384].astype(">u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """``_key`` (the id), ``fp`` (the 64 bits as a signed long), and the columns in ``keep`` as ``_k0`` ..."""

    def fn(rb: pa.RecordBatch) -> dict:
        fp = np.array([fingerprint(t, shingle) for t in rb.column(1).to_pylist()], np.uint64)
        return carried(rb) | {"fp": pa.array(fp.view(np.int64))}

    rows = text_rows(docs, id_col, text_col, keep)
    return map_batches(rows, fn, row_schema(rows, "fp long"))


@lru_cache(1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the high 11 and low 12 bits of a word; per syndrome the error pattern of weight <= 3 and the
    index offsets of all codewords within 4 bits (-1 where there are fewer than six)."""

    def remainder(w: int) -> int:
        for b in range(22, 10, -1):
            if w >> b & 1:
                w ^= GENERATOR << (b - 11)
        return w

    unit = [remainder(1 << b) for b in range(23)]

    def syndrome(w: int) -> int:
        out = 0
        for b in range(23):
            if w >> b & 1:
                out ^= unit[b]
        return out

    high = np.array([syndrome(x << 12) for x in range(1 << 11)], np.int64)
    low = np.array([syndrome(x) for x in range(1 << 12)], np.int64)
    error = np.zeros(2048, np.int64)
    for a in range(23):
        error[unit[a]] = 1 << a
        for b in range(a):
            error[unit[a] ^ unit[b]] = 1 << a | 1 << b
            for c in range(b):
                error[unit[a] ^ unit[b] ^ unit[c]] = 1 << a | 1 << b | 1 << c
    near = np.full((2048, 6), -1, np.int64)
    near[:, 0] = 0
    # codewords of weight 7: message x (top 12 bits) with its check bits
    words = [(x << 11) ^ syndrome(x << 11) for x in range(4096)]
    sevens = [w for w in words if w.bit_count() == 7]
    for s in range(2048):
        e = int(error[s])
        if e.bit_count() == 3:
            near[s, 1:] = [w >> 11 for w in sevens if w & e == e]
    return high, low, error, near


def decode(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest codeword of 23-bit words, and (n, 6) indexes of all codewords within 4 bits (-1: none)."""
    high, low, error, near = golay()
    s = high[words >> 12] ^ low[words & 0xFFF]
    index = (words ^ error[s]) >> 11
    return index, np.where(near[s] < 0, -1, index[:, None] ^ near[s])


def fuzzy_keys(fps: DataFrame) -> DataFrame:
    """``key``, ``fp``, ``stored`` for distinct fingerprints: 3 stored keys and up to 18 asked ones each."""

    def run(table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in table:
            fp = rb.column(0).to_numpy(zero_copy_only=False)
            bits = fp.view(np.uint64)
            seg = [(bits >> np.uint64(s)).astype(np.int64) & ((1 << w) - 1) for s, w in SEGMENTS]
            for i in range(3):
                exact, near = seg[i], seg[(i + 1) % 3]
                base = (np.int64(i) << 40) | (exact << 12)
                nearest, within = decode(near)
                row, col = np.nonzero(within >= 0)
                keys = np.concatenate([base | nearest, base[row] | within[row, col]])
                who = np.concatenate([fp, fp[row]])
                stored = np.arange(len(keys)) < len(fp)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(who), pa.array(stored)],
                                                 names=["key", "fp", "stored"])

    return fps.select("fp").mapInArrow(run, "key long, fp long, stored boolean")


def links(fps: DataFrame, max_bits: int = 2, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints linked at ``max_bits`` or fewer differing bits.

    Under ordinary keys every linked pair is an edge; under hot keys the edges span what is linked.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("the key scheme covers distances of 0 to 2 bits")
    keys = materialize(fuzzy_keys(fps), "simhash-keys")
    counts = keys.groupBy("key").agg(F.sum(F.col("stored").cast("long")).alias("s"),
                                     F.sum((~F.col("stored")).cast("long")).alias("q"))
    hot = materialize(counts.where(F.col("s") * F.col("q") > hot_pairs).select("key"), "simhash-hot")
    cold = keys.join(hot, "key", "left_anti")
    a = cold.where("stored").select("key", F.col("fp").alias("a"))
    b = cold.where("not stored").select("key", F.col("fp").alias("b"))
    pairs = a.join(b, (a["key"] == b["key"]) & (F.col("a") < F.col("b"))
                   & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)).select("a", "b")
    dense = keys.join(hot, "key", "left_semi").select("fp").distinct()
    return pairs.unionByName(midpoint_links(dense, max_bits)).distinct()


def midpoint_links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Edges from the smallest fingerprint of each midpoint to the others that name it (65 at most)."""
    if max_bits < 1:
        return fps.sparkSession.createDataFrame([], "a long, b long")
    flips = F.concat(F.array(F.lit(0).cast("long")),
                     F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    if max_bits == 1:  # both ends must name the value, and one of them must be it
        named = fps.select(F.col("fp").alias("b"), F.explode(flips).alias("_f")) \
            .select(F.col("b").bitwiseXOR(F.col("_f")).alias("a"), "b")
        return named.join(fps.select(F.col("fp").alias("a")), "a", "left_semi").where("a < b")
    named = fps.select("fp", F.explode(flips).alias("_f")).select(F.col("fp").bitwiseXOR(F.col("_f")).alias("m"), "fp")
    # fingerprints that name one value: at most 65 exist
    met = named.groupBy("m").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    return met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a < b")


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (its component's smallest node) for every node of ``edges`` (a, b)."""
    spark = edges.sparkSession

    def written(df: DataFrame) -> tuple[DataFrame, str, tuple]:
        path = scratch_path(spark, "simhash-edges")
        df.write.parquet(path)
        df = spark.read.schema("a long, b long").parquet(path)
        sign = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        return df, path, tuple(sign)

    state, path, sign = written(edges.select("a", "b"))
    while True:
        # large star: every neighbour above a node goes to the node's smallest neighbour
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        # small star: a node and its neighbours below go to the smallest of them
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = (large.join(low, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y"))
                 .where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        new, new_path, new_sign = written(small)
        drop_scratch(spark, path)
        state, path = new, new_path
        if new_sign == sign:
            break
        sign = new_sign
    return state.select(F.col("b").alias("node"), F.col("a").alias("root"))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                  max_bits: int = 2, hot_pairs: int = HOT_PAIRS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, ``fp`` (long), ``fingerprint`` (16 hex digits), ``component_id`` (smallest id
    of the documents reachable over links), ``root`` (the component's smallest fingerprint), and ``keep``."""
    ensure_checkpoint_dir(docs.sparkSession)
    fps = materialize(fingerprints(docs, id_col, text_col, shingle, keep), "simhash-fps")
    first = materialize(fps.groupBy("fp").agg(F.min("_key").alias("least")), "simhash-first")
    roots = components(links(first, max_bits, hot_pairs))
    # a fingerprint without links is its own root
    group = first.join(roots, first["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    least = group.groupBy("root").agg(F.min("least").alias("component_id"))
    groups = materialize(group.join(least, "root").select("fp", "root", "component_id"), "simhash-groups")
    return named(fps.join(groups, "fp", "left").withColumn(
        "fingerprint", F.lower(F.lpad(F.hex("fp"), 16, "0"))), id_col, keep)
