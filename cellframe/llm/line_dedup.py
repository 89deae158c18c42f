"""Line dedup with two Bloom filters: only lines suspected of repeating are shuffled.

A line's key is the line without white space at its ends and with A-Z lower-cased.  Keys found in at least
``min_docs`` documents lose all their lines (``keep="none"``) or all but the first (``keep="first"``).

1. Every batch of documents sends the hashes of its keys, 8 bytes each, apart for keys of one document and keys of
   several.  They are dealt by hash to shards of a fixed number of hashes, so a shard's filters have a fixed size.
2. A shard streams its hashes into a filter of keys seen once; what is in there already, or came from several
   documents of a batch, goes into the filter of keys seen twice.  That one is folded (halves joined) to the size
   that its keys need.  A key of two documents or more is always in it.
3. The documents are read again and only keys in the second filter are shuffled, as exact text, counted once a batch
   and document: the sums confirm the repeats and the least (key, text hash, line) is the first occurrence.
4. The documents are read a third time and the confirmed lines leave.

The filters and the confirmed keys are broadcast only up to ``max_broadcast`` measured bytes.  Beyond that the filter
stays in its shards and the keys are sent to it, and the confirmed keys meet the lines in a join whose heavy keys are
broadcast alone (at most 100,000 by construction), so both ways are exact and neither grows the driver.

Defined results: a null or empty text is one empty line; keys shorter than ``min_chars`` code points (the empty key
always) never count; every row is a document, also with an equal or null id; of equal rows (same id and text) all keep
their first occurrence; an empty table gives no rows.  Only the id and the text are read, so names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellframe.llm.common import map_batches, row_schema, text_rows, to_arrow
from cellframe.session import materialize

BLANK = b" \t\n\x0b\x0c\r"
PROBES = 4
BITS_PER_KEY = 16
SHARD_KEYS = 1 << 20
HEAVY = 100_000


def line_keys(text: bytes | None) -> list[bytes]:
    """The key of every line."""
    return [line.strip(BLANK).lower() for line in (text or b"").split(b"\n")]


def _long_enough(key: bytes, min_chars: int) -> bool:
    return bool(key) and (len(key) >= 4 * min_chars or min_chars <= 1 or len(key.decode()) >= min_chars)


def _hashes(keys) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def _places(hashes: np.ndarray, mask) -> Iterator[np.ndarray]:
    """The bits of each hash under a mask (one, or one a hash)."""
    step = (hashes >> np.uint64(20)) | np.uint64(1)
    at = hashes.copy()
    for _ in range(PROBES):
        yield at & mask
        at += step


def shard_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


class TwiceSeen:
    """The two filters of a shard."""

    def __init__(self, keys: int):
        self.size = 1 << max(10, (keys * BITS_PER_KEY - 1).bit_length())
        self.once, self.twice, self.repeats = np.zeros(self.size, bool), np.zeros(self.size, bool), 0

    def add(self, hashes: np.ndarray, several: bool) -> None:
        """Hashes that differ from each other, each of one document or each of several."""
        mask = np.uint64(self.size - 1)
        seen = np.ones(len(hashes), bool)
        if not several:
            for at in _places(hashes, mask):
                seen &= self.once[at]
        for at in _places(hashes, mask):
            self.once[at] = True
            self.twice[at[seen]] = True
        self.repeats += int(seen.sum())

    def folded(self) -> np.ndarray:
        """The filter of repeats, halved while it keeps ``BITS_PER_KEY`` bits for each of them."""
        out = self.twice
        while len(out) > 1024 and len(out) // 2 >= self.repeats * BITS_PER_KEY:
            out = out[:len(out) // 2] | out[len(out) // 2:]
        return np.packbits(out, bitorder="little")


class Suspects:
    """Filters of shards side by side; ``test`` says which hashes may be repeats."""

    def __init__(self, bits: int, filters: dict[int, bytes]):
        size = np.zeros(1 << bits, np.int64)
        for s, f in filters.items():
            size[s] = len(f)
        self.bits, self.start = bits, (np.cumsum(size) - size) * 8
        self.mask = np.maximum(size * 8 - 1, 0).astype(np.uint64)
        self.known = size > 0
        self.data = np.frombuffer(b"".join(filters[s] for s in sorted(filters)) or b"\0", np.uint8)

    def test(self, hashes: np.ndarray) -> np.ndarray:
        shard = shard_of(hashes, self.bits)
        out = self.known[shard]
        for at in _places(hashes, self.mask[shard]):
            at = np.where(out, at.astype(np.int64) + self.start[shard], 0)
            out = out & ((self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
        return out


def _hash_rows(rows: DataFrame, min_chars: int) -> DataFrame:
    """One row a batch: the sorted hashes of keys in one of its documents, and of keys in several."""
    def run(rb: pa.RecordBatch) -> dict:
        count: dict[bytes, int] = {}
        for t in rb.column(1).cast(pa.binary()).to_pylist():
            for k in set(line_keys(t)):
                count[k] = count.get(k, 0) + 1
        keys = [k for k in count if _long_enough(k, min_chars)]
        hashes, several = _hashes(keys), np.fromiter((count[k] > 1 for k in keys), bool, len(keys))
        many = np.unique(hashes[several])
        one = np.setdiff1d(hashes[~several], many)
        return {"one": [one.tobytes()], "many": [many.tobytes()], "n": [len(one) + len(many)]}

    return map_batches(rows, run, "one binary, many binary, n long")


def twice_seen(rows: DataFrame, min_chars: int = 1, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """The filter of repeats as a written table (``shard, filter``), and the number of bits that name a shard."""
    seen = materialize(_hash_rows(rows, min_chars), "line-hashes")
    total = seen.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = max(0, -(-total // shard_keys) - 1).bit_length()
    per_shard = -(-total // (1 << bits)) if total else 1

    def deal(rb: pa.RecordBatch) -> dict:
        out = {"shard": [], "one": [], "many": []}
        for pair in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()):
            one, many = (np.frombuffer(b, np.uint64) for b in pair)
            cut = [np.searchsorted(shard_of(h, bits), np.arange((1 << bits) + 1)) if bits < 12 else None
                   for h in (one, many)]
            shards = np.union1d(shard_of(one, bits), shard_of(many, bits))
            for s in shards.tolist():
                for name, h, c in (("one", one, cut[0]), ("many", many, cut[1])):
                    lo, hi = (c[s], c[s + 1]) if c is not None else np.searchsorted(shard_of(h, bits), [s, s + 1])
                    out[name].append(h[lo:hi].tobytes())
                out["shard"].append(s)
        return out

    dealt = (map_batches(seen, deal, "shard long, one binary, many binary", text=0)
             .repartition("shard").sortWithinPartitions("shard"))
    arrow = pa.schema([("shard", pa.int64()), ("filter", pa.binary())])

    def build(table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, filters = None, None
        for rb in table:
            for s, one, many in zip(*[c.to_pylist() for c in rb.columns]):
                if s != at:
                    if filters is not None and filters.repeats:
                        yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([filters.folded().tobytes()])],
                                                         schema=arrow)
                    at, filters = s, TwiceSeen(per_shard)
                filters.add(np.frombuffer(many, np.uint64), several=True)
                filters.add(np.frombuffer(one, np.uint64), several=False)
        if filters is not None and filters.repeats:
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([filters.folded().tobytes()])], schema=arrow)

    return materialize(dealt.mapInArrow(build, "shard long, filter binary"), "twice-seen"), bits


def _order(key):
    return key is not None, key


def _batch_counts(rb: pa.RecordBatch, min_chars: int) -> dict[bytes, list]:
    """For each key of a batch: the number of its documents and its first occurrence."""
    found: dict[bytes, list] = {}
    for doc, t in zip(rb.column(0).to_pylist(), rb.column(1).cast(pa.binary()).to_pylist()):
        row = xxhash.xxh3_128_digest(t or b"")
        first: dict[bytes, int] = {}
        for i, k in enumerate(line_keys(t)):
            first.setdefault(k, i)
        for k, i in first.items():
            have = found.get(k)
            if have is None:
                found[k] = [1, doc, row, i]
            else:
                have[0] += 1
                if (_order(doc), row, i) < (_order(have[1]), *have[2:]):
                    have[1:] = doc, row, i
    return {k: v for k, v in found.items() if _long_enough(k, min_chars)}


def _counted(rows: DataFrame, passes: Callable[[np.ndarray], np.ndarray] | None, bits: int, min_chars: int) -> DataFrame:
    """The keys of every batch that pass, with their shard, number of documents and first occurrence."""
    key = rows.schema["_key"]

    def run(rb: pa.RecordBatch) -> dict | None:
        found = _batch_counts(rb, min_chars)
        keys = list(found)
        hashes = _hashes(keys)
        ok = passes(hashes) if passes and keys else np.ones(len(keys), bool)
        keys = [k for k, o in zip(keys, ok.tolist()) if o]
        if not keys:
            return None
        cols = zip(*[found[k] for k in keys])
        return {"line_key": keys, "shard": shard_of(hashes[ok], bits), **dict(zip(("n_docs", "_key", "row", "line"), cols))}

    return map_batches(rows, run, T.StructType(
        [*T.StructType.fromDDL("line_key binary, shard long, n_docs long").fields, key,
         *T.StructType.fromDDL("row binary, line long").fields]))


def _sent_to_filters(counted: DataFrame, filters: DataFrame, bits: int) -> DataFrame:
    """Keys that are in their shard's filter, tested where the shard is (used beyond the broadcast bound)."""
    cols = counted.columns
    both = counted.withColumn("filter", F.lit(None).cast("binary")).unionByName(
        filters, allowMissingColumns=True).repartition("shard").sortWithinPartitions(F.col("shard"), F.isnull("filter"))
    arrow = to_arrow(counted.schema)

    def run(table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, test = None, None
        for rb in table:
            shard = np.asarray(rb.column(rb.schema.get_field_index("shard")))
            keys = rb.column(0).to_pylist()
            held = rb.column(rb.schema.get_field_index("filter"))
            keep = np.zeros(rb.num_rows, bool)
            edge = np.flatnonzero(np.diff(shard, prepend=-1 if at is None else at)).tolist()
            for lo, hi in zip(sorted({0, *edge}), [*sorted({0, *edge})[1:], rb.num_rows]):
                if shard[lo] != at:
                    at, test = int(shard[lo]), None
                if held[lo].is_valid:
                    test, lo = Suspects(bits, {at: held[lo].as_py()}), lo + 1
                if test is not None and hi > lo:
                    keep[lo:hi] = test.test(_hashes(keys[lo:hi]))
            yield pa.RecordBatch.from_arrays(
                [c.cast(f.type) for c, f in zip(rb.filter(pa.array(keep)).columns, arrow)], schema=arrow)

    return both.mapInArrow(run, counted.schema).select(*cols)


def repeated_lines(rows: DataFrame, min_docs: int, min_chars: int = 1, max_broadcast: int = 32 << 20,
                   shard_keys: int = SHARD_KEYS) -> DataFrame:
    """Written table of confirmed repeats: ``line_key, n_docs, first`` (struct of ``_key, row, line``).

    ``rows`` are ``text_rows``; ``min_docs`` is 2 at least, because a key of one document passes no filter.
    """
    if min_docs < 2:
        raise ValueError("min_docs is 2 at least")
    filters, bits = twice_seen(rows, min_chars, shard_keys)
    size = filters.agg(F.coalesce(F.sum(F.length("filter")), F.lit(0))).first()[0]
    if size <= max_broadcast:
        shards = {r.shard: bytes(r.filter) for r in filters.collect()}
        shipped = rows.sparkSession.sparkContext.broadcast(Suspects(bits, shards))
        suspects = _counted(rows, lambda hashes: shipped.value.test(hashes), bits, min_chars)
    else:
        suspects = _sent_to_filters(_counted(rows, None, bits, min_chars), filters, bits)
    return materialize(
        suspects.groupBy("line_key").agg(F.sum("n_docs").alias("n_docs"), F.min(F.struct("_key", "row", "line")).alias("first"))
        .where(F.col("n_docs") >= min_docs), "repeated-lines")


def _without(text: bytes | None, drop: Callable[[int, bytes], bool]) -> tuple[int, int, bytes]:
    lines = (text or b"").split(b"\n")
    stay = [line for i, line in enumerate(lines) if not drop(i, line.strip(BLANK).lower())]
    return len(lines), len(lines) - len(stay), b"\n".join(stay)


_OUT = "n_lines long, n_dropped long, kept_text string"


def _drop_shipped(rows: DataFrame, repeats: DataFrame, first: bool) -> DataFrame:
    own = {bytes(r.line_key): (r["first"]["_key"], bytes(r["first"].row), r["first"].line) if first else None
           for r in repeats.collect()}
    shipped = rows.sparkSession.sparkContext.broadcast(own)

    def run(rb: pa.RecordBatch) -> dict:
        gone = shipped.value
        out = []
        for doc, t in zip(rb.column(0).to_pylist(), rb.column(1).cast(pa.binary()).to_pylist()):
            row = xxhash.xxh3_128_digest(t or b"") if first else b""
            out.append(_without(t, lambda i, k: k in gone and (not first or gone[k] != (doc, row, i))))
        n, dropped, kept = zip(*out)
        return {"_key": rb.column(0), "n_lines": n, "n_dropped": dropped,
                "kept_text": pa.array(kept, pa.binary()).cast(pa.string())}

    return map_batches(rows, run, row_schema(rows, _OUT))


def _drop_joined(rows: DataFrame, repeats: DataFrame, first: bool, salts: int = 16) -> DataFrame:
    """As ``_drop_shipped``, with joins: lines meet the confirmed keys, and a document meets its lines that leave."""
    key = rows.schema["_key"]

    def lines(rb: pa.RecordBatch) -> dict:
        out: dict[tuple, list] = {}
        for doc, t in zip(rb.column(0).to_pylist(), rb.column(1).cast(pa.binary()).to_pylist()):
            row = xxhash.xxh3_128_digest(t or b"")
            if (doc, row) not in out:
                at: dict[bytes, list] = {}
                for i, k in enumerate(line_keys(t)):
                    at.setdefault(k, []).append(i)
                out[doc, row] = list(at.items())
        flat = [(d, r, k, i) for (d, r), found in out.items() for k, i in found if k]
        return dict(zip(("_key", "row", "line_key", "lines"), zip(*flat))) if flat else None

    met = map_batches(rows, lines, T.StructType([key, *T.StructType.fromDDL("row binary, line_key binary, lines array<long>").fields]))
    total = repeats.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
    # a key with more than 1 in HEAVY of what is joined is one of HEAVY keys at most
    heavy = F.col("n_docs") * HEAVY > F.lit(total)
    named = repeats.select("line_key", "n_docs", F.col("first").alias("_first"))
    hot = F.broadcast(named.where(heavy)) if total > HEAVY * 1000 else named.where(heavy)
    hit = met.join(hot, "line_key").unionByName(met.join(named.where(~heavy), "line_key"))
    if first:
        keep = (F.col("_first._key").eqNullSafe(F.col("_key"))) & (F.col("_first.row") == F.col("row"))
        hit = hit.withColumn("lines", F.when(keep, F.array_remove("lines", F.col("_first.line"))).otherwise(F.col("lines")))
    gone = hit.groupBy("_key", "row").agg(F.flatten(F.collect_set("lines")).alias("gone"))
    gone = gone.select(F.col("_key").alias("_gkey"), F.col("row").alias("_grow"), "gone",
                       F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_gsalt"))

    def tag(rb: pa.RecordBatch) -> dict:
        row = [xxhash.xxh3_128_digest(t or b"") for t in rb.column(1).cast(pa.binary()).to_pylist()]
        return {"_key": rb.column(0), "_text": rb.column(1), "row": row, "salt": np.arange(len(row)) % salts}

    tagged = map_batches(rows, tag, T.StructType([*rows.schema.fields, *T.StructType.fromDDL("row binary, salt int").fields]))
    found = tagged.join(gone, F.col("_key").eqNullSafe(F.col("_gkey")) & (F.col("row") == F.col("_grow"))
                        & (F.col("salt") == F.col("_gsalt")), "left").select("_key", "_text", "gone")

    def run(rb: pa.RecordBatch) -> dict:
        out = []
        for t, g in zip(rb.column(1).cast(pa.binary()).to_pylist(), rb.column(2).to_pylist()):
            leave = set(g or ())
            out.append(_without(t, lambda i, k: i in leave))
        n, dropped, kept = zip(*out)
        return {"_key": rb.column(0), "n_lines": n, "n_dropped": dropped,
                "kept_text": pa.array(kept, pa.binary()).cast(pa.string())}

    return map_batches(found, run, row_schema(rows, _OUT))


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1,
               keep: str = "none", max_broadcast: int = 32 << 20, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """One row per document: the key, ``n_lines``, ``n_dropped`` and ``kept_text`` (lines joined by ``\\n``)."""
    if keep not in ("none", "first"):
        raise ValueError("keep is 'none' or 'first'")
    rows = text_rows(docs, key, text)
    repeats = repeated_lines(rows, min_docs, min_chars, max_broadcast, shard_keys)
    # about 150 bytes of objects beside each key in a task
    size = repeats.agg(F.coalesce(F.sum(F.length("line_key") + 150), F.lit(0))).first()[0]
    drop = _drop_shipped if size <= max_broadcast else _drop_joined
    return drop(rows, repeats, keep == "first").withColumnRenamed("_key", key)
