"""Benchmark decontamination with a distributed positional inverted index.

Documents are indexed in blocks (one row of the stored index per block):
the block's terms, each term's number of postings, and all postings as
word positions in the block, sorted within a term.  A query phrase is found
by intersecting its terms' postings, each shifted by the term's offset in
the phrase, from the rarest term of the block to the most frequent; the
list only shrinks, so frequent terms are just looked up.  ``slop`` > 0
asks for each term within so many words of its place (proximity).

The index is written to the shared folder once and searched where it lies:
no posting is shuffled and no block depends on another.  Items are searched
in query blocks of a bounded number of characters, so the broadcast stays
bounded whatever the size of the benchmark.

Edge cases: null and empty texts have no words (n_words 0, never
contaminated); items without words are never found; an item shorter than
the window is one window; an item with a null id marks words but is not
counted or listed.  Repeated documents are rows of their own; items with
equal ids count once.  Other columns of the inputs are not carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.llm.common import map_batches, text_rows
from cellframe.session import materialize

WINDOW = 13
BLOCK_CHARS = 6_000_000         # text of one block of the index
QUERY_BLOCK_CHARS = 16_000_000  # item text searched (and broadcast) at a time
# A-Z lower-cased; every character that is no word character becomes a space
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 0x80 else 32
              for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORD).split()


def pack(numbers: np.ndarray) -> bytes:
    """int32 numbers as differences, byte planes apart, compressed."""
    import zstandard
    steps = np.diff(numbers.astype(np.int32), prepend=np.int32(0))
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack(blob: bytes) -> np.ndarray:
    import zstandard
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    steps = np.ascontiguousarray(planes.reshape(4, -1).T).view(np.int32).ravel()
    return np.cumsum(steps, dtype=np.int32)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The stored index: block, ids, n_words (per document), terms, counts, postings."""
    from uuid import uuid4

    def fn(rb: pa.RecordBatch) -> dict:
        per_doc = [words_of(t) for t in rb.column(1).cast(pa.binary()).to_pylist()]
        sizes = np.array([len(w) for w in per_doc], np.int64)
        coded = pa.array([w for ws in per_doc for w in ws], pa.binary()).dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        counts = np.bincount(code, minlength=len(coded.dictionary))
        at = np.argsort(code, kind="stable")
        return {"block": [uuid4().hex], "ids": [rb.column(0).to_pylist()], "n_words": [sizes.tolist()],
                "terms": [b" ".join(coded.dictionary.to_pylist())], "counts": [pack(counts)], "postings": [pack(at)]}

    kind = docs.schema[id_col].dataType.simpleString()
    rows = map_batches(text_rows(docs, id_col, text_col), fn,
                       f"block string, ids array<{kind}>, n_words array<long>, terms binary, counts binary, "
                       "postings binary", max_chars=block_chars)
    return materialize(rows, "token-index")


class Block:
    """One row of the index, opened for search."""

    def __init__(self, n_words: list[int], terms: bytes, counts: bytes, postings: bytes):
        self.n_words = np.array(n_words, np.int64)
        self.ends = np.cumsum(self.n_words)
        self.starts = self.ends - self.n_words
        self.terms = pa.array(terms.split(), pa.binary())
        n = unpack(counts) if terms else np.zeros(0, np.int32)
        self.last = np.cumsum(n, dtype=np.int64)
        self.first = self.last - n
        self.at = unpack(postings) if terms else np.zeros(0, np.int32)

    def lists(self, vocabulary: pa.Array) -> list[np.ndarray | None]:
        """Postings of each query term, None where the block does not hold it."""
        where = pc.index_in(vocabulary, value_set=self.terms).to_pylist()
        return [None if i is None else self.at[self.first[i]:self.last[i]] for i in where]

    def phrase(self, lists: list[np.ndarray | None], terms: list[int], slop: int = 0) -> np.ndarray:
        """Positions in the block where the phrase begins (inside one document)."""
        held = [lists[t] for t in terms]
        if any(p is None for p in held):
            return np.zeros(0, np.int64)
        order = sorted(range(len(terms)), key=lambda o: len(held[o]))
        if slop:
            return self._near(held, terms, order, slop)
        begin = held[order[0]].astype(np.int64) - order[0]
        for o in order[1:]:
            p = held[o]
            i = np.searchsorted(p, begin + o)
            begin = begin[(i < len(p)) & (p[np.minimum(i, len(p) - 1)] <= begin + o)]
            if not len(begin):
                return begin
        begin = begin[begin >= 0]
        doc = np.searchsorted(self.ends, begin, "right")
        return begin[begin + len(terms) <= self.ends[np.minimum(doc, len(self.ends) - 1)]]


    def _near(self, held: list[np.ndarray], terms: list[int], order: list[int], slop: int) -> np.ndarray:
        """As ``phrase``; a term may lie up to ``slop`` words from its place, in the same document, each on a word of
        its own.  The rarest term lies at its place; the phrase's places lie in the document."""
        rarest = order[0]
        anchor = held[rarest].astype(np.int64)
        doc = np.searchsorted(self.ends, anchor, "right")
        low, high = self.starts[doc], self.ends[doc]
        ok = (anchor - rarest >= low) & (anchor - rarest + len(terms) <= high)
        anchor, low, high = anchor[ok], low[ok], high[ok]
        begin = anchor - rarest
        done: set[int] = set()
        for first in order:  # terms from the rarest on; the places of one term from left to right
            if terms[first] in done:
                continue
            done.add(terms[first])
            p = held[first].astype(np.int64)
            padded = np.append(p, [np.iinfo(np.int64).max] * 2)
            before = np.full(len(begin), -1, np.int64)
            ok = np.ones(len(begin), bool)
            for o in (o for o in range(len(terms)) if terms[o] == terms[first] and o != rarest):
                i = np.searchsorted(p, np.maximum(np.maximum(begin + o - slop, low), before + 1))
                if terms[rarest] == terms[first]:
                    i += padded[i] == anchor
                before = padded[i]
                ok &= before <= np.minimum(begin + o + slop, high - 1)
                before = np.where(ok, before, -1)
            begin, anchor, low, high = begin[ok], anchor[ok], low[ok], high[ok]
            if not len(begin):
                break
        return begin


def runs(begin: np.ndarray, size: np.ndarray) -> list[tuple[int, int]]:
    """Union of the intervals [begin, begin + size) as sorted disjoint intervals."""
    out: list[tuple[int, int]] = []
    for b, e in sorted(zip(begin.tolist(), (begin + size).tolist())):
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((b, e))
    return out


def search_block(block: Block, vocabulary: pa.Array, items: list[tuple[str | None, list[int]]],
                 window: int, slop: int) -> list[list[tuple]]:
    """Per document of the block: (item, start, end) of the words that the item's windows cover."""
    hits: list[list[tuple]] = [[] for _ in block.n_words]
    lists = block.lists(vocabulary)
    for item, terms in items:
        size = min(window, len(terms))
        absent = np.cumsum([0] + [lists[t] is None for t in terms])
        begin = [block.phrase(lists, terms[s:s + size], slop) for s in range(len(terms) - size + 1)
                 if absent[s] == absent[s + size]]
        found = np.concatenate(begin) if begin else np.zeros(0, np.int64)
        if not len(found):
            continue
        doc = np.searchsorted(block.ends, found, "right")
        for d in np.unique(doc).tolist():
            inside = found[doc == d] - block.starts[d]
            hits[d] += [(item, b, e) for b, e in runs(inside, np.full(len(inside), size))]
    return hits


def search(index: DataFrame, items: DataFrame, item_col: str = "item_id", text_col: str = "text",
           window: int = WINDOW, slop: int = 0, query_block_chars: int = QUERY_BLOCK_CHARS) -> DataFrame:
    """One row per indexed document: ``id``, ``n_words`` and ``hits`` (item, start, end), where an item's hits
    are the disjoint stretches of words (end exclusive) that occurrences of its windows cover."""
    spark = index.sparkSession
    item_text = F.col(text_col).cast("string")
    queries = items.select(F.col(item_col).cast("string").alias("item"), item_text.alias("text")).where(
        F.length(item_text) > 0)
    total = queries.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // query_block_chars))
    parts = [_search(spark, index, queries.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i)
                     if n > 1 else queries, window, slop) for i in range(n)]
    if n == 1:
        return parts[0].select("id", "n_words", "hits")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return (every.groupBy("block", "ord").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"),
                                             F.flatten(F.collect_list("hits")).alias("hits"))
            .select("id", "n_words", "hits"))


def _search(spark, index: DataFrame, queries: DataFrame, window: int, slop: int) -> DataFrame:
    numbers: dict[bytes, int] = {}
    held = []
    for r in queries.distinct().sort("item", "text").collect():  # at most a query block of text
        words = words_of(r["text"].encode())
        if words:
            held.append((r["item"], [numbers.setdefault(w, len(numbers)) for w in words]))
    shared = spark.sparkContext.broadcast((list(numbers), held))

    def fn(rb: pa.RecordBatch) -> dict:
        vocabulary, asked = pa.array(shared.value[0], pa.binary()), shared.value[1]
        out: dict[str, list] = {k: [] for k in ("block", "ord", "id", "n_words", "hits")}
        for r in rb.to_pylist():
            block = Block(r["n_words"], r["terms"], r["counts"], r["postings"])
            out["hits"] += search_block(block, vocabulary, asked, window, slop)
            out["block"] += [r["block"]] * len(r["ids"])
            out["ord"] += range(len(r["ids"]))
            out["id"] += r["ids"]
            out["n_words"] += r["n_words"]
        return out

    kind = index.schema["ids"].dataType.elementType.simpleString()
    columns = index.select("block", "postings", "ids", "n_words", "terms", "counts")
    return map_batches(columns, fn, f"block string, ord int, id {kind}, n_words long, "
                       "hits array<struct<item:string,start:int,end:int>>", max_chars=1)


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                  min_share: int = 20) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items (ids as sorted strings), hits, contaminated
    (a hit, and hits of at least 1 word in ``min_share``)."""
    found = search(build_index(docs, id_col, text_col), items, item_col, item_text_col, window)
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["end"] - 1))))
    ids = F.array_sort(F.array_distinct(F.filter(F.transform("hits", lambda h: h["item"]), lambda x: x.isNotNull())))
    return (found.withColumn("n_hit", F.size(covered).cast("long")).withColumn("items", ids)
            .withColumn("n_items", F.size("items").cast("long"))
            .withColumn("contaminated", (F.col("n_hit") > 0) & (min_share * F.col("n_hit") >= F.col("n_words")))
            .select(F.col("id").alias(id_col), "n_words", "n_hit", "n_items", "items", "hits", "contaminated"))
