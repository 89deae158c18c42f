"""SentencePiece segmentations sampled from the piece lattice, and their lossless decoding.

A text with a space put before it is cut into words, each a run of spaces
and what follows up to the next space; no piece goes over such a cut, so the
lattice of the text is the chain of its words' lattices.  Nodes are byte
positions; an edge is a piece of the vocabulary, and each byte of a
character that has no piece of its own is an edge (byte fallback).

Forward filtering sums, for each node of the distinct words of a batch, the
weights of all paths that reach it.  Backward sampling starts at the end of every word and draws each edge
with its share of that sum, for all words of a batch at a time.  The random
numbers are a hash of the row key, the seed and the node's place in the
text, so a row's segmentation does not depend on batches or partitions.

A piece with merge rank r weighs (r + 2.7) ** -sharpness (the model file has
ranks, not probabilities); byte pieces weigh as the last rank.

Edge cases: a null text has null ids, an empty one no ids; null keys share
one stream of random numbers, as equal keys do; white space of any length,
U+2581 and any other character decode to themselves.  Rows are never merged.
Other columns are carried only if named in ``keep``.
"""

from __future__ import annotations

import re
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.llm.common import carried, map_batches, named, row_schema, text_rows

SHARPNESS, SEED = 1.0, 0
BATCH_BYTES = 2_500_000  # text whose words are one lattice job
KNOWN_BYTES = 3_000_000  # words whose lattices a worker may keep for its next batches (about 120 MB)


class Lattices:
    """The vocabulary of one model file and the lattices of words."""

    def __init__(self, path: str, sharpness: float):
        import ahocorasick
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * size
        self.byte_id = [0] * 256
        self.weight = np.zeros(size)
        self.ends = ahocorasick.Automaton()
        first = None
        for i in range(size):
            if model.is_byte(i):
                b = int(model.id_to_piece(i)[3:-1], 16)
                self.byte_id[b], self.bytes_of[i] = i, bytes([b])
                self.weight[i] = (size + 2.7) ** -sharpness
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                first = i if first is None else first
                self.bytes_of[i] = model.id_to_piece(i).replace("▁", " ").encode()
                self.weight[i] = (i - first + 2.7) ** -sharpness
                self.ends.add_word(self.bytes_of[i].decode("latin-1"), i)
        self.ends.make_automaton()
        self.size_of = np.array([len(b) for b in self.bytes_of], np.int32)
        self.log_weight = np.log(np.where(self.weight > 0, self.weight, 1.0))
        self.byte_id = np.array(self.byte_id, np.int32)
        self.known = Known()
        self.singles = {p for p in (b.decode() for b, w in zip(self.bytes_of[first:], self.weight[first:]) if w)
                        if len(p) == 1}

    def edges(self, joined: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(end, piece) of every edge in ``joined`` (words kept apart by 0xFF), by end and then by size, longest
        first."""
        found = np.fromiter(chain.from_iterable(self.ends.iter(joined.decode("latin-1"))), np.int32).reshape(-1, 2)
        end, piece = found[:, 0] + np.int32(1), found[:, 1].copy()
        del found
        strange = set(joined.replace(b"\xff", b"").decode()) - self.singles
        if strange:
            any_of = re.compile(b"|".join(re.escape(c.encode()) for c in sorted(strange)))
            spans = np.array([m.span() for m in any_of.finditer(joined)], np.int32)
            at = np.concatenate([np.arange(b, e) for b, e in spans]) if (np.diff(spans) > 1).any() else spans[:, 0]
            end = np.concatenate([end, (at + 1).astype(np.int32)])
            piece = np.concatenate([piece, self.byte_id[np.frombuffer(joined, np.uint8)[at]]])
            order = np.argsort(end, kind="stable")
            end, piece = end[order], piece[order]
        return end, piece

    def shares(self, end: np.ndarray, piece: np.ndarray, word_start: np.ndarray) -> np.ndarray:
        """Forward filtering: per edge the share of the paths to its end that use it or an edge before it.

        All words advance together, one byte position at a time; sums are kept as logarithms.
        """
        total = np.full(int(end[-1]) + 1, -np.inf)
        total[word_start] = 0.0
        start = end - self.size_of[piece]
        place = end - word_start[np.searchsorted(word_start, start, "right") - 1].astype(np.int32)
        order = np.argsort(place, kind="stable")
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(place[order])) + 1, [len(order)]])
        out = np.empty(len(end))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            e = order[lo:hi]
            node = end[e]
            head = np.flatnonzero(np.diff(node, prepend=-1))
            size = np.diff(np.append(head, len(e)))
            path = total[start[e]] + self.log_weight[piece[e]]
            top = np.maximum.reduceat(path, head)
            part = np.exp(path - np.repeat(top, size))
            whole = np.add.reduceat(part, head)
            total[node[head]] = top + np.log(whole)
            part = np.cumsum(part / np.repeat(whole, size))
            out[e] = part - np.repeat(part[head - 1] * (head > 0), size)
        return out


class Known:
    """Lattices of words met so far, one after another: ``ladder`` rises over all their edges (the end of an edge
    plus its share), ``first`` and ``last`` are the edges into each node."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.base = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ladder, self.pieces = np.zeros(0), np.zeros(0, np.int32)
        self.first, self.last, self.bytes = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def add(self, words: list[bytes], lattices: Lattices) -> None:
        joined = b"\xff".join(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        base = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        end, pieces = lattices.edges(joined)
        ladder = end + lattices.shares(end, pieces, base)
        last = np.searchsorted(end, np.arange(len(joined) + 1), "right") - 1
        first = np.concatenate([[0], last[:-1] + 1])
        edges = len(self.pieces)
        if not edges:  # nothing to join: no copies
            self.base, self.size, self.ladder, self.pieces, self.first, self.last = base, size, ladder, pieces, first, last
            self.bytes = len(joined) + 1
            return
        self.base = np.concatenate([self.base, base + self.bytes])
        self.size = np.concatenate([self.size, size])
        self.ladder = np.concatenate([self.ladder, ladder + self.bytes])
        self.pieces = np.concatenate([self.pieces, pieces])
        self.first = np.concatenate([self.first, first + edges])
        self.last = np.concatenate([self.last, last + edges])
        self.bytes += len(joined) + 1


def uniform(stream: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) that depend on the stream and the place alone (a 64-bit mixer over a counter)."""
    z = stream + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


def words_of(text: bytes) -> list[bytes]:
    """The text with a space before it, cut before every run of spaces."""
    parts = text.split(b" ")
    if b"" not in parts:
        return [b" " + p for p in parts]
    out, spaces = [], b""
    for p in parts:
        spaces += b" "
        if p:
            out.append(spaces + p)
            spaces = b""
    return out + [spaces] if spaces else out


def sample(texts: list[bytes], streams: np.ndarray, lattices: Lattices,
           known_bytes: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts after one another, number of ids of each text).

    Lattices of at most ``known_bytes`` of words are kept for the next call; before a call that finds more they are
    all let go.
    """
    known = lattices.known if known_bytes else Known()
    if known.bytes > known_bytes:
        known = lattices.known = Known()
    number, before = known.number, len(known.number)
    word_at, owner, begin = [], [], []
    for d, t in enumerate(texts):
        if t:
            words = words_of(t)
            word_at += [number.setdefault(w, len(number)) for w in words]
            owner.append(np.full(len(words), d, np.int64))
            begin.append(np.cumsum([0, *map(len, words[:-1])]))
    if not word_at:
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    word, owner, begin = np.array(word_at), np.concatenate(owner), np.concatenate(begin)
    if len(number) > before:
        known.add(list(islice(number, before, None)), lattices)
    base, size, ladder, pieces, first, last = (known.base, known.size, known.ladder, known.pieces, known.first, known.last)
    steps = lattices.size_of[pieces]
    # occurrences of a word lie side by side, so that the searches below go through the ladder in order
    order = np.argsort(word, kind="stable")
    word, owner_of, begin = word[order], owner[order], begin[order]
    at, active = size[word].copy(), np.arange(len(word))
    drawn, who = [], []
    while len(active):
        place = at[active]
        node = base[word[active]] + place
        u = uniform(streams[owner_of[active]], begin[active] + place)
        edge = np.clip(np.searchsorted(ladder, node + u, "right"), first[node], last[node])
        drawn.append(pieces[edge].astype(np.int32))
        who.append(active)
        at[active] = place - steps[edge]
        active = active[at[active] > 0]
    drawn_of = np.zeros(len(word), np.int64)
    for w in who:
        drawn_of[w] += 1
    n = np.empty_like(drawn_of)
    n[order] = drawn_of
    stop = np.cumsum(n)
    last_id = stop[order] - 1
    ids = np.empty(int(stop[-1]), np.int32)
    for step, (w, p) in enumerate(zip(who, drawn)):
        ids[last_id[w] - step] = p
    return ids, np.bincount(owner, n, len(texts)).astype(np.int64)


_LATTICES: dict[tuple, Lattices] = {}


def lattices_of(path: str, sharpness: float) -> Lattices:
    """One vocabulary per model file and Python worker."""
    if (path, sharpness) not in _LATTICES:
        _LATTICES[path, sharpness] = Lattices(path, sharpness)
    return _LATTICES[path, sharpness]


def decode(ids, lattices: Lattices) -> bytes:
    """The text of ids, without the space put before it."""
    return b"".join(map(lattices.bytes_of.__getitem__, ids))[1:]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED,
           sharpness: float = SHARPNESS, keep: tuple[str, ...] = (), known_bytes: int = 0) -> DataFrame:
    """One row per document: id, ``ids`` (the sampled pieces), ``n_pieces``, ``lossless`` (the ids decode to the
    text, checked in the task), and the columns in ``keep``.  ``known_bytes`` trades a worker's memory for time."""

    def fn(rb: pa.RecordBatch) -> dict:
        import xxhash
        lattices = lattices_of(path, sharpness)
        texts = rb.column(1).cast(pa.binary()).to_pylist()
        streams = np.array([xxhash.xxh64_intdigest(str(k), seed) for k in rb.column(0).to_pylist()], np.uint64)
        ids, n = sample([t or b"" for t in texts], streams, lattices, known_bytes)
        stop = np.cumsum(n)
        lossless = [decode(ids[e - k:e].tolist(), lattices) == (t or b"") for t, e, k in zip(texts, stop, n)]
        offsets = pa.array(np.concatenate([[0], stop]).astype(np.int32), pa.int32(),
                           mask=np.array([t is None for t in texts] + [False]))
        lists = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
        return carried(rb) | {"ids": lists, "n_pieces": n, "lossless": lossless}

    rows = text_rows(docs, id_col, text_col, keep)
    schema = row_schema(rows, "ids array<int>, n_pieces long, lossless boolean")
    return named(map_batches(rows, fn, schema, max_chars=BATCH_BYTES), id_col, keep)


def decode_rows(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and ``text`` again from the ids (null ids: null)."""

    def fn(rb: pa.RecordBatch) -> dict:
        lattices = lattices_of(path, SHARPNESS)
        return {"_key": rb.column(0),
                "text": [None if x is None else decode(x, lattices).decode() for x in rb.column(2).to_pylist()]}

    kind = rows.schema[id_col].dataType.simpleString()
    columns = rows.select(F.col(id_col).alias("_key"), F.repeat(F.lit("x"), F.greatest(F.size(ids_col), F.lit(0)))
                          .alias("_text"), F.col(ids_col))
    return map_batches(columns, fn, f"_key {kind}, text string").withColumnRenamed("_key", id_col)
