"""Fill-in-the-middle transformation by secondary sort: pieces of whole units, sorted into place, digested as they stream by.

A text is cut into units (white space and the word after it; white space at the end is a unit of its own).  Two
hashed places split the units into prefix, middle and suffix, which are put out in another order behind the signs
``<P>``, ``<S>`` and ``<M>``:

* psm: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle,
* spm: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle,
* plain: the text as it is.

Steps, each a stream over sorted pieces of a few kilobytes, so no task ever holds a document:

1. every text is emitted as pieces of whole units, keyed by the document and the place in the *output*;
2. ``repartition(key).sortWithinPartitions(key, place)`` (``repartitionAndSortWithinPartitions`` for DataFrames) brings
   a document's pieces together in order; they run through one SHA-256 and through a reader that knows only the
   form and the signs and gives each piece its place in the *source* again;
3. a second sort inside the same partitions (no shuffle) puts the pieces in source order, and their SHA-256 is that
   of the restored text.

Defined results: a null text is an empty one (plain, no units); a null key counts as an empty word in the hash; rows
with equal key and text are worked once and returned as often as they occur; rows with equal keys and different
texts are different documents; an empty table gives no rows.  Only the key and the text are read, so other columns
cannot clash.  A unit is never cut, so the longest word of a text bounds a piece from below.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellframe.llm.common import map_batches, text_rows, to_arrow

SIGNS = {"P": b"<P>", "S": b"<S>", "M": b"<M>"}
ORDER = {"psm": "PSM", "spm": "SPM"}
SOURCE = {"P": 0, "M": 1, "S": 2}
PIECE_BYTES = 8_192
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_HEAD = "n long, form string, prefix_chars long, middle_chars long, copies long"


def unit_ends(text: bytes) -> np.ndarray:
    """The byte after each unit."""
    space = _SPACE[np.frombuffer(text, np.uint8)]
    ends = np.flatnonzero(~space & np.append(space[1:], True)) + 1
    return np.append(ends, len(text)) if len(text) and space[-1] else ends


def draws(key, seed: int) -> list[int]:
    """Four 32-bit numbers of a key."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[i:i + 8], 16) for i in (0, 8, 16, 24)]


def plan(key, text: bytes, ends: np.ndarray, seed: int, fim_percent: int, spm_percent: int) -> tuple[str, int, int]:
    """The form of a document and its two cuts, as numbers of units."""
    h1, h2, h3, h4 = draws(key, seed)
    a, b = sorted((h1 % (len(ends) + 1), h2 % (len(ends) + 1)))
    if not text or any(s in text for s in SIGNS.values()) or h3 % 100 >= fim_percent:
        return "plain", a, b
    return ("spm" if h4 % 100 < spm_percent else "psm"), a, b


def _chars(text: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def _chunks(text: bytes, ends: np.ndarray, first: int, last: int, size: int) -> list[bytes]:
    """Units ``first`` to ``last`` in pieces of whole units: as many as fit ``size`` bytes, one at least."""
    out, at = [], int(ends[first - 1]) if first else 0
    stop = int(ends[last - 1]) if last else 0
    while at < stop:
        to = int(ends[max(np.searchsorted(ends, at + size, "right") - 1, np.searchsorted(ends, at, "right"))])
        to = min(to, stop)
        out.append(text[at:to])
        at = to
    return out


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, fim_percent: int = 50,
           spm_percent: int = 80, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """The output of every document as pieces: ``_key, _row`` (a hash of the text), ``place`` (byte in the output),
    ``piece``, and the document's numbers on each of them."""
    rows = text_rows(docs, key, text)

    def cut(rb: pa.RecordBatch) -> dict:
        seen: dict[tuple, int] = {}
        texts = [t or b"" for t in rb.column(1).cast(pa.binary()).to_pylist()]
        for k, t in zip(rb.column(0).to_pylist(), texts):
            seen[k, t] = seen.get((k, t), 0) + 1
        out: dict[str, list] = {c: [] for c in ("_key", "_row", "place", "piece", "n", "form", "prefix_chars",
                                                "middle_chars", "copies")}
        for (k, t), copies in seen.items():
            ends = unit_ends(t)
            form, a, b = plan(k, t, ends, seed, fim_percent, spm_percent)
            if form == "plain":
                parts, numbers = _chunks(t, ends, 0, len(ends), piece_bytes) or [b""], (len(ends), form, None, None)
            else:
                split = {"P": (0, a), "M": (a, b), "S": (b, len(ends))}
                cuts = {s: _chunks(t, ends, *split[s], piece_bytes) for s in ORDER[form]}
                parts = [p for s in ORDER[form] for p in (SIGNS[s], *cuts[s])]
                numbers = (len(ends), form, sum(map(_chars, cuts["P"])), sum(map(_chars, cuts["M"])))
            row, place = xxhash.xxh3_128_digest(t), 0
            for p in parts:
                for c, v in zip(out, (k, row, place, p, *numbers, copies)):
                    out[c].append(v)
                place += len(p)
        return out

    return map_batches(rows, cut, T.StructType([
        T.StructField("_key", rows.schema["_key"].dataType),
        *T.StructType.fromDDL(f"_row binary, place long, piece binary, {_HEAD}").fields]))


class SourceReader:
    """Reads an output of a known form as it streams by: gives (segment, bytes) in the order of the output.

    Signs are looked for in the joined bytes, so it does not matter how the output was cut into pieces.
    """

    def __init__(self, form: str):
        self.awaited = list(ORDER.get(form, ""))
        self.segment = None if self.awaited else "P"
        self.held = b""

    def feed(self, data: bytes, last: bool = False) -> Iterator[tuple[str, bytes]]:
        data = self.held + data
        while self.awaited:
            at = data.find(SIGNS[self.awaited[0]])
            if at < 0:
                break
            if at and self.segment:
                yield self.segment, data[:at]
            self.segment, data = self.awaited.pop(0), data[at + 3:]
        # two bytes may be the beginning of the next sign
        keep = 2 if self.awaited and not last else 0
        self.held = data[len(data) - keep:] if keep else b""
        if self.segment and len(data) > keep:
            yield self.segment, data[:len(data) - keep]


def _runs(table: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, tuple]]:
    """All rows of sorted batches, each with the mark that a new document begins."""
    before = None
    for rb in table:
        for row in zip(*[c.to_pylist() for c in rb.columns]):
            new, before = row[:2] != before, row[:2]
            yield new, row


def _emit(schema: pa.Schema, rows: Iterator[tuple], max_bytes: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Record batches of rows, cut by the bytes that they hold."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + sum(len(v) for v in row if isinstance(v, (bytes, str)))
        if size > max_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, fim_percent: int = 50,
                   spm_percent: int = 80, texts: bool = True, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """One row per document: the key, ``n`` units, ``form``, ``prefix_chars`` and ``middle_chars`` (null if plain),
    ``output_sha256``, ``restored_sha256`` (of the text rebuilt from output and form), and with ``texts`` the
    ``output`` itself, which is then the only thing as long as a document that a task holds."""
    cut = pieces(docs, key, text, seed, fim_percent, spm_percent, piece_bytes)
    laid = cut.repartition("_key", "_row").sortWithinPartitions("_key", "_row", "place")
    mid = T.StructType([*laid.schema.fields, T.StructField("output_sha256", T.StringType()),
                        T.StructField("output", T.BinaryType())])
    mid_arrow = to_arrow(mid)

    def read_output(table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            head = None

            def placed(found):
                for segment, data in found:
                    yield (*head[:2], (SOURCE[segment] << 56) + offset[segment], data, *head[4:8], 0, None, None)
                    offset[segment] += len(data)

            def closing():
                yield from placed(reader.feed(b"", last=True))
                # the place before all others
                yield (*head[:2], -1, b"", *head[4:8], copies, digest.hexdigest(), b"".join(whole) if texts else None)

            for new, row in _runs(table):
                if new:
                    if head:
                        yield from closing()
                    head, copies, last, whole = row, 0, -1, []
                    digest, reader, offset = hashlib.sha256(), SourceReader(row[5]), dict.fromkeys(SOURCE, 0)
                if row[2] == 0:
                    copies += row[8]
                if row[2] == last:  # the same place of a repeated row
                    continue
                last = row[2]
                digest.update(row[3])
                if texts:
                    whole.append(row[3])
                yield from placed(reader.feed(row[3]))
            if head:
                yield from closing()

        yield from _emit(mid_arrow, rows())

    done = T.StructType([laid.schema["_key"], *T.StructType.fromDDL(
        "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string, "
        "output string").fields])
    done_arrow = to_arrow(done)

    def restore(table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            head = None
            for new, row in _runs(table):
                if new:
                    if head:
                        yield from closed(head, digest)
                    head, digest = row, hashlib.sha256()
                digest.update(row[3])
            if head:
                yield from closed(head, digest)

        def closed(head, digest):
            out = head[10].decode() if head[10] is not None else None
            for _ in range(head[8]):
                yield (head[0], *head[4:8], head[9], digest.hexdigest(), out)

        yield from _emit(done_arrow, rows())

    # the pieces of a document are still in one partition, so the second sort needs no shuffle
    restored = (laid.mapInArrow(read_output, mid).sortWithinPartitions("_key", "_row", "place")
                .mapInArrow(restore, done).withColumnRenamed("_key", key))
    return restored if texts else restored.drop("output")
