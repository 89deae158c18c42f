"""Exact token counts at every prefix, by dynamic programming over a byte-level BPE vocabulary.

The last token of a prefix's encoding is unique, and a token that ends
where the prefix ends is that last token if and only if it stays whole next
to the last token of what is left before it.  So for each place in a piece
(a pre-token) the tokens that end there are tried from the longest to the
shortest, and the count is one more than at the place where the token
begins.  A whole text's counts are the sums of its pieces' counts; a prefix
that ends in white space takes that white space as one piece, as the
tokenizer does.

``prefix_counts`` holds one number per code point: the count of the prefix
that ends there, as differences.  ``PrefixCounts`` answers how many tokens a
prefix has, and how far a text can go within a budget, without encoding
again.  The vocabulary file is a parameter and is read where the tasks run.

Special strings are one token where they are complete (the library's
default); a prefix that ends inside one is ordinary text.

Edge cases: a null text counts as empty (0 tokens, 0 bytes, no prefixes).
Rows are never merged; texts of any length are counted whole.  Other columns
of the input are not carried.
"""

from __future__ import annotations

import json
from array import array
from operator import sub

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.llm.common import map_batches, text_rows

# the byte-level pre-tokenizer's pattern (fixed value)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEVER = (1 << 60, -1)
MAX_PIECES, MAX_PAIRS = 600_000, 400_000  # cached words and token pairs of one Python worker


class Kept(dict):
    """A bounded cache: computes what is missing, starts again when full; long keys are not kept."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, key: str) -> bytes:
        found = self.compute(key)
        if len(key) <= 64:
            if len(self) >= MAX_PIECES:
                self.clear()
            self[key] = found
        return found


class PrefixCounter:
    """The counts of all prefixes of pieces and texts for one vocabulary file."""

    def __init__(self, path: str):
        import ahocorasick
        import regex
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("ignore_merges") or spec.get("normalizer"):
            raise ValueError("a byte-level BPE vocabulary without a normalizer is expected")
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) \
            if self.special else None
        self.pieces_of = regex.compile(PATTERN).findall
        self.run = regex.compile(r"\s{2,}").search
        self.spaces = regex.compile(r"\s{2,}").finditer
        to_byte = {c: bytes([b]) for b, c in byte_letters().items()}
        text = {b"".join(map(to_byte.__getitem__, t)).decode("latin-1"): i for t, i in model["vocab"].items()
                if t not in self.special}
        self.text = {i: t for t, i in text.items()}
        self.rank = {}
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            left, right = (text[b"".join(map(to_byte.__getitem__, x)).decode("latin-1")] for x in (a, b))
            self.rank.setdefault((left, right), (r, text[self.text[left] + self.text[right]]))
        self.single = {t: i for t, i in text.items() if len(t) == 1}
        self.ends = ahocorasick.Automaton()
        for t, i in text.items():
            self.ends.add_word(t, (len(t), i))
        self.ends.make_automaton()
        self.loose = regex.compile(r" \s|\s |^ | $").search
        self.between = regex.compile(r"(?<=\S) (?=\S)").split
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.spaced = Kept(lambda w: self.steps(" " + w))
        self.first = Kept(self.steps)

    def encode(self, left: int, right: int) -> bool:
        """Whether merging the bytes of two neighbouring tokens, lowest rank first, gives the two tokens again."""
        ids = [self.single[c] for c in self.text[left] + self.text[right]]
        rank = self.rank.get
        ranks = [rank(p, NEVER) for p in zip(ids, ids[1:])]
        while len(ids) > 2:
            best = min(ranks)
            if best is NEVER:
                return False
            k = ranks.index(best)
            ids[k:k + 2] = [best[1]]
            del ranks[k]
            if k:
                ranks[k - 1] = rank((ids[k - 1], ids[k]), NEVER)
            if k + 1 < len(ids):
                ranks[k] = rank((ids[k], ids[k + 1]), NEVER)
        return ids == [left, right] and (left, right) not in self.rank

    def stays(self, left: int, right: int) -> bool:
        """Whether the two tokens remain as they are when their text is encoded together."""
        key = left << 20 | right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self.encode(left, right)
        return found

    def byte_counts(self, piece: bytes) -> list[int]:
        """Tokens of every byte prefix of a piece (from the empty one)."""
        n = len(piece)
        count, last = [0] * (n + 1), [-1] * (n + 1)
        at, pairs = -1, self.pairs
        done = False
        for end, (size, token) in self.ends.iter(piece.decode("latin-1")):
            # matches come by their end, the longest first
            if end != at:
                at, done = end, False
            if done:
                continue
            start = end + 1 - size
            if start:
                left = last[start]
                ok = pairs.get(left << 20 | token)
                if ok is None:
                    ok = self.stays(left, token)
                if not ok:
                    continue
            count[end + 1], last[end + 1], done = count[start] + 1, token, True
        return count

    def piece(self, text: str) -> bytes:
        """int16 differences of the counts at the piece's code points."""
        found = self.known.get(text)
        if found is None:
            if len(self.known) >= MAX_PIECES // 4:
                self.known.clear()
            raw = text.encode()
            count = self.byte_counts(raw)
            if not text.isascii():  # only the counts where a code point ends
                count = [c for c, b in zip(count, raw) if b & 0xC0 != 0x80] + count[-1:]
            found = array("h", map(sub, count[1:], count)).tobytes()
            if len(text) <= 64:
                self.known[text] = found
        return found

    def ordinary(self, text: str) -> np.ndarray:
        """Counts at every code point of a text without special strings.

        A single space between other characters always begins a piece, so what lies between such spaces is
        counted on its own and kept.
        """
        words = self.between(text) if self.loose(text) else text.split(" ")
        steps = b"".join([self.first[words[0]], *map(self.spaced.__getitem__, words[1:])])
        return np.cumsum(np.frombuffer(steps, "<i2"), dtype=np.int32)

    def pieces(self, text: str) -> np.ndarray:
        """Counts at every code point of a stretch of text, piece by piece."""
        piece = self.piece
        pieces = self.pieces_of(text)
        steps = b"".join(map(piece, pieces))
        counts = np.cumsum(np.frombuffer(steps, "<i2"), dtype=np.int32)
        # a prefix that ends inside a run of white space takes the run so far as one piece, while in the longer
        # text the run's last code point belongs to the next piece
        for m in self.spaces(text):
            a, b = m.span()
            run = np.cumsum(np.frombuffer(piece(text[a:b]), "<i2"))
            counts[a:b] = (counts[a - 1] if a else 0) + run
        return counts

    def steps(self, text: str) -> bytes:
        found = self.pieces_of(text)
        if len(found) == 1:
            return self.piece(text)
        if not self.run(text):
            return b"".join(map(self.piece, found))
        return np.diff(self.pieces(text), prepend=0).astype("<i2").tobytes()

    def counts(self, text: str) -> np.ndarray:
        """Token count of the prefix that ends at each code point."""
        if self.cut is None or not self.cut.search(text):
            return self.ordinary(text)
        out, total, at = [], 0, 0
        for m in self.cut.finditer(text):
            segment = self.ordinary(text[at:m.end()]).copy()  # inside the special string: ordinary text
            whole = int(self.ordinary(text[at:m.start()])[-1]) if m.start() > at else 0
            segment[-1] = whole + 1
            out.append(total + segment)
            total += whole + 1
            at = m.end()
        if at < len(text):
            out.append(total + self.ordinary(text[at:]))
        return np.concatenate(out)


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 bytes stand for
    themselves, the others follow from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    out.update({b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in out)})
    return out


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter per vocabulary file and Python worker."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


class PrefixCounts:
    """Answers from the stored numbers of one text."""

    def __init__(self, prefix_counts: bytes):
        self.at = np.concatenate([[0], np.cumsum(np.frombuffer(prefix_counts, "<i2"), dtype=np.int64)])

    def tokens(self, chars: int | None = None) -> int:
        """Tokens of the first ``chars`` code points (of the whole text by default)."""
        return int(self.at[-1 if chars is None else chars])

    def truncate(self, budget: int) -> int:
        """The longest prefix, in code points, that has at most ``budget`` tokens."""
        return int(np.flatnonzero(self.at <= budget)[-1])


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 budget: int = 1024) -> DataFrame:
    """One row per document: id, ``n_bytes``, ``n_tokens``, ``over_limit`` (more than ``budget`` tokens), ``fits``
    (code points of the longest prefix within the budget), ``prefix_counts``."""

    def fn(rb: pa.RecordBatch) -> dict:
        count = counter(path).counts
        out: dict[str, list] = {k: [] for k in ("n_bytes", "n_tokens", "fits", "prefix_counts")}
        for text in rb.column(1).to_pylist():
            text = text or ""
            at = count(text) if text else np.zeros(0, np.int32)
            total = int(at[-1]) if text else 0
            out["n_bytes"].append(len(text.encode()))
            out["n_tokens"].append(total)
            out["fits"].append(len(text) if total <= budget else int(np.flatnonzero(at <= budget)[-1]) + 1
                               if (at <= budget).any() else 0)
            out["prefix_counts"].append(np.diff(at, prepend=0).astype("<i2").tobytes())
        return {"_key": rb.column(0)} | out

    kind = docs.schema[id_col].dataType.simpleString()
    rows = map_batches(text_rows(docs, id_col, text_col), fn,
                       f"_key {kind}, n_bytes long, n_tokens long, fits long, prefix_counts binary")
    return rows.withColumn("over_limit", F.col("n_tokens") > budget).withColumnRenamed("_key", id_col)
