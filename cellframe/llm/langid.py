"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text accepts exactly the
substrings of that text.  A document is parsed greedily: from each place the
longest match with the labelled text is one phrase, and the next phrase
starts where it ends.  The language whose text needs the fewest phrases per
byte wins (ties: the language whose name sorts first).

Texts are lower-cased, everything but letters becomes one space.  Parsing is
vectorised over lanes: a text is cut into lanes of ``LANE`` bytes that are
parsed side by side as if a phrase began with each.  The phrase that crosses
into a lane is then carried on until it ends where that lane's own parse also
begins a phrase; from there on both are the same.  Lanes whose last phrase
changes by that pass it on to the next lane, until none changes, so the count
is that of one parse of the whole text, in bounded memory.

The automata are fitted on a bounded sample of labelled rows: at most
``max_rows`` documents a language in the order of a hash of the id, of each
at most ``max_chars`` characters (of longer ones a piece at a hashed place),
``fit_bytes`` bytes altogether, and no more than ``fit_total`` bytes for all
languages, which bounds the broadcast.

Edge cases: a null text or one without a letter gets ``und`` and score 0; with no labelled
text at all every document gets ``und``.  A text that shares no byte with
any language gets the first language and score 0.  Rows are never merged.
Other columns
of the input are carried only if named in ``keep``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellframe.llm.common import carried, map_batches, named, row_schema, text_rows

MAX_ROWS, MAX_CHARS, FIT_BYTES, FIT_TOTAL = 64, 8_000, 40_000, 1_000_000
LANE = 1024
LANES = 2048
LETTER = re.compile(r"[^\W\d_]")
_KEEP = bytes(c if 97 <= c <= 122 or c >= 0x80 else 32 for c in range(256))


def normal(text: str) -> bytes:
    return b" ".join(text.lower().encode().translate(_KEEP).split())


class Automaton:
    """A suffix automaton as a dense table: ``table[state * width + symbol]`` is the next state, 0 for none
    (no transition leads back to the start).  Symbols are the bytes seen, numbered from 1; 0 stands for the rest."""

    def __init__(self, text: bytes):
        step: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            cur = len(step)
            step.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in step[p]:
                step[p][c] = cur
                p = link[p]
            if p >= 0:
                q = step[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(step)
                    step.append(dict(step[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = link[cur] = clone
                    while p >= 0 and step[p].get(c) == q:
                        step[p][c] = clone
                        p = link[p]
            last = cur
        seen = sorted(set(text))
        self.symbol = np.zeros(256, np.int16)
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        self.width = len(seen) + 1
        table = np.zeros((len(step), self.width), np.int32)
        for s, out in enumerate(step):
            for c, t in out.items():
                table[s, self.symbol[c]] = t
        self.table = table.ravel()

    def starts(self, lanes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where phrases begin in each lane, and the state at its end; ``lanes`` is (step, lane) bytes, longest first.

        Where no match goes on, a phrase begins; an unknown symbol is a phrase of its own (state 0 after it).
        """
        symbols, table, width = self.symbol[lanes], self.table, self.width
        begins = np.zeros(lanes.shape, bool)
        state = np.zeros(lanes.shape[1], np.int32)
        live = np.searchsorted(-sizes, -np.arange(len(lanes)), "left")  # lanes longer than the step
        for i, n in enumerate(live):
            c = symbols[i, :n]
            nxt = table[state[:n] * width + c]
            dead = nxt == 0
            begins[i, :n] = dead | (state[:n] == 0)
            state[:n] = np.where(dead, table[c], nxt)
        return begins, state

    def carry(self, lanes: np.ndarray, sizes: np.ndarray, begins: np.ndarray, state: np.ndarray,
              end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that begin in each lane less those in ``begins``, if it is entered in ``state``; and its end state
        (``end``, where the two parses meet).  Arrays are (lane, step)."""
        change, out, state = np.zeros(len(lanes), np.int64), end.copy(), state.copy()
        at = np.arange(len(lanes))
        for i in range(lanes.shape[1]):
            over = sizes[at] <= i
            out[at[over]] = state[at[over]]
            at = at[~over]
            if not len(at):
                return change, out
            c = self.symbol[lanes[at, i]]
            nxt = self.table[state[at] * self.width + c]
            begin = (nxt == 0) | (state[at] == 0)
            apart = ~(begin & begins[at, i])
            change[at] += (begin.astype(np.int64) - begins[at, i]) * apart
            state[at] = np.where(nxt == 0, self.table[c], nxt)
            at = at[apart]
        out[at] = state[at]
        return change, out

    def phrases(self, lanes: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Phrases of each lane of whole texts; ``lanes`` is (lane, step), ``first`` marks where a text begins."""
        begins, end = np.zeros(lanes.shape, bool), np.zeros(len(lanes), np.int32)
        order = np.argsort(-sizes, kind="stable")
        for lo in range(0, len(order), LANES):
            group = order[lo:lo + LANES]
            part, end[group] = self.starts(lanes[group, :sizes[group[0]]].T, sizes[group])
            begins[group, :sizes[group[0]]] = part.T
        count, spare, alone = begins.sum(1), np.zeros(len(lanes), np.int64), end.copy()
        todo = np.flatnonzero(~first)
        todo = todo[end[todo - 1] != 0]  # otherwise a phrase does begin with the lane
        while len(todo):
            spare[todo], new = self.carry(lanes[todo], sizes[todo], begins[todo], end[todo - 1], alone[todo])
            moved = todo[new != end[todo]]
            end[todo] = new
            todo = moved[moved + 1 < len(lanes)] + 1
            todo = todo[~first[todo]]
        return count + spare


def parse_all(texts: list[bytes], automata: list[Automaton]) -> np.ndarray:
    """Phrases per text (rows) and language (columns), for whole texts of about ``LANES`` lanes at a time."""
    n_lanes = np.cumsum([0, *(max(1, -(-len(t) // LANE)) for t in texts)])
    out, lo = [np.zeros((0, len(automata)), np.int64)], 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(n_lanes, n_lanes[lo] + LANES, "right")) - 1)
        out.append(_parse(texts[lo:hi], automata))
        lo = hi
    return np.concatenate(out)


def _parse(texts: list[bytes], automata: list[Automaton]) -> np.ndarray:
    out = np.zeros((len(texts), len(automata)), np.int64)
    n_lanes = np.array([-(-len(t) // LANE) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), n_lanes)
    if not len(owner):
        return out
    lanes, sizes, first, at = np.zeros((len(owner), LANE), np.uint8), np.full(len(owner), LANE), np.zeros(len(owner), bool), 0
    flat = lanes.reshape(-1)
    for t, n in zip(texts, n_lanes.tolist()):
        if n:
            flat[at * LANE:at * LANE + len(t)] = np.frombuffer(t, np.uint8)
            first[at] = True
            at += n
            sizes[at - 1] = len(t) - (n - 1) * LANE
    for a, auto in enumerate(automata):
        np.add.at(out[:, a], owner, auto.phrases(lanes, sizes, first))
    return out


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS, fit_bytes: int = FIT_BYTES,
        fit_total: int = FIT_TOTAL) -> dict[str, Automaton]:
    """One automaton per language from the rows where ``learn`` holds; see the module's bounds."""
    text, letter = F.col(text_col).cast("string"), r"\p{L}"
    rows = (docs.where(learn & F.col(lang_col).isNotNull() & text.rlike(letter))
            .select(F.col(lang_col).cast("string").alias("lang"), text.alias("whole"),
                    F.xxhash64(F.col(id_col).cast("string")).alias("h")))
    place = F.pmod(F.xxhash64("h", F.lit("place")), F.greatest(F.lit(1), F.length("whole") - max_chars + 1)) + 1
    rows = rows.withColumn("text", F.substring("whole", place.cast("int"), F.lit(max_chars)))
    # a piece without a letter gives way to the one from the first letter on
    rows = rows.withColumn("text", F.when(F.col("text").rlike(letter), F.col("text")).otherwise(
        F.substring("whole", F.regexp_instr("whole", F.lit(letter)), F.lit(max_chars)))).drop("whole")
    order = Window.partitionBy("lang").orderBy("h", "text")
    few = rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= max_rows)
    found = few.sort("lang", "rn").collect()  # at most max_rows * max_chars characters a language
    room = min(fit_bytes, fit_total // max(1, len({r["lang"] for r in found})))
    held: dict[str, list[bytes]] = {}
    for r in found:
        got, part = held.setdefault(r["lang"], []), normal(r["text"])
        if not got or sum(map(len, got)) + len(part) <= room:
            got.append(part[:room])
    return {lang: Automaton(b" ".join(parts)) for lang, parts in sorted(held.items())}


def identify(docs: DataFrame, automata: dict[str, Automaton], id_col: str = "doc_id", text_col: str = "text",
             keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, ``lang_pred``, ``score`` (1 - fewest / second fewest phrases), ``phrases``
    (language -> phrases per byte), and the columns in ``keep``."""
    shared = docs.sparkSession.sparkContext.broadcast(automata)

    def fn(rb: pa.RecordBatch) -> dict:
        known = shared.value
        langs, texts = list(known), rb.column(1).to_pylist()
        pred, score, per = [], [], []
        norm = [normal(t) if t and LETTER.search(t) else b"" for t in texts]
        counts = parse_all(norm, list(known.values()))
        for t, c in zip(norm, counts):
            if not t or not langs:
                pred.append("und")
                score.append(0.0)
                per.append([])
                continue
            order = np.argsort(c, kind="stable")
            pred.append(langs[order[0]])
            second = c[order[1]] if len(langs) > 1 else len(t)
            score.append(float(1 - c[order[0]] / max(second, c[order[0]], 1)))
            per.append([(lang, n / len(t)) for lang, n in zip(langs, c.tolist())])
        return carried(rb) | {"lang_pred": pred, "score": score, "phrases": per}

    rows = text_rows(docs, id_col, text_col, keep)
    schema = row_schema(rows, "lang_pred string, score double, phrases map<string,double>")
    return named(map_batches(rows, fn, schema), id_col, keep)
