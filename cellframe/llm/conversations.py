"""Conversation repair by parallel Viterbi with rank convergence.

A conversation is legal if its roles' initials are ``(s?(ua)+)?``.  Rows may be kept (0), given the role user or
assistant (3), deleted (4) or inserted with an empty text (3); blank rows and repeats of an earlier role and text must
go, and a truncated row that stays costs 3 more.  The cheapest edits are found from the end: a vector holds the cost
to finish from each of four states (nothing yet, after s, after u, after a).  Its differences are bounded, so up to a
constant there are few vectors, and a row moves one vector to another by a small table.

1. Equal rows are counted first, and a minimum over (conversation, role, text) tells the first of each text.  Then all
   rows are laid out by range of (conversation, turn, ...), so a hot conversation spreads over many tasks.
2. Each task cuts its sorted rows into chunks.  A conversation that lies inside one task and fits a chunk is repaired
   on the spot.  The others' chunks are written.
3. Each such chunk is run backward from a speculative vector (the last one from the true end).  Fix-up passes rerun
   chunks whose following chunk begins with another vector than assumed, and stop inside a chunk as soon as the old
   and the new vector differ only by a constant.  When no chunk changes, all vectors are right up to constants.
   Chunks that still change after ``max_passes`` are closed exactly: each gives its four unit vectors, and these
   are composed in one stream.  Rows that must go do not move a vector, so they are never a reason for passes.
4. The stitched vectors drive the tracing: from each state the ASCII-least letter on a cheapest path leads to one
   state.  Every chunk is traced from all four states, the states are passed along the chunks, and the right trace
   makes the repaired rows.

Defined results: null roles and texts are one space; rows lie by turn (nulls first), rows of one turn by role, the
first 256 characters and the hash of the text; equal rows lie side by side.  A role whose initial is not s, u or a (or
that is empty) cannot be kept.  A null conversation id is a conversation like any other.  A conversation without rows
(``copies`` 0) has an empty repair; an empty table gives no rows.  Turns are read as long.  Only the four named columns
and ``copies`` are read, so others cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellframe.llm.common import to_arrow
from cellframe.session import ensure_checkpoint_dir, materialize

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
FORCED = 8
CHUNK_ROWS = 4_096
CHUNK_BYTES = 1 << 18
_CLASS = {"s": 0, "u": 1, "a": 2}
_LEGAL = {"su", "ua", "au"}
_FAR = 1 << 50
# the state after each initial class (s, u, a) from each state, or None
_NEXT = ((1, 2, None), (None, 2, None), (None, None, 3), (None, 2, None))
END = (0, 6, 3, 0)
GUESS = (0, 0, 0, 0)


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Damage conversations in a fixed way for trials; adds ``copies`` (0: the row is dropped).

    By the crc32 of ``conv:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 takes out ``.!?``, 3 repeats it, 4
    makes its role user.
    """
    def word(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(word(conv), F.lit(":"), word(turn)).cast("binary")) % 20
    text, role = word("text"), word("role")
    return rows.select(
        F.col(conv), F.col(turn), F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def step_back(after: tuple, code: int) -> tuple:
    """Costs to finish before a row from the costs after it (``code``: initial class, plus 4 if truncated)."""
    kind, extra = code & 3, TRUNCATED if code & 4 else 0
    base = []
    for s, c in enumerate(after):
        best = DELETE + c
        if code != FORCED:
            stay = _NEXT[s][kind] if kind < 3 else None
            if stay is not None:
                best = min(best, KEEP + extra + after[stay])
            to = _NEXT[s][2 if s == 2 else 1]
            best = min(best, REROLE + extra + after[to])
        base.append(best)
    return _with_inserts(base)


def _with_inserts(base: list[int]) -> tuple:
    u = min(base[2], INSERT + base[3])
    a = min(base[3], INSERT + u)
    return min(base[0], INSERT + u), min(base[1], INSERT + u), u, a


def plain(vector: tuple) -> tuple:
    """A vector without its constant."""
    return tuple(c - vector[3] for c in vector)


class Repairer:
    """Tables of moves between vectors, filled as they are met."""

    def __init__(self):
        self.back: dict[tuple, tuple] = {}
        self.moves: dict[tuple, tuple] = {}

    def vectors(self, symbols: bytes, end: tuple) -> list[tuple]:
        """The vector (without constant) at every place of a chunk."""
        out, v, back = [end], end, self.back
        for code in reversed(symbols):
            if code != FORCED:
                w = back.get((v, code))
                if w is None:
                    w = back[v, code] = plain(step_back(v, code))
                v = w
            out.append(v)
        out.reverse()
        return out

    def begin(self, symbols: bytes, end: tuple) -> tuple:
        return self.vectors(symbols, end)[0]

    def fix_up(self, symbols: bytes, old_end: tuple, new_end: tuple, old_begin: tuple) -> tuple:
        """The chunk's first vector from a new end; ends early where old and new differ only by a constant."""
        a, b, back = old_end, new_end, self.back
        for code in reversed(symbols):
            if a == b:
                return old_begin
            if code == FORCED:
                continue
            for v in (a, b):
                if (v, code) not in back:
                    back[v, code] = plain(step_back(v, code))
            a, b = back[a, code], back[b, code]
        return b

    def _moves(self, after: tuple, code: int) -> tuple:
        """For each state: the letters of the least cheapest edits up to and with a row, the state after, the cost."""
        found = self.moves.get((after, code))
        if found is None:
            here = step_back(after, code)
            out = []
            for s in range(4):
                letters, cost = "", 0
                kind, extra = code & 3, TRUNCATED if code & 4 else 0
                while True:
                    move = 2 if s == 2 else 1  # the role that may follow: assistant after user, else user
                    to = _NEXT[s][move]
                    if here[s] == DELETE + after[s]:
                        letters, cost, end = letters + "D", cost + DELETE, s
                        break
                    if here[s] == INSERT + here[to]:
                        letters, cost, s = letters + "I", cost + INSERT, to
                        continue
                    stay = _NEXT[s][kind] if kind < 3 and code != FORCED else None
                    if stay is not None and here[s] == KEEP + extra + after[stay]:
                        letters, cost, end = letters + "K", cost + KEEP + extra, stay
                        break
                    letters, cost, end = letters + "R", cost + REROLE + extra, to
                    break
                out.append((letters, end, cost))
            found = self.moves[after, code] = tuple(out)
        return found

    def trace(self, symbols: bytes, vectors: list[tuple], state: int, last: bool) -> tuple[str, int, int]:
        """The audit of a chunk from a state, the state after it, and the cost."""
        letters, cost = [], 0
        for i, code in enumerate(symbols):
            if code == FORCED:
                letters.append("D")
                cost += DELETE
            else:
                more, state, paid = self._moves(vectors[i + 1], code)[state]
                letters.append(more)
                cost += paid
        if last:
            added = {0: 0, 3: 0, 2: 1, 1: 2}[state]
            letters.append("I" * added)
            cost += INSERT * added
        return "".join(letters), state, cost


def repaired_rows(audit: str, state: int, kept: list[tuple[str, str]]) -> list[str]:
    """The rows ``role:text`` after the edits of an audit; ``kept`` are the rows that need not go, in order.

    Which D removes one of them is told by ``symbols`` in ``_finish``; here every D has been resolved to its row.
    """
    out, rows = [], iter(kept)
    for letter in audit:
        if letter == "I":
            out.append("assistant:" if state == 2 else "user:")
            state = 3 if state == 2 else 2
            continue
        row = next(rows)
        if letter == "D":
            continue
        role, text = row
        if letter == "R":
            role = "assistant" if state == 2 else "user"
            state = 3 if state == 2 else 2
        else:
            state = _NEXT[state][_CLASS[role[0]]]
        out.append(f"{role}:{text}")
    return out


_COUNTS = ("n_rows", "blank", "duplicate", "truncated", "illegal", "distinct_turns")
_PIECE = ("part long, seq long, whole boolean, symbols binary, roles array<string>, texts array<string>, "
          + ", ".join(f"{c} long" for c in _COUNTS)
          + ", first_turn long, last_turn long, first_initial string, last_initial string, audit string, cost long, "
            "n_repaired long, repaired string")


class _Chunk:
    """Rows of a conversation that are being put together."""

    def __init__(self):
        self.symbols, self.roles, self.texts, self.bytes = bytearray(), [], [], 0
        self.open_rows = 0
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.turns, self.initials = [None, None], [None, None]

    def add(self, turn: int | None, role: str, text: str, n: int, first: bool) -> None:
        c = self.counts
        initial = role[:1]
        c["illegal"] += (n - 1) * (initial * 2 not in _LEGAL)
        if self.initials[0] is None:
            self.initials[0] = initial
        else:
            c["illegal"] += self.initials[1] + initial not in _LEGAL
        self.initials[1] = initial
        if turn is not None:
            c["distinct_turns"] += turn != self.turns[1]
            self.turns = [turn if self.turns[0] is None else self.turns[0], turn]
        c["n_rows"] += n
        words = text.rstrip(" \t\n\x0b\x0c\r")
        if not words:
            c["blank"] += n
            self.symbols += bytes([FORCED]) * n
            return
        c["duplicate"] += n - first
        if first:
            cut = words[-1] not in ".!?"
            c["truncated"] += cut
            self.symbols.append(_CLASS.get(initial, 3) + 4 * cut)
            self.roles.append(role)
            self.texts.append(text)
            self.bytes += len(role) + len(text)
            self.open_rows += 1
        self.symbols += bytes([FORCED]) * (n - first)

    def full(self, rows: int, size: int) -> bool:
        return self.open_rows >= rows or self.bytes >= size or len(self.symbols) >= 16 * rows


def _finish(repairer: Repairer, symbols: bytes, roles: list, texts: list, end: tuple, state: int, last: bool) -> tuple:
    """Audit, cost, number of repaired rows and their text."""
    audit, _, cost = repairer.trace(symbols, repairer.vectors(symbols, end), state, last)
    # the rows that must go have no text: put them in their places
    rows, free = [], iter(zip(roles, texts))
    for code in symbols:
        rows.append(next(free) if code != FORCED else ("", ""))
    out = repaired_rows(audit, state, rows)
    return audit, cost, len(out), "\n".join(out)


def _bytes(value) -> int:
    return sum(map(_bytes, value)) if isinstance(value, list) else len(value) if isinstance(value, (bytes, str)) else 8


def _batches(schema: pa.Schema, rows: Iterator[tuple], max_bytes: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 300 + sum(map(_bytes, row))
        if size > max_bytes:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _rows_of(table: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for rb in table:
        # slices bound the Python objects alive at a time
        for at in range(0, rb.num_rows, 256):
            yield from zip(*[c.to_pylist() for c in rb.slice(at, 256).columns])


def _stream(df: DataFrame, schema: str | T.StructType, fn) -> DataFrame:
    """``mapInArrow`` of a function from rows to rows."""
    ensure_checkpoint_dir(df.sparkSession)
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow(fields)
    return df.mapInArrow(lambda table: _batches(arrow, fn(_rows_of(table))), fields)


def _counted(rows: DataFrame, conv: str, turn: str, role: str, text: str, copies: str | None) -> DataFrame:
    """Distinct rows with their number and whether they are the first of their role and text."""
    n = F.col(copies).cast("long") if copies else F.lit(1).cast("long")
    here = n > 0
    own = rows.select(
        F.col(conv).alias("conv"),
        F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("")).alias("ck"),
        (here & F.col(turn).isNotNull()).cast("int").alias("tn"),
        F.when(here, F.coalesce(F.col(turn).cast("long"), F.lit(0))).otherwise(0).alias("t"),
        F.when(here, F.coalesce(F.col(role).cast("string"), F.lit(" "))).otherwise("").alias("role"),
        F.when(here, F.coalesce(F.col(text).cast("string"), F.lit(" "))).otherwise("").alias("text"), n.alias("n"))
    own = own.withColumn("h", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    key = ["ck", "tn", "t", "role", "h"]
    distinct = own.groupBy(*key).agg(F.sum("n").alias("n"), F.first("text").alias("text"), F.first("conv").alias("conv"))
    first = (own.where("n > 0").groupBy("ck", "role", "h").agg(F.min(F.struct("tn", "t")).alias("m"))
             .select("ck", F.col("m.tn").alias("tn"), F.col("m.t").alias("t"), "role", "h", F.lit(True).alias("first")))
    # unique on both sides, on the columns that the rows are already dealt by
    return distinct.join(first, key, "left").withColumn("first", F.coalesce("first", F.lit(False)))


def _packed(rows: DataFrame, chunk_rows: int, chunk_bytes: int) -> DataFrame:
    """Conversations inside one task repaired, and chunks of the others (``whole`` tells them apart), written."""
    near = F.substring("text", 1, 256)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["ck", "tn", "t", "role", "near", "h"]
    laid = (rows.withColumn("near", near).repartitionByRange(parts, *order).sortWithinPartitions(*order)
            .select("conv", "ck", "tn", "t", "role", "text", "n", "first", F.spark_partition_id().alias("part")))
    schema = T.StructType([rows.schema["conv"], *T.StructType.fromDDL("ck string, " + _PIECE).fields])

    def run(found: Iterator[tuple]) -> Iterator[tuple]:
        # seq numbers the chunks of a task, so (part, seq) names one; begun: the conversation's first chunk in the task
        repairer, at, chunk, seq, begun, inner, part = Repairer(), None, None, 0, 0, False, 0

        def row(whole: bool) -> tuple:
            c = chunk
            done = ([], [], *c.counts.values(), *c.turns, *c.initials,
                    *_finish(repairer, bytes(c.symbols), c.roles, c.texts, END, 0, True)) if whole else (
                c.roles, c.texts, *c.counts.values(), *c.turns, *c.initials, None, None, None, None)
            return (*at, part, seq, whole, bytes(c.symbols) if not whole else b"", *done)

        for conv, ck, tn, t, role, text, n, first, part in found:
            if at is None or ck != at[1]:
                if at is not None:
                    yield row(inner and seq == begun)
                    seq += 1
                # the first conversation of a task may have begun in the task before
                inner, at, chunk, begun = at is not None, (conv, ck), _Chunk(), seq
            elif chunk.full(chunk_rows, chunk_bytes):
                yield row(False)
                chunk, seq = _Chunk(), seq + 1
            if n:
                chunk.add(t if tn else None, role, text, n, first)
        if at is not None:
            # the last one may go on in the next task
            yield row(False)

    return materialize(_stream(laid, schema, run), "conversations")


_CHAIN = "ck string, part long, seq long, symbols binary, last boolean, end array<long>, begin array<long>, moved boolean"


def _stitched(chunks: DataFrame, max_passes: int) -> tuple[DataFrame, int]:
    """Each open chunk with the vector after it, right up to a constant; and the number of passes."""
    along = Window.partitionBy("ck").orderBy("part", "seq")
    start = chunks.select("ck", "part", "seq", "symbols", F.lead("seq").over(along).isNull().alias("last"))

    def speculate(found):
        repairer = Repairer()
        for ck, part, seq, symbols, last in found:
            end = END if last else GUESS
            yield ck, part, seq, symbols, last, list(end), list(repairer.begin(symbols, end)), not last

    def fix(found):
        repairer = Repairer()
        for ck, part, seq, symbols, last, end, begin, _, after in found:
            moved = not last and after != end
            if moved:
                begin = list(repairer.fix_up(symbols, tuple(end), tuple(after), tuple(begin)))
                end = after
            yield ck, part, seq, symbols, last, end, begin, moved

    state = materialize(_stream(start, _CHAIN, speculate), "chain")
    passes, moved = 0, state.where("moved").limit(1).count()
    while moved and passes < max_passes:
        passes += 1
        state = materialize(_stream(state.withColumn("after", F.lead("begin").over(along)), _CHAIN, fix), "chain")
        moved = state.where("moved").limit(1).count()
    return (_composed(state) if moved else state), passes


def _composed(state: DataFrame) -> DataFrame:
    """The vectors after all chunks from the chunks' unit vectors, composed from the end in one stream."""
    def units(found):
        for ck, part, seq, symbols, last, *_ in found:
            columns = []
            for s in range(4):
                v = _with_inserts([0 if i == s else _FAR for i in range(4)])
                for code in reversed(symbols):
                    v = step_back(v, code)
                columns.append(v)
            yield ck, part, seq, symbols, last, [c for v in columns for c in v]

    def compose(found):
        at, v = None, END
        for ck, part, seq, symbols, last, flat in found:
            v, at = v if ck == at else END, ck
            end = v
            v = plain(tuple(min(v[s] + flat[4 * s + i] for s in range(4)) for i in range(4)))
            yield ck, part, seq, symbols, last, list(end), list(v), False

    mapped = _stream(state, "ck string, part long, seq long, symbols binary, last boolean, unit array<long>", units)
    return _stream(mapped.repartition("ck").sortWithinPartitions("ck", F.desc("part"), F.desc("seq")), _CHAIN, compose)


def _entries(state: DataFrame) -> DataFrame:
    """The state in which the cheapest edits enter each chunk: all four are traced, then passed along."""
    def maps(found):
        repairer = Repairer()
        for ck, part, seq, symbols, last, end, *_ in found:
            vectors = repairer.vectors(symbols, tuple(end))
            yield ck, part, seq, last, end, [repairer.trace(symbols, vectors, s, False)[1] for s in range(4)]

    def follow(found):
        at, s = None, 0
        for ck, part, seq, last, end, to in found:
            s, at = s if ck == at else 0, ck
            yield part, seq, last, end, s
            s = to[s]

    mapped = _stream(state, "ck string, part long, seq long, last boolean, end array<long>, to array<int>", maps)
    return _stream(mapped.repartition("ck").sortWithinPartitions("ck", "part", "seq"),
                   "part long, seq long, last boolean, end array<long>, entry int", follow)


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           copies: str | None = None, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES,
           max_passes: int = 16) -> DataFrame:
    """The repaired conversations in parts: the conversation, ``part, seq`` (their order), counts of the damage,
    ``audit, cost, n_repaired`` and ``repaired`` (``role:text``, joined by newlines).  Most have one part."""
    packed = _packed(_counted(rows, conv, turn, role, text, copies), chunk_rows, chunk_bytes)
    open_chunks = packed.where("not whole").drop("audit", "cost", "n_repaired", "repaired")
    state, _ = _stitched(open_chunks, max_passes)
    # a key of both, so that no name is there twice
    entered = _entries(state).select(F.struct("part", "seq").alias("id"), "last", "end", "entry")
    ready = open_chunks.join(entered, F.struct("part", "seq") == F.col("id")).drop("id")
    names = ready.columns

    def finish(found):
        repairer = Repairer()
        for values in found:
            r = dict(zip(names, values))
            done = _finish(repairer, r["symbols"], r["roles"], r["texts"], tuple(r["end"]), r["entry"], r["last"])
            yield (*[r[c] for c in out.names[:-4]], *done)

    drop = ("symbols", "roles", "texts")
    out = T.StructType([f for f in packed.schema if f.name not in drop])
    parts = packed.where("whole").drop(*drop).unionByName(_stream(ready, out, finish))
    return parts.withColumnRenamed("conv", conv)


def _turns(first, last, distinct):
    return F.coalesce(last - first + 1 - distinct, F.lit(0))


def digest(parts: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row per conversation: gaps, counts, cost, audit and the SHA-256 of the repaired rows.

    Conversations of one part are hashed where they are; the parts of others are streamed in order.
    """
    one = parts.where("whole").select(
        conv, _turns(F.col("first_turn"), F.col("last_turn"), F.col("distinct_turns")).alias("gaps"), "blank",
        "duplicate", "truncated", "illegal", "cost", "audit",
        F.sha2(F.col("repaired").cast("binary"), 256).alias("repaired_sha256"))
    cols = [conv, "ck", *_COUNTS, "first_turn", "last_turn", "first_initial", "last_initial", "audit", "cost",
            "n_repaired", "repaired"]
    several = parts.where("not whole").repartition("ck").sortWithinPartitions("ck", "part", "seq").select(*cols)

    def join(found):
        at = total = None

        def row():
            low, high = total["turns"]
            gaps = 0 if low is None else high - low + 1 - total["distinct_turns"]
            return (total["conv"], gaps, *[total[c] for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
                    "".join(total["audit"]), total["sha"].hexdigest())

        for values in found:
            r = dict(zip(cols[1:], values[1:]))
            if r["ck"] != at:
                if at is not None:
                    yield row()
                at = r["ck"]
                total = {"conv": values[0], "turns": [None, None], "initial": None, "audit": [], "sha": hashlib.sha256(),
                         "any": False, "cost": 0, **dict.fromkeys(_COUNTS, 0)}
            for c in (*_COUNTS, "cost"):
                total[c] += r[c]
            if r["first_initial"] is not None:
                total["illegal"] += total["initial"] is not None and total["initial"] + r["first_initial"] not in _LEGAL
                total["initial"] = r["last_initial"]
            if r["first_turn"] is not None:
                low, high = total["turns"]
                total["distinct_turns"] -= high == r["first_turn"]
                total["turns"] = [r["first_turn"] if low is None else low, r["last_turn"]]
            total["audit"].append(r["audit"])
            if r["n_repaired"]:
                total["sha"].update((b"\n" if total["any"] else b"") + r["repaired"].encode())
                total["any"] = True
        if at is not None:
            yield row()

    return one.unionByName(_stream(several, one.schema, join))
