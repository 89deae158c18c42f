"""Conversation repair: equal to a plain dynamic program, on one chunk and on many, hot conversations, ties, nulls."""

import hashlib
import itertools
import random
import re
import zlib
from functools import cache

import pytest

from cellframe.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, copies_of string, n long"
LEGAL = re.compile("(s?(ua)+)?")


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def brute_repair(rows):
    """All columns of one conversation from its rows (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:256],
                                       hashlib.sha256(r[2].encode()).digest()))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    faults, seen = [], set()
    for _, role, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not words else "duplicate" if (role, text) in seen
                      else "truncated" if words[-1] not in ".!?" else None)
        seen.add((role, text))
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    best = {(len(rows), "", 0): (0, "", ()), (len(rows), "a", 0): (0, "", ())}

    def at(i, state, inserts):
        if (i, state, inserts) in best:
            return best[i, state, inserts]
        options = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if inserts < 3:
            for role in ("user", "assistant"):
                if (state, role[0]) in after:
                    c, a, out = at(i, after[state, role[0]], inserts + 1)
                    options.append((c + 3, "I" + a, (f"{role}:",) + out))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, out = at(i + 1, state, 0)
            options.append((c + 4, "D" + a, out))
            if faults[i] not in ("blank", "duplicate"):
                extra = 3 * (faults[i] == "truncated")
                for new, letter, cost in ((role, "K", 0), ("user", "R", 3), ("assistant", "R", 3)):
                    if (state, new[:1]) in after:
                        c, a, out = at(i + 1, after[state, new[:1]], 0)
                        options.append((c + cost + extra, letter + a, (f"{new}:{text}",) + out))
        best[i, state, inserts] = min(options, default=(1 << 40, "~", ()), key=lambda o: o[:2])
        return best[i, state, inserts]

    for i in range(len(rows), -1, -1):  # from the end, so that the recursion stays flat
        for state in ("", "s", "u", "a"):
            for inserts in (3, 2, 1, 0):
                at(i, state, inserts)
    cost, audit, out = at(0, "", 0)
    assert LEGAL.fullmatch("".join(x[:1] for x in out))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(out).encode()).hexdigest())


def brute(rows, damaged=True):
    out = {}
    for conv in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == conv]
        out[conv] = brute_repair([r[1:] for r in (brute_damage(own) if damaged else own)])
    return out


def found(df):
    rows = df.collect()
    out = {r.conv_id: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(parts)


TEXTS = ["Yes.", "No", "", " \t", "Why?", "hm!", "é 漢", "a. b", "x" * 300 + "1.", "x" * 300 + "2.", None]


def conversations(seed, n, longest, roles=("user", "assistant", "system", "tool", "", None, "User")):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for i in range(rng.randint(1, longest)):
            role = rng.choice(roles) if rng.random() < 0.3 else ("user", "assistant")[i % 2]
            text = rng.choice(TEXTS) if rng.random() < 0.5 else f"text {rng.randrange(10**6)}{rng.choice('.!? ')}"
            turn = None if rng.random() < 0.05 else i + (rng.random() < 0.1) * rng.randint(-2, 5)
            rows.append((None if c == 3 else c, turn, role, text))
    return rows + rows[:5] + [(77_777, None, None, None), (77_778, 0, "user", "Hello.")]


@pytest.mark.parametrize("chunk_rows,max_passes", [(4096, 16), (3, 16), (2, 1), (1, 0)])
def test_equal_to_plain_program(spark, chunk_rows, max_passes):
    rows = conversations(1, 60, 25)
    parts = C.repair(C.damage(frame(spark, rows)), copies="copies", chunk_rows=chunk_rows, max_passes=max_passes)
    assert found(C.digest(parts)) == brute(rows)


@pytest.mark.parametrize("max_passes", [200, 2])
def test_one_hot_conversation_that_never_converges(spark, max_passes):
    # only truncated rows of a foreign role: every row goes, and the vectors of two starts stay apart
    rows = [(1, i, "tool", f"cut {i}") for i in range(300)] + [(1, 300, "user", "Hi."), (1, 301, "assistant", "Yes.")]
    rows += [(2, i, ("user", "assistant")[i % 2], f"fine {i}.") for i in range(200)]
    rows += [(3, i, "user", "same.") for i in range(400)] + [(3, 7, "user", "same.")] * 50
    parts = C.repair(frame(spark, rows), chunk_rows=20, max_passes=max_passes)
    assert found(C.digest(parts)) == brute(rows, damaged=False)


def test_repeats_do_not_move_vectors(spark):
    rows = [(1, i, "user", "same.") for i in range(2_000)]
    df = C._counted(frame(spark, rows), "conv_id", "turn", "role", "text", None)
    chunks = C._packed(df, 10, 1 << 18).where("not whole")
    assert C._stitched(chunks, 50)[1] <= 3 + chunks.count()
    assert found(C.digest(C.repair(frame(spark, rows), chunk_rows=10))) == brute(rows, damaged=False)


def test_dropped_rows_leave_the_conversation(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = found(C.digest(C.repair(C.damage(frame(spark, [(conv, 0, "user", "Hi.")])), copies="copies")))
    assert got == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert C.digest(C.repair(C.damage(df), copies="copies")).collect() == []


def test_vectors_are_few_and_speculation_converges():
    """From any start the same row of true vectors is met, up to constants, and there are few vectors."""
    seen, todo = {C.END, C.GUESS}, [C.END, C.GUESS]
    while todo:
        v = todo.pop()
        for code in range(8):
            w = C.plain(C.step_back(v, code))
            if w not in seen:
                seen.add(w)
                todo.append(w)
    assert len(seen) < 500
    r, rng = C.Repairer(), random.Random(4)
    symbols = bytes(rng.choice([0, 1, 2, 1, 2, 3, 5, 6, 8]) for _ in range(300))
    want = r.begin(symbols, C.END)
    assert r.fix_up(symbols, C.GUESS, C.END, r.begin(symbols, C.GUESS)) == want


def test_unit_vectors_compose():
    r, rng = C.Repairer(), random.Random(9)
    for _ in range(50):
        symbols = bytes(rng.choice(range(9)) for _ in range(rng.randint(0, 12)))
        for end in itertools.product((0, 2, 3), repeat=4):
            end = C.plain(C._with_inserts(list(end)))
            columns = []
            for s in range(4):
                v = C._with_inserts([0 if i == s else C._FAR for i in range(4)])
                for code in reversed(symbols):
                    v = C.step_back(v, code)
                columns.append(v)
            composed = C.plain(tuple(min(end[s] + columns[s][i] for s in range(4)) for i in range(4)))
            assert composed == r.begin(symbols, end)


def test_parts_hold_the_repaired_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "More."), (1, 2, "assistant", "Yes.")]
    parts = C.repair(frame(spark, rows)).orderBy("part", "seq").collect()
    assert "".join(p.audit for p in parts) == "KIKK"
    assert "\n".join(p.repaired for p in parts if p.n_repaired) == "user:Hi.\nassistant:\nuser:More.\nassistant:Yes."
