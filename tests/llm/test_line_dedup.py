"""Line dedup: equal to brute force on both ways (broadcast and shuffled), filters without misses, hot lines."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from cellframe.llm.common import text_rows
from cellframe.llm.line_dedup import Suspects, TwiceSeen, line_dedup, line_keys, repeated_lines, shard_of

STRIP = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(STRIP))


def brute(rows, min_docs, min_chars=1, keep="none"):
    docs, first = defaultdict(set), {}
    for r, (doc, text) in enumerate(rows):
        row = xxhash.xxh3_128_digest((text or "").encode())
        for i, line in enumerate((text or "").split("\n")):
            k = key_of(line)
            docs[k].add(r)
            place = ((doc is not None, doc), row, i)
            first[k] = min(first.get(k, place), place)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        row = xxhash.xxh3_128_digest((text or "").encode())
        stay = [x for i, x in enumerate(lines)
                if len(key_of(x)) < max(1, min_chars) or len(docs[key_of(x)]) < min_docs
                or keep == "first" and first[key_of(x)] == ((doc is not None, doc), row, i)]
        out.append((doc, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return Counter(out)


def found(df):
    return Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in df.collect())


@pytest.fixture(scope="module")
def lined(spark):
    rng = random.Random(3)
    often = [f"  Often Seen line {i}\t" for i in range(30)]
    rows = [(i, "\n".join(rng.choice(often) if rng.random() < 0.3 else f"own {rng.randrange(300)} É{i % 7}"
                          for _ in range(rng.randint(1, 30)))) for i in range(150)]
    rows += [(i, "same text\nOFTEN SEEN line 1\n\n \nxx") for i in [7, 7, 7, None, None, 900, 901, 902]]
    rows += [(None, None), (903, ""), (904, "\n\n"), (905, "long " * 50_000), (906, "\r\nxx\x0b\nä\nÄ")]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n_lines long, row string")
    return rows, df.repartition(7)


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("max_broadcast", [32 << 20, 0])
@pytest.mark.parametrize("min_docs", [2, 10])
def test_equal_to_brute_force(lined, keep, max_broadcast, min_docs):
    rows, df = lined
    got = line_dedup(df, min_docs=min_docs, keep=keep, max_broadcast=max_broadcast, shard_keys=200)
    assert found(got) == brute(rows, min_docs, keep=keep)


def test_short_keys_stay(lined):
    rows, df = lined
    assert found(line_dedup(df, min_docs=2, min_chars=3)) == brute(rows, 2, min_chars=3)


def test_filter_of_repeats_misses_none_and_keeps_others_away():
    rng = np.random.default_rng(1)
    own = rng.integers(0, 1 << 63, 50_000, dtype=np.uint64) * np.uint64(2)
    twice = own[:5_000]
    f = TwiceSeen(60_000)
    f.add(own, several=False)
    f.add(twice[:4_000], several=False)
    g = TwiceSeen(60_000)
    g.add(twice[4_000:], several=True)
    for one, known in ((f, twice[:4_000]), (g, twice[4_000:])):
        folded = one.folded()
        assert len(folded) * 8 < one.size
        test = Suspects(0, {0: folded.tobytes()}).test
        assert test(known).all()
        assert test(own[5_000:]).mean() < 0.02


def test_only_suspects_are_counted(lined):
    rows, df = lined
    got = {bytes(r.line_key).decode(): r.n_docs for r in repeated_lines(text_rows(df, "doc_id", "text"), 2).collect()}
    docs = Counter(k for _, t in rows for k in {key_of(x) for x in (t or "").split("\n")} if k)
    assert got == {k: n for k, n in docs.items() if n >= 2}


def test_hot_line_no_rows_and_bad_parameters(spark, no_docs):
    hot = spark.range(5_000).selectExpr("id AS doc_id", "concat('hot\\n', id) AS text").repartition(40)
    assert line_dedup(hot).agg({"n_dropped": "sum"}).first()[0] == 5_000
    assert line_dedup(no_docs).collect() == [] and line_dedup(no_docs, max_broadcast=-1).collect() == []
    for bad in ({"min_docs": 1}, {"keep": "last"}):
        with pytest.raises(ValueError):
            line_dedup(no_docs, **bad)


def test_shards_cover_all_hashes():
    h = np.array([0, 1 << 63, (1 << 64) - 1], np.uint64)
    assert shard_of(h, 0).tolist() == [0, 0, 0] and shard_of(h, 2).tolist() == [0, 2, 3]
    assert line_keys(b" A\tb \r\n\n\xc3\x84 ") == [b"a\tb", b"", b"\xc3\x84"]
