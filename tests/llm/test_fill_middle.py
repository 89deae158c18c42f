"""Fill-in-the-middle: equal to a plain version, lossless, repeated rows, pieces cut anywhere."""

import hashlib
import re
from collections import Counter

import pytest

from cellframe.llm.fill_middle import SourceReader, fill_in_middle, unit_ends

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(key, text):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    pre, mid, suf = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, None)))
    plain = not text or re.search("<[PSM]>", text) or h3 % 100 >= 50
    form = "plain" if plain else "spm" if h4 % 100 < 80 else "psm"
    out = {"plain": text, "psm": f"<P>{pre}<S>{suf}<M>{mid}", "spm": f"<S>{suf}<P>{pre}<M>{mid}"}[form]
    sha = [hashlib.sha256(t.encode()).hexdigest() for t in (out, text)]
    return (key, len(units), form, *((None, None) if plain else (len(pre), len(mid))), *sha, out)


COLUMNS = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output")


def rows_of(df):
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.mark.parametrize("size", [1, 50, 8192])
def test_equal_to_plain_version(docs, size):
    got = rows_of(fill_in_middle(docs, piece_bytes=size))
    assert got == Counter(brute(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())


def test_signs_ties_and_repeated_rows(spark):
    texts = ["a <P> b", "<S>", "x<M>", "<", "<P", "P> a <S b M> <", "a <\nS> <M", " lead", "trail \x0b", "\x1ca\x85b c"]
    rows = [(k, t) for k in range(40) for t in texts] + [(3, "a b c d e f")] * 50 + [(None, "a b")] * 2 + [(None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert rows_of(fill_in_middle(df, piece_bytes=4)) == Counter(brute(*r) for r in rows)


def test_no_rows_and_no_second_shuffle(spark, no_docs):
    out = fill_in_middle(no_docs)
    assert out.collect() == [] and tuple(out.columns) == COLUMNS
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_reader_does_not_depend_on_the_pieces():
    pre, mid, suf = b"one <", b" two<P", b" three <M"
    for form, out in (("psm", b"<P>" + pre + b"<S>" + suf + b"<M>" + mid), ("spm", b"<S>" + suf + b"<P>" + pre + b"<M>" + mid)):
        for step in range(1, len(out) + 1):
            reader, got = SourceReader(form), {"P": b"", "M": b"", "S": b""}
            for i in range(0, len(out), step):
                for segment, data in reader.feed(out[i:i + step]):
                    got[segment] += data
            for segment, data in reader.feed(b"", last=True):
                got[segment] += data
            assert (got["P"], got["M"], got["S"]) == (pre, mid, suf)


def test_units_are_whole():
    for t in ("", " ", "a", " a", "a ", "a  b\n", "é ß 漢字\t"):
        ends = [0, *unit_ends(t.encode())]
        assert [t.encode()[i:j].decode() for i, j in zip(ends, ends[1:])] == UNIT.findall(t)
