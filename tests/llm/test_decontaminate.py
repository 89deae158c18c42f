import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cellframe.llm import decontaminate as D
from llm.conftest import prose


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(text, items, window=13):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        q = words(t)
        k = min(window, len(q))
        for s in range(len(q) - k + 1) if q else ():
            for i in range(len(w) - k + 1):
                if w[i:i + k] == q[s:s + k]:
                    hit |= set(range(i, i + k))
                    if item is not None:
                        found.add(str(item))
    return len(w), len(hit), tuple(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)


@pytest.fixture(scope="module")
def case(spark):
    import random
    rng = random.Random(3)
    items = [(i, prose(rng, rng.randint(14, 40))) for i in range(12)]
    items += [(20, "Short ONE here"), (20, "Short ONE here"), (21, "..."), (22, None), (23, ""), (None, prose(rng, 20)),
              (24, "a b a b a b a b a b a b a b a b")]
    docs = []
    for i in range(60):
        q = words(items[i % len(items)][1])
        middle = " ".join(q[rng.randint(0, 5):rng.randint(5, 40)])
        docs.append((i, prose(rng, rng.randint(0, 40)) + "\n" + middle.upper() + ", " + prose(rng, rng.randint(0, 200))))
    docs += [(60, None), (61, ""), (62, "short one HERE"), (62, "short one HERE"), (None, "x short-one.here y"),
             (63, "short"), (64, "one here"), (65, "a b " * 40), (66, prose(rng, 20_000) + " " + items[3][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    b = spark.createDataFrame(items, "item_id long, text string")
    return docs, items, d, b


@pytest.mark.parametrize("block", [600, D.BLOCK_CHARS])
def test_equals_brute_force(case, monkeypatch, block):
    docs, items, d, b = case
    found = D.search(D.build_index(d, block_chars=block), b, query_block_chars=300 if block == 600 else 10**6)
    n_hit = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["end"] - 1)))))
    got = sorted((r.id is None, r.id or 0, r.n_words, r.n,
                  tuple(sorted({h.item for h in r.hits if h.item is not None})))
                 for r in found.withColumn("n", n_hit).collect())
    want = sorted((i is None, i or 0, *brute(t, items)[:3]) for i, t in docs)
    assert got == want


def test_operator_digest(case):
    docs, items, d, b = case
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated)
                 for r in D.decontaminate(d, b).collect())
    assert got == sorted((i is None, i or 0, *brute(t, items)) for i, t in docs)


def test_phrases_do_not_cross_documents_and_proximity(spark):
    d = spark.createDataFrame([(1, "one two"), (2, "three four"), (3, "one x two y three")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "two three"), (2, "one two three")], "item_id long, text string")
    index = D.build_index(d.coalesce(1))
    exact = {r.id: r.hits for r in D.search(index, q).collect()}
    assert not any(exact.values())
    near = {r.id: {h.item for h in r.hits} for r in D.search(index, q, slop=2).collect()}
    assert near == {1: set(), 2: set(), 3: {"1", "2"}}


def test_packing_round_trip():
    import numpy as np
    for x in ([], [0], [5, 5, 2, 9, 2**31 - 1, 0]):
        assert D.unpack(D.pack(np.array(x, np.int32))).tolist() == x


def test_empty_tables(spark, docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.decontaminate(no_docs, none).count() == 0
    rows = D.decontaminate(docs, none).collect()
    assert len(rows) == docs.count() and not any(r.contaminated or r.n_hit for r in rows)


def test_proximity_stays_in_the_document_and_on_words_of_their_own():
    import random
    rng = random.Random(7)
    for _ in range(300):
        texts = [[rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(4)]
        phrase, slop = [rng.choice("abcd") for _ in range(rng.randint(1, 4))], rng.randint(1, 2)
        flat = [w for t in texts for w in t]
        terms = sorted(set(flat))
        postings = [[i for i, w in enumerate(flat) if w == t] for t in terms]
        block = D.Block([len(t) for t in texts], " ".join(terms).encode(), D.pack(np.array([len(p) for p in postings], np.int32)),
                        D.pack(np.array([i for p in postings for i in p], np.int32)))
        numbers = {w: i for i, w in enumerate(dict.fromkeys(phrase))}
        lists = block.lists(pa.array([w.encode() for w in numbers], pa.binary()))
        got = block.phrase(lists, [numbers[w] for w in phrase], slop).tolist()
        if any(w not in terms for w in phrase):
            assert got == []
            continue
        # the rarest term is chosen over the block
        rarest = min(range(len(phrase)), key=lambda o: (flat.count(phrase[o]), o))
        want, start = [], 0
        for t in texts:
            marked = _near_from(t, phrase, slop, rarest)
            want += [start + b for b in marked]
            start += len(t)
        assert got == want


def _near_from(words, phrase, slop, rarest):
    from itertools import product
    out = []
    for at in [i for i, w in enumerate(words) if w == phrase[rarest]]:
        begin = at - rarest
        if begin < 0 or begin + len(phrase) > len(words):
            continue
        choices = [[at] if o == rarest else [i for i in range(max(0, begin + o - slop), min(len(words), begin + o + slop + 1))
                                             if words[i] == w] for o, w in enumerate(phrase)]
        if any(len(set(c)) == len(phrase) for c in product(*choices)):
            out.append(begin)
    return out
