import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from cellframe.llm import simhash as S


def brute_fingerprint(text, n=3):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not w:
        return 0
    shingles = [" ".join(w[i:i + n]) for i in range(len(w) - n + 1)] or [" ".join(w)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fps, bits=2):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(root), 2):
        if (a ^ b).bit_count() <= bits:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in root}


def test_fingerprint_equals_brute_force(texts):
    for t in texts:
        if t is None or len(t) < 20_000:
            assert S.fingerprint(t) == brute_fingerprint(t)


def test_golay_keys_meet_every_word_one_bit_off():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 3000)
    index, within = S.decode(words)
    assert ((within >= 0).sum(1).astype(int)[:, None] == np.array([1, 6])).any(1).all()
    for b in range(23):
        _, near = S.decode(words ^ (1 << b))
        assert (near == index[:, None]).any(1).all()


def clusters(rng, dense=0):
    fps = [rng.getrandbits(64) for _ in range(300)]
    for f in fps[:120]:
        for _ in range(rng.randint(1, 4)):
            g = f
            for b in rng.sample(range(64), rng.randint(0, 3)):
                g ^= 1 << b
            fps.append(g)
    centre = rng.getrandbits(64)
    for _ in range(dense):
        g = centre
        for b in rng.sample(range(64), rng.randint(0, 4)):
            g ^= 1 << b
        fps.append(g)
    return fps


@pytest.mark.parametrize("hot", [S.HOT_PAIRS, 3, 0])
def test_components_equal_brute_force(spark, hot):
    fps = sorted(set(clusters(random.Random(8), dense=150)))
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    df = spark.createDataFrame([(v,) for v in signed.values()], "fp long")
    roots = {r.node: r.root for r in S.components(S.links(df, hot_pairs=hot)).collect()}
    groups = defaultdict(set)
    for f, v in signed.items():
        groups[roots.get(v, v)].add(f)
    want = defaultdict(set)
    for f, r in brute_groups(fps).items():
        want[r].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("bits", [0, 1])
def test_smaller_distances(spark, bits):
    fps = sorted(set(f & (1 << 63) - 1 for f in clusters(random.Random(9), dense=60)))
    for hot in (0, 10**9):
        roots = {r.node: r.root for r in S.components(
            S.links(spark.createDataFrame([(f,) for f in fps], "fp long"), bits, hot)).collect()}
        assert {f: roots.get(f, f) for f in fps} == brute_groups(fps, bits)


def test_long_chain(spark):
    chain = [0]
    for b in list(range(0, 62)) + list(range(0, 62, 3)):
        chain.append(chain[-1] ^ (1 << b))
    df = spark.createDataFrame([(f,) for f in sorted(set(chain))], "fp long")
    assert {r.root for r in S.components(S.links(df)).collect()} == {0}


def test_documents(docs, texts, no_docs):
    out = S.simhash_dedup(docs, keep=("_key",)).collect()
    assert len(out) == len(texts)
    fp = {t: brute_fingerprint(t) if t is None or len(t) < 20_000 else S.fingerprint(t) for t in texts}
    groups = brute_groups(set(fp.values()))
    least = {}
    for i, t in enumerate(texts):
        if i != 7:
            r = groups[fp[t]]
            least[r] = min(least.get(r, i), i)
    for r in out:
        t = texts[7 if r.doc_id is None else r.doc_id]
        assert r.fingerprint == f"{fp[t]:016x}" and r.component_id == least.get(groups[fp[t]])
    assert S.simhash_dedup(no_docs).count() == 0
