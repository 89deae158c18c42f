import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from cellframe.llm import decontaminate
from cellframe.llm import pseudo_lm as M


def brute(model, words):
    """log p of each token from its neighbours, one by one."""
    syms = model.symbols(pa.array(words, pa.binary())).tolist()
    pad = [M.SYMBOLS] * M.WINDOW
    line, total = pad + syms + pad, 0.0
    for t, s in enumerate(syms, M.WINDOW):
        h = np.tanh(model.hidden_bias + sum(model.embed[k][line[t + off]] for k, off in enumerate(M.OFFSETS)))
        z = h @ model.class_w + model.class_b
        y = h @ model.word_w[s // M.CLASSES] + model.word_b[s // M.CLASSES]
        total += z[s // M.CLASSES] - np.log(np.exp(z).sum()) + y[s % M.CLASSES] - np.log(np.exp(y).sum())
    return total


@pytest.fixture(scope="module")
def corpus(spark):
    """Two topics: each word's neighbours tell the topic."""
    rng = random.Random(6)
    topics = [[f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)]]
    rows = [(i, " ".join(rng.choice(topics[i % 2]) for _ in range(120))) for i in range(400)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def test_counts(docs, texts):
    from collections import Counter
    want = Counter(w for t in texts for w in decontaminate.words_of((t or "").encode()))
    assert {bytes(r.word): r.n for r in M.word_counts(docs).collect()} == want


def test_scores_equal_brute_force(docs, texts, no_docs):
    model = M.fit(docs, rounds=1, mask=4)
    out = M.score(docs, model).collect()
    assert len(out) == len(texts)
    by = {r.doc_id: r for r in out}
    for i, t in enumerate(texts):
        w = decontaminate.words_of((t or "").encode())
        r = by[None if i == 7 else i]
        assert r.n_tokens == len(w) and (r.score is None) == (not w)
        if len(w) < 400:
            assert r.log_prob == pytest.approx(brute(model, w), abs=1e-2)
    assert M.score(no_docs, M.fit(no_docs)).count() == 0


def test_training_learns_from_both_sides(corpus):
    counts = {bytes(r.word): r.n for r in M.word_counts(corpus).collect()}
    top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    plain = M.initial([w for w, _ in top], [n for _, n in top], sum(counts.values()))
    trained = M.fit(corpus, rounds=3, mask=4)
    assert trained.words == plain.words

    def mean(model):
        rows = M.score(corpus, model).collect()
        return sum(r.log_prob for r in rows) / sum(r.n_tokens for r in rows)

    assert mean(trained) > mean(plain) + 0.3  # at best log 2 more: the topic
    spark = corpus.sparkSession
    mixed = spark.createDataFrame([(1, "a1 a2 a3 a4 a5 a6 a7 a8"), (2, "a1 b2 a3 b4 a5 b6 a7 b8")],
                                  "doc_id long, text string")
    a, b = M.score(mixed, trained).sort("doc_id").collect()
    assert a.score > b.score


def test_averaging_is_weighted(spark):
    import struct
    rows = [(0, 1, struct.pack("<2f", 1.0, 2.0)), (0, 3, struct.pack("<2f", 6.0, 9.0)), (1, 2, struct.pack("<f", 4.0))]
    df = spark.createDataFrame(rows, "shard int, n long, w binary").repartition("shard")
    got = {r.shard: (r.n, struct.unpack(f"<{len(r.w) // 4}f", r.w)) for r in
           df.mapInArrow(M.add_up, "shard int, n long, w binary").collect()}
    assert got == {0: (4, (7.0, 11.0)), 1: (2, (4.0,))}


def test_words_outside_the_vocabulary_have_their_own_share(spark):
    import math
    top = " ".join(f"t{i} t{i} t{i} t{i}" for i in range(M.SYMBOLS - M.BUCKETS))
    often, seldom, other = "r0", "r1", next(f"q{i}" for i in range(10 ** 6)
                                            if M.bucket(f"q{i}".encode()) == M.bucket(b"r0"))
    rows = [(0, top), (1, f"{often} t1 {often} t2 {often}"), (2, f"{seldom} t1 {other}"), (None, f"t5 {seldom} t5"),
            (None, f"t5 {seldom} t5"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = M.fit(docs, rounds=1, mask=4)
    rare = {often.encode(): 3, seldom.encode(): 3, other.encode(): 1}
    held = {b: sum(n for w, n in rare.items() if M.bucket(w) == b) for b in map(M.bucket, rare)}
    assert {b: n for b, n in enumerate(model.bucket_n) if n} == held
    new = "zebra"
    asked = spark.createDataFrame([*rows[1:], (5, f"t1 {new} t2")], "doc_id long, text string").repartition(3)
    out = sorted(((r.doc_id, r.n_tokens, r.log_prob) for r in M.score(asked, model).collect()), key=str)
    want = []
    for i, t in [*rows[1:], (5, f"t1 {new} t2")]:
        words = decontaminate.words_of((t or "").encode())
        lp = brute(model, words) if words else 0.0
        for w in words:
            if w in rare:
                lp += math.log(rare[w] / (held[M.bucket(w)] + 1))
            elif w == new.encode():
                lp -= math.log(held.get(M.bucket(w), 0) + 1) + (len(w) + 1) * math.log(165)
        want.append((i, len(words), lp))
    for a, b in zip(out, sorted(want, key=str), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-3)


@pytest.mark.parametrize("rounds, mask", [(M.ROUNDS, M.MASK), (1, 4), (3, 4), (4, 4)])
def test_rounds_together_mask_every_token_once(spark, monkeypatch, rounds, mask):
    rng = np.random.default_rng(3)
    texts = [None, "", "a", "b c", *(" ".join(f"w{i}" for i in rng.integers(0, 50, n)) for n in (3, 22, 23, 24, 25, 300))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    n = sum(len((t or "").split()) for t in texts)
    seen = []
    monkeypatch.setattr(M, "train_round", lambda d, m, r, *rest: seen.append((r, *rest)) or m)
    M.fit(docs, rounds=rounds, mask=mask)
    assert [s[0] for s in seen] == list(range(rounds)) and {s[2:] for s in seen} == {(rounds, mask)}
    owner = np.repeat(np.arange(len(texts)), [len((t or "").split()) for t in texts])
    turns = M.turns(owner, rounds, mask)
    assert len(turns) == n and np.isin(turns, range(rounds)).all()
    for i in set(owner.tolist()):  # the place in the document decides, whatever lies beside it
        assert (M.turns(np.zeros((owner == i).sum(), int), rounds, mask) == turns[owner == i]).all()


def test_buckets_of_a_batch_are_those_of_its_words():
    """One call for all words of a batch, with the hash as it was."""
    words = [b"r0", b"", "ñandú".encode(), b"r0", b"x" * 300]
    got = M.buckets(pa.array(words, pa.binary()))
    assert got.tolist() == [xxhash.xxh64_intdigest(w) % M.BUCKETS for w in words] == [M.bucket(w) for w in words]
    assert M.buckets(pa.array([], pa.binary())).tolist() == []


def test_rare_word_is_sent_once_for_many_documents(spark, monkeypatch):
    """Texts of more than a batch of training share one row for a word outside the vocabulary."""
    from cellframe.llm import common
    assert M.COUNT_CHARS > common.BATCH_CHARS
    sent, made = {}, M.map_batches

    def watched(df, fn, schema, **kw):
        if "log_prob" in schema:
            sent.update(kw)
        return made(df, fn, schema, **kw)

    monkeypatch.setattr(M, "map_batches", watched)
    docs = spark.createDataFrame([(i, "zq one two") for i in range(40)], "doc_id long, text string")
    model = M.initial([b"one", b"two"], [40, 40], 120)
    assert {r.n_tokens for r in M.score(docs, model).collect()} == {3}
    assert sent["max_chars"] == M.COUNT_CHARS


def test_documents_are_encoded_once_for_all_rounds_and_the_scores(docs, texts, monkeypatch):
    made, read, encode, train_round = [], [], M.encode, M.train_round
    monkeypatch.setattr(M, "encode", lambda *a: made.append(1) or encode(*a))
    monkeypatch.setattr(M, "train_round", lambda d, *rest: read.append(d.columns) or train_round(d, *rest))
    both = sorted(M.fit_score(docs).collect(), key=str)
    assert made == [1] and read == [["line"]] * M.ROUNDS and len(both) == len(texts)
    apart = sorted(M.score(docs, M.fit(docs)).collect(), key=str)
    for a, b in zip(both, apart, strict=True):
        assert a[:2] == b[:2] and a.log_prob == pytest.approx(b.log_prob, rel=1e-4, abs=1e-4)


def test_step_is_adagrad_on_the_mean_gradient():
    """Against one token at a time in double precision, with symbols that repeat more often than MANY times."""
    rng = np.random.default_rng(4)
    model = M.initial([b"a"], [5], 9)
    model.bucket_n = None
    symbols = np.where(rng.random(90) < 0.5, 3, rng.integers(0, M.SYMBOLS, 90)).astype(np.uint16)
    lines = pa.array([symbols[:40].tobytes(), b"", symbols[40:].tobytes()], pa.binary())
    line, places, owner = M.lay_out(lines)
    assert line[places].tolist() == symbols.tolist() and owner.tolist() == [0] * 40 + [2] * 50
    weights = [w.astype(np.float64) for w in model.weights()]
    sums = [np.full(w.shape, 1e-8) for w in weights]
    trainer = M.Trainer(model)
    for at in (places[::2], places[1::2]):
        grads = [np.zeros(w.shape) for w in weights]
        embed, bias, class_w, class_b, word_w, word_b = weights
        for t in at.tolist():
            c, j = divmod(int(line[t]), M.CLASSES)
            near = [int(line[t + off]) for off in M.OFFSETS]
            h = np.tanh(bias + sum(embed[k, s] for k, s in enumerate(near)))
            dz, d = h @ class_w + class_b, h @ word_w[c] + word_b[c]
            dz, d = np.exp(dz) / np.exp(dz).sum(), np.exp(d) / np.exp(d).sum()
            dz[c] -= 1
            d[j] -= 1
            dh = (class_w @ dz + word_w[c] @ d) * (1 - h ** 2)
            for k, s in enumerate(near):
                grads[0][k, s] += dh
            for i, g in ((1, dh), (2, np.outer(h, dz)), (3, dz)):
                grads[i] += g
            grads[4][c] += np.outer(h, d)
            grads[5][c] += d
        for w, s, g in zip(weights, sums, grads):
            g /= len(at)
            s += g * g
            w -= M.RATE * g / np.sqrt(s)
        trainer.step(line, at)
    assert trainer.seen == len(places)
    for got, want in zip(trainer.model.weights(), weights, strict=True):
        assert np.abs(got - want).max() < 2e-4


def test_exponentials_of_large_logits():
    z = np.array([[1000.0, 999.0], [-1000.0, -1001.0], [0.0, -500.0]], np.float32)
    top = 1 / (1 + np.exp(-1))
    assert M.softmax(z.copy(), 0.5) == pytest.approx(np.array([[top, 1 - top], [top, 1 - top], [1, 0]]) / 2)
    assert M.picked(z.T.copy(), np.array([1, 0, 1])) == pytest.approx([np.log(1 - top), np.log(top), -500])
