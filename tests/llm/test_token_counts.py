import random

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from cellframe.llm import token_counts as C  # noqa: E402

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


def encoded(library, texts):
    return [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]


def test_every_prefix_equals_the_library(library, texts):
    rng = random.Random(1)
    alphabet = ["a", "b", "the", " ", "  ", "\n", "'ll", "'", "é", "漢", "🙂", "1", "<|endoftext|>", ".", "\x1c", "\u00a0"]
    cases = ["".join(rng.choice(alphabet) for _ in range(40)) for _ in range(60)]
    cases += [(t or "")[:200] for t in texts] + ["a<|endoftext|> b<|endoft <|endoftext|><|endoftext|>  ", "   ", "\n\n\na"]
    counter = C.counter(PATH)
    for t in filter(None, cases):
        assert counter.counts(t).tolist() == encoded(library, [t[:k] for k in range(1, len(t) + 1)]), repr(t)


def test_documents(docs, texts, no_docs, library):
    out = C.token_counts(docs, PATH, budget=50).collect()
    want = sorted(zip(encoded(library, [t or "" for t in texts]), (len((t or "").encode()) for t in texts)))
    assert sorted((r.n_tokens, r.n_bytes) for r in out) == want
    by = {r.doc_id: r for r in out}
    for i, t in enumerate(texts):
        r = by[None if i == 7 else i]
        stored = C.PrefixCounts(r.prefix_counts)
        assert r.over_limit == (r.n_tokens > 50) and stored.tokens() == r.n_tokens
        if r.over_limit and len(t) < 5000:
            counts = encoded(library, [t[:k] for k in range(len(t) + 1)])
            assert r.fits == stored.truncate(50) == max(k for k, n in enumerate(counts) if n <= 50)
    assert C.token_counts(no_docs, PATH).count() == 0


def test_caches_may_be_small(monkeypatch, texts):
    monkeypatch.setattr(C, "MAX_PIECES", 4)
    monkeypatch.setattr(C, "MAX_PAIRS", 4)
    small, large = C.PrefixCounter(PATH), C.counter(PATH)
    for t in texts[:8]:
        assert np.array_equal(small.counts(t), large.counts(t))
