import math
from collections import Counter

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from cellframe.llm import pieces as S  # noqa: E402

PATH = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def lattices():
    return S.lattices_of(PATH, S.SHARPNESS)


def test_lossless_and_independent_of_batches(docs, texts, no_docs, lattices):
    out = S.encode(docs, PATH, keep=("text", "_key")).collect()
    assert len(out) == len(texts) and all(r.lossless for r in out)
    for r in out:
        assert (r.ids is None) == (r.text is None)
        assert S.decode(r.ids or [], lattices) == (r.text or "").encode()
    one = {r.doc_id: r.ids for r in S.encode(docs.coalesce(1).sort("n_chars", "text"), PATH).collect()}
    assert all(one[r.doc_id] == r.ids for r in out)
    other = {r.doc_id: r.ids for r in S.encode(docs, PATH, seed=1).collect()}
    assert sum(other[r.doc_id] != r.ids for r in out) > len(out) / 2
    back = {r.doc_id: r.text for r in S.decode_rows(S.encode(docs, PATH), PATH).collect()}
    assert all(back[r.doc_id] == r.text for r in out)
    assert S.encode(no_docs, PATH).count() == 0


def test_kept_lattices_change_nothing(texts):
    batch = [(t or "").encode() for t in texts if len(t or "") < 20_000]
    streams = np.arange(len(batch)).astype(np.uint64) * np.uint64(7919)
    fresh, kept = (S.Lattices(PATH, S.SHARPNESS) for _ in range(2))
    parts = [slice(0, 9), slice(9, 20), slice(3, 40), slice(0, len(batch))]
    for known in (1 << 30, 300):
        for part in parts:
            one, two = (S.sample(batch[part], streams[part], x, k) for x, k in ((fresh, 0), (kept, known)))
            assert one[0].tolist() == two[0].tolist() and one[1].tolist() == two[1].tolist()


def test_the_librarys_decoder_agrees(lattices):
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = ["Hello  world\n a b  x ", "Ünïcödé 漢字 🙂", "one two three"]
    ids, n = S.sample([t.encode() for t in texts], np.arange(3).astype(np.uint64), lattices)
    stop = np.cumsum(n)
    assert [library.decode(ids[e - k:e].tolist()) for e, k in zip(stop, n)] == texts


@pytest.mark.parametrize("word", ["then", "a\nb", "é🙂"])
def test_paths_are_drawn_with_their_shares(lattices, word):
    """All paths by brute force, against the frequencies of many draws."""
    raw = b" " + word.encode()
    known = {b: i for i, b in enumerate(lattices.bytes_of) if b and (len(b) > 1 or i > 258)}
    paths = []

    def walk(at, ids, weight):
        if at == len(raw):
            paths.append((tuple(ids), weight))
        for end in range(at + 1, len(raw) + 1):
            i = known.get(raw[at:end])
            if i is not None:
                walk(end, ids + [i], weight * lattices.weight[i])
        char = raw[at:].decode("utf-8", "ignore")[:1].encode() if at < len(raw) else b""
        if char and char.decode() not in lattices.singles:
            ids2 = [int(lattices.byte_id[b]) for b in char]
            walk(at + len(char), ids + ids2, weight * math.prod(lattices.weight[i] for i in ids2))

    walk(0, [], 1.0)
    total = sum(w for _, w in paths)
    n = 40_000
    ids, sizes = S.sample([word.encode()] * n, np.arange(n).astype(np.uint64) * np.uint64(2654435761), lattices)
    stop = np.cumsum(sizes)
    drawn = Counter(tuple(ids[e - k:e].tolist()) for e, k in zip(stop, sizes))
    assert sum(drawn[p] for p, _ in paths) == n
    for p, w in paths:
        share = w / total
        assert abs(drawn[p] / n - share) < 5 * math.sqrt(share * (1 - share) / n) + 1e-4
