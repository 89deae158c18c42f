import re
from collections import Counter

import zstandard

from cellframe.llm import compression


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    repeated = {i + k for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(repeated)


def test_counts_equal_brute_force(docs, texts):
    out = compression.compression_rules(docs).collect()
    want = Counter(brute(t) for t in texts)
    assert Counter((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out) == want
    for r in out:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_ratio_and_chunks(spark):
    text = "some words of prose, " * 3 + "x" * 9000
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    a, b = compression.compression_rules(df).sort("doc_id").collect()
    size = len(zstandard.ZstdCompressor(level=compression.LEVEL, write_content_size=False).compress(text.encode()))
    assert a.ratio == len(text) / size and len(a.chunk_ratios) == 3 and not a.kept
    assert b.ratio is None and b.base_failed and not b.kept and b.chunk_ratios == []


def test_bands_reject_repetition_and_noise_but_keep_prose(spark):
    import random
    rng = random.Random(1)
    syllables = ["ta", "ne", "ri", "mo", "ka", "lu", "shi", "ver", "and", "os"]
    prose = " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(600))
    noise = " ".join("".join(rng.choice([chr(c) for c in range(0x4e00, 0x9000)]) for _ in range(9)) for _ in range(300))
    phrases = [" ".join(rng.sample(prose.split(), 40)) for _ in range(2)]
    varied = " ".join(f"{p} {k}" for k in range(60) for p in phrases)  # long phrases again and again
    df = spark.createDataFrame([(1, prose), (2, noise), (3, varied)], "doc_id long, text string")
    got = {r.doc_id: r for r in compression.compression_rules(df, max_repeat=2.0).collect()}
    assert got[1].kept
    assert not got[3].kept and got[3].ratio > 3
    assert got[2].ratio < got[1].ratio


def test_empty_table(no_docs):
    assert compression.compression_rules(no_docs).count() == 0


def test_random_base64_and_bytes_are_rejected(spark):
    import base64
    import random
    rng = random.Random(2)

    def parts(text, size, by):
        return by.join(text[i:i + size] for i in range(0, len(text), size))

    def encoded(n):
        return base64.b64encode(rng.randbytes(n)).decode()[:n]

    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 7))) for _ in range(3000)]
    prose = " ".join(words)
    texts = []
    for n in (1024, 2048, 4096, 6000, 16384, 40_000, 65_536, 200_000):
        texts += [parts(encoded(n), 76, "\n"), parts(encoded(n), 8, " "), encoded(n),
                  parts(rng.randbytes(n).decode("latin1"), 9, " ")]
    texts.append(prose + "\n" + parts(encoded(len(prose) * 2 // 3), 76, "\n"))  # two fifths of the text
    texts.append(prose)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = compression.compression_rules(df, min_words=0).sort("doc_id").collect()
    assert [r.doc_id for r in out if r.kept] == [len(texts) - 1]
