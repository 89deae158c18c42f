import random

import pytest

LETTERS = "abcdefgh"


def prose(rng: random.Random, n: int, words: int = 400) -> str:
    """n words of an invented vocabulary, in lines of about twelve."""
    pick = [f"{LETTERS[i % 8]}{LETTERS[i // 8 % 8]}{i}x" for i in range(words)]
    out = [rng.choice(pick) for _ in range(n)]
    return "\n".join(" ".join(out[i:i + 12]) for i in range(0, n, 12))


@pytest.fixture(scope="session")
def texts() -> list:
    """Ordinary, null, empty, blank, very long, repeated and odd texts."""
    rng = random.Random(5)
    plain = [prose(rng, rng.randint(5, 300)) for _ in range(40)]
    odd = [None, "", " \n\t ", "x", "one two", "ÄÖ ß 漢字 🙂", "a  b \n\n c\x0b d\x1ce", "#*$%&|<> #*", "word " * 300,
           "▁ ▁▁ a", "no_spaces_" * 3000, prose(rng, 30_000), "A-Z Mixed CASE's <|endoftext|> x"]
    return plain + odd + plain[:5] + odd[:4]


def documents(spark, texts: list, **columns):
    """documents with ids, nulls in every column, and columns whose names could clash."""
    rows = [(None if i == 7 else i, t, None if i % 9 == 0 else "en", "s", 1, "k", "t", 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "_key string, _text string, score double").repartition(3)


@pytest.fixture(scope="session")
def docs(spark, texts):
    return documents(spark, texts).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
