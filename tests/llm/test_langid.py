import random

import pytest
from pyspark.sql import functions as F

from cellframe.llm import langid

WORDS = {"aa": ["wo", "wara", "tori", "nemu"], "bb": ["ich", "bin", "schlecht", "tag"], "cc": ["élan", "vital", "où", "ça"]}


def speak(lang, n, rng):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(WORDS[lang]) for _ in range(n))


def phrases(text: bytes, known: bytes) -> int:
    """Greedy longest matches over the whole text."""
    total = i = 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in known:
            j += 1
        i = max(i + 1, j - 1)
        total += 1
    return total


def test_automaton_counts_phrases(monkeypatch):
    rng = random.Random(2)
    known = langid.normal(speak("aa", 60, rng) + " " + speak("bb", 20, rng))
    texts = [langid.normal(speak(k, rng.randint(1, 500), rng)) for k in ("aa", "bb", "cc") for _ in range(5)] + [b"", b"z"]
    # phrases longer than a lane: the labelled text itself, whole and in parts
    texts += [known, known[7:], known[3:300] * 3, b"z" * 40 + known[40:200]]
    auto = langid.Automaton(known)
    want = [phrases(t, known) for t in texts]
    for lane, lanes in ((1024, 4096), (16, 5), (1, 7), (3, 4096)):
        monkeypatch.setattr(langid, "LANE", lane)
        monkeypatch.setattr(langid, "LANES", lanes)
        assert langid.parse_all(texts, [auto])[:, 0].tolist() == want


def test_languages_of_long_texts_only_are_learned(spark):
    rng = random.Random(6)
    rows = [(i, speak(k, 900 if k == "aa" else 2000, rng), k) for i, k in enumerate(["aa", "bb"] * 8)]
    rows += [(100, "1 " * 9000 + speak("cc", 3, rng) + " 2" * 9000, "cc")]
    assert min(len(t) for _, t, k in rows if k != "aa") > langid.MAX_CHARS
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    automata = langid.fit(docs, F.lit(True))
    assert list(automata) == ["aa", "bb", "cc"]
    assert {r.doc_id: r.lang_pred for r in langid.identify(docs, automata).collect()} == {i: k for i, _, k in rows}


def test_fit_is_bounded_over_all_languages(spark):
    rows = [(i, "wort " * 300 + chr(97 + i) * 3, f"l{i:02d}") for i in range(20)]
    automata = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), fit_total=2_000)
    assert len(automata) == 20 and all(a.table.size / a.width <= 2 * 100 + 2 for a in automata.values())


@pytest.fixture(scope="module")
def fitted(spark):
    rng = random.Random(4)
    rows = [(i, speak(k, rng.randint(5, 80), rng), k) for i, k in enumerate(list(WORDS) * 30)]
    rows += [(1000, None, "aa"), (1001, "123 ...", "aa"), (1002, "", None), (1003, speak("bb", 9, rng), None),
             (None, speak("cc", 9, rng), "cc"), (5, rows[5][1], rows[5][2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    held = F.coalesce(F.col("doc_id") % 4 == 2, F.lit(False))
    return rows, docs, langid.fit(docs, ~held)


def test_predictions(fitted):
    rows, docs, automata = fitted
    assert list(automata) == ["aa", "bb", "cc"]
    out = langid.identify(docs, automata).collect()
    assert len(out) == len(rows)
    want = {i: k for i, t, k in rows if i is not None and i < 1000}
    assert all(r.lang_pred == want[r.doc_id] for r in out if r.doc_id in want)
    assert all(0 <= r.score <= 1 for r in out)
    by = {r.doc_id: r for r in out}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1000, 1001, 1002))
    assert by[1003].lang_pred == "bb" and by[None].lang_pred == "cc"


def test_odd_texts_and_empty_tables(docs, no_docs, fitted):
    rows, _, automata = fitted
    out = langid.identify(docs, automata, keep=("lang", "_key")).collect()
    assert len(out) == docs.count()
    assert langid.identify(no_docs, automata).count() == 0
    assert langid.fit(no_docs, F.lit(True)) == {}
    assert {r.lang_pred for r in langid.identify(docs, {}).collect()} == {"und"}
    # a text without any known byte: first language, score 0
    r = langid.identify(docs.sparkSession.createDataFrame([(1, "漢字")], "doc_id long, text string"), automata).first()
    assert (r.lang_pred, r.score) == ("aa", 0.0)
