import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from llm.conftest import prose  # noqa: E402


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Clean documents, junk, near copies, repeated rows, a contaminated document and texts without letters."""
    rng = random.Random(21)
    clean = [(i, prose(rng, rng.randint(60, 200)), rng.choice(["en", "de"]), "s", 1, "x") for i in range(150)]
    junk = [(200 + i, " ".join(["spam!!"] * rng.randint(60, 200)), "en", "s", 1, "x") for i in range(40)]
    copies = [(300 + i, clean[i][1], "en", "s", 1, "x") for i in range(5)]
    twice = [clean[10], clean[11]]
    item = prose(rng, 20)
    bad = [(400, prose(rng, 30) + " " + item + " " + prose(rng, 30), "en", "s", 1, "x")]
    odd = [(500, None, "en", "s", 1, "x"), (501, "12345 67890 " * 30, "en", "s", 1, "x"),
           (None, prose(rng, 90), None, None, None, None)]
    d = str(tmp_path_factory.mktemp("tables"))
    schema = "doc_id long, text string, lang string, source string, n_chars long, _key string"
    spark.createDataFrame(clean + junk + copies + twice + bad + odd, schema).write.parquet(f"{d}/documents.parquet")
    labels = [(i, 1, 0) for i in range(150)] + [(200 + i, 0, 0) for i in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, {r[0]: r[1] for r in clean}


def test_stages_in_order(spark, tables):
    from cellframe.session import materialize
    d, clean = tables
    docs, ids = spark.read.parquet(f"{d}/documents.parquet"), []
    columns = docs.columns
    for name, stage in pipeline.STAGES:
        docs = materialize(stage(spark, docs, d), "stage")
        ids.append(sorted(r.doc_id for r in docs.select("doc_id").where("doc_id is not null").collect()))
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    kept = ids[0]
    assert not any(200 <= i < 300 for i in kept) and sum(i < 150 for i in kept) >= 150
    assert 500 not in ids[1] and 501 not in ids[1]
    # near-duplicates: the smallest id of each group, one row of it
    assert ids[2] == sorted(set(ids[2])) and not any(300 <= i < 400 for i in ids[2]) and set(range(150)) <= set(ids[2])
    assert 400 in ids[2] and 400 not in ids[3] and set(range(150)) <= set(ids[3])
    assert ids[4] == ids[3]
    rows = docs.collect()
    assert all(r.lossless for r in rows)
    assert all(r.text == clean[r.doc_id] for r in rows if r.doc_id in clean)


def test_run(spark, tables):
    out = pipeline.run(spark, tables[0])
    assert out.where("lossless").count() == out.count() > 140
    assert pipeline.ORACLE_SQL is None


def test_repeated_ids_with_other_texts(spark):
    rows = [(1, "one two three four five"), (1, "quite another text of words"), (1, "one two three four five"),
            (0, "one two three four five"), (None, "no id here at all"), (None, "no id here at all"), (2, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out) == [
        (False, 0, "one two three four five"), (False, 1, "quite another text of words"), (False, 2, ""),
        (True, 0, "no id here at all")]


def test_stages_on_empty_tables(spark, no_docs, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    for _, stage in pipeline.STAGES:
        assert stage(spark, no_docs, d).count() == 0
    # no labels, no items: what is there stays
    one = spark.createDataFrame([(1, "a few plain words", "en", "s", 1)], no_docs.schema)
    assert [stage(spark, one, d).count() for _, stage in pipeline.STAGES] == [1, 1, 1, 1, 1]
