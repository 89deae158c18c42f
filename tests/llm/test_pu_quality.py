import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellframe.llm import pu_quality as Q
from llm.conftest import prose


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(600):
        good = rng.random() < 0.8
        if good:
            t = prose(rng, rng.randint(40, 200))
        else:
            t = rng.choice([" ".join(["spam"] * rng.randint(40, 200)),
                            " ".join(w + "###" for w in prose(rng, 80).split()),
                            prose(rng, 80).upper().replace(" ", "!! ")])
        rows.append((i, t))
        if rng.random() < 0.7:
            labels.append((i, int(good), 0))
    labels += [(9999, 1, 0), (None, 1, 0), (3, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: g for i, g, _ in labels}


def test_held_out_accuracy(case):
    docs, labels, truth = case
    net = Q.fit(docs, labels, F.col("doc_id") % 3 != 1)
    out = [r for r in Q.score(docs, net).collect() if r.doc_id % 3 == 1 and truth.get(r.doc_id) is not None]
    right = sum(r.predicted == truth[r.doc_id] for r in out)
    assert right >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)


def test_negative_labels_are_never_fitted(case):
    docs, labels, truth = case
    net = Q.fit(docs, labels, F.lit(True), prior=0.8)
    # the same fit without the rows labelled 0: only the given prior may depend on them
    other = Q.fit(docs, labels.where("quality = 1"), F.lit(True), prior=0.8)
    assert np.allclose(net.w1, other.w1) and np.allclose(net.w2, other.w2)


def test_risk_never_goes_far_below_zero():
    rng = np.random.default_rng(0)
    p, u = rng.normal(1, 0.3, (50, Q.N_FEATURES)), rng.normal(1, 0.3, (400, Q.N_FEATURES))
    net = Q.fit_network(p, u, 0.9)
    assert net.score(u).mean() > 0.8  # unlabelled rows like the positives stay positive


def test_odd_texts_and_empty_tables(spark, docs, texts, no_docs, case):
    labels = case[1]
    net = Q.fit(case[0], labels, F.lit(True))
    out = Q.score(docs, net, keep=("_key",)).collect()
    assert len(out) == len(texts) and all(0 <= r.score <= 1 for r in out)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert Q.fit(docs, none, F.lit(True)) is None and Q.fit(no_docs, none, F.lit(True)) is None
    assert {(r.score, r.predicted) for r in Q.score(docs, None).collect()} == {(0.5, 1)}
    assert Q.score(no_docs, net).count() == 0
    assert len(Q.features(None)) == len(Q.features(b"a b")) == Q.N_FEATURES
