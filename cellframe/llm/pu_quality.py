"""Quality classifier by positive-unlabelled learning.

Trusted positives are rows labelled 1; unlabelled web text stands for
everything.  A small network is fitted by the non-negative unbiased risk

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))

with the sigmoid loss: where the bracket turns negative (the network fits
the positives inside the unlabelled text), the step goes the other way.
Rows labelled 0 never enter the risk; they are only counted, with the
positives, to estimate the class prior (the share of 1 among the labels).

Features are counts and shares of the text alone.  The fit takes a bounded
sample: at most ``max_positive`` positives and ``max_unlabelled`` unlabelled
rows, in the order of a hash of the id; scoring reads every whole text.

Edge cases: null and empty texts are scored like any other (all counts 0);
without a positive row in the labels every score is 0.5; null ids are scored
and never learned from.  Repeated rows give one row each.  Other columns of
the inputs are carried only if named in ``keep``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellframe.llm.common import carried, map_batches, named, row_schema, text_rows

MAX_POSITIVE, MAX_UNLABELLED = 4_000, 8_000
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_SYMBOL = b"#*$%&|<>@^~_=+\\/{}[]"
_PUNCT = b".,;:!?'\"()-"
_ASCII = bytes(range(128))


def share(text: bytes, chars: bytes) -> float:
    return 1 - len(text.translate(None, chars)) / len(text) if text else 0.0


def features(text: bytes | None) -> list[float]:
    text = text or b""
    words = text.split()
    n = len(words)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    if not n:
        return [0.0] * N_FEATURES
    distinct = set(words)
    joined = b"".join(words)
    pairs = len(set(zip(words, words[1:])))
    same = sum(map(bytes.__eq__, words, words[1:]))
    return [
        np.log1p(len(text)), np.log1p(n), len(joined) / n, np.log1p(max(map(len, distinct))),
        len(distinct) / n, pairs / max(1, n - 1), same / max(1, n - 1),
        np.log(n + 1) - np.log(len(distinct)),
        share(joined, _UPPER), share(joined, _LOWER), share(joined, _DIGIT), share(joined, _SYMBOL),
        share(joined, _PUNCT), joined.count(b"!") / n, joined.count(b"|") / n, joined.count(b".") / n,
        1 - share(joined, _ASCII), np.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines),
        sum(map(bytes.isupper, words)) / n, sum(map(bytes.istitle, words)) / n,
        sum(len(w) == 1 for w in words) / n,
    ]


N_FEATURES = 22


@dataclass
class Network:
    """One hidden layer; ``score`` is the probability of quality."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.centre) / self.scale, -6, 6) @ self.w1 + self.b1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.hidden(x) @ self.w2 + self.b2, -30, 30)))


def fit_network(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 16, steps: int = 400,
                rate: float = 0.02, decay: float = 2e-3, seed: int = 7) -> Network:
    """Minimise the non-negative risk by Adam over full batches."""
    rng = np.random.default_rng(seed)
    every = np.concatenate([positive, unlabelled])
    net = Network(every.mean(0), every.std(0) + 1e-6, rng.normal(0, 0.3, (every.shape[1], hidden)),
                  np.zeros(hidden), rng.normal(0, 0.3, hidden), 0.0)
    xp, xu = (np.clip((x - net.centre) / net.scale, -6, 6) for x in (positive, unlabelled))
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        w1, b1, w2, b2 = params
        hp, hu = np.tanh(xp @ w1 + b1), np.tanh(xu @ w1 + b1)
        sp, su = (1 / (1 + np.exp(-np.clip(h @ w2 + b2, -30, 30))) for h in (hp, hu))
        # sigmoid loss: l(+1) = 1 - s, l(-1) = s; both have the slope s (1 - s) in the logit
        negative = su.mean() - prior * sp.mean()
        slope_p, slope_u = sp * (1 - sp) / len(sp), su * (1 - su) / len(su)
        if negative >= 0:
            gp, gu = -2 * prior * slope_p, slope_u
        else:
            gp, gu = prior * slope_p, -slope_u
        grads = [xp.T @ (np.outer(gp, w2) * (1 - hp ** 2)) + xu.T @ (np.outer(gu, w2) * (1 - hu ** 2)) + decay * w1,
                 (np.outer(gp, w2) * (1 - hp ** 2)).sum(0) + (np.outer(gu, w2) * (1 - hu ** 2)).sum(0),
                 hp.T @ gp + hu.T @ gu + decay * w2, np.array([gp.sum() + gu.sum()])]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            params[i] = params[i] - rate * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(v[i] / (1 - 0.999 ** t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    return net


def feature_rows(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    def fn(rb: pa.RecordBatch) -> dict:
        rows = [features(t) for t in rb.column(1).cast(pa.binary()).to_pylist()]
        return carried(rb) | {"x": rows}

    rows = text_rows(docs, id_col, text_col, keep)
    return named(map_batches(rows, fn, row_schema(rows, "x array<double>")), id_col, keep)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", prior: float | None = None, max_positive: int = MAX_POSITIVE,
        max_unlabelled: int = MAX_UNLABELLED) -> Network | None:
    """Fit on rows where ``learn`` (a condition on the id) holds; None without positives."""
    known = labels.where(learn & F.col(label_col).isNotNull())
    if prior is None:
        prior = known.agg(F.avg((F.col(label_col) == 1).cast("double"))).first()[0]
    if not prior:
        return None
    prior = float(min(max(prior, 0.02), 0.98))
    by_hash = F.xxhash64(F.col(id_col).cast("string"))

    def few(rows: DataFrame, most: int) -> DataFrame:
        ids = rows.select(id_col).where(F.col(id_col).isNotNull()).distinct()
        return ids.orderBy(by_hash, id_col).limit(most)

    # at most max_positive + max_unlabelled ids: a bounded broadcast, and one pass over the texts
    pick = (few(known.where(F.col(label_col) == 1), max_positive).withColumn("_positive", F.lit(True))
            .unionByName(few(docs.where(learn), max_unlabelled).withColumn("_positive", F.lit(False))))
    sample = docs.select(id_col, text_col).join(F.broadcast(pick), id_col)
    rows = (feature_rows(sample, id_col, text_col, ("_positive",)).orderBy(F.xxhash64(id_col), "_positive", "x")
            .limit(2 * (max_positive + max_unlabelled)).collect())
    x = np.array([r["x"] for r in rows], float).reshape(-1, N_FEATURES)
    positive = np.array([r["_positive"] for r in rows], bool)
    if not positive.any() or positive.all():
        return None
    return fit_network(x[positive], x[~positive], prior)


def score(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text",
          keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, ``score`` (0 to 1), ``predicted`` (1 from 0.5), and the columns in ``keep``."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def fn(rb: pa.RecordBatch) -> dict:
        x = np.array([features(t) for t in rb.column(1).cast(pa.binary()).to_pylist()]).reshape(-1, N_FEATURES)
        s = shared.value.score(x) if shared.value is not None else np.full(len(x), 0.5)
        return carried(rb) | {"score": s, "predicted": (s >= 0.5).astype(np.int32)}

    rows = text_rows(docs, id_col, text_col, keep)
    return named(map_batches(rows, fn, row_schema(rows, "score double, predicted int")), id_col, keep)
