"""Batch scoring of a token / embedding table with a caller-supplied model (F-01).

Two forms:

* ``score_linear``: the built-in sample model, a linear head ``W x + b``.
  The weights are a small parameter (classes x width) held in one array
  literal, so scoring stays inside Spark expressions.
* ``score_with_model``: any Python callable ``f(batch: ndarray) -> logits``
  applied with ``mapInPandas`` on Arrow batches (``arrow.maxRecordsPerBatch``
  is the batch size); the callable travels with the task closure.

Both emit the same schema: logits, softmax max probability, argmax and
the unit-length embedding.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.functions.columns import argmax, dot, l2_normalize, softmax


def score_linear(df: DataFrame, weights: list[list[float]], bias: list[float] | None = None,
                 emb: str = "emb") -> DataFrame:
    # one array literal each (not one expression per weight), so plans stay small
    w = F.lit([[float(x) for x in row] for row in weights]).cast("array<array<double>>")
    b = F.lit([float(x) for x in (bias or [0.0] * len(weights))]).cast("array<double>")
    logits = F.zip_with(F.transform(w, lambda r: dot(r, F.col(emb))), b, lambda s, c: s + c)
    out = df.withColumn("logits", logits)
    return (out.withColumn("pred", argmax("logits"))
            .withColumn("p_max", F.array_max(softmax("logits")))
            .withColumn("cell_emb", l2_normalize(emb)))


def score_with_model(df: DataFrame, model: Callable[[np.ndarray], np.ndarray], key: str = "cell",
                     emb: str = "emb", extra: list[str] | None = None) -> DataFrame:
    from cellframe.session import ship_package
    ship_package(df.sparkSession)
    extra = extra or []
    cols = [key, *extra]

    def run(batches):
        import pandas as pd
        for pdf in batches:
            x = np.stack(pdf[emb].to_numpy()) if len(pdf) else np.zeros((0, 1))
            z = np.asarray(model(x), dtype=np.float64) if len(pdf) else np.zeros((0, 1))
            zmax = z.max(axis=1, keepdims=True) if len(pdf) else z
            e = np.exp(z - zmax) if len(pdf) else z
            p = e / e.sum(axis=1, keepdims=True) if len(pdf) else z
            norm = np.linalg.norm(x, axis=1, keepdims=True) if len(pdf) else x
            with np.errstate(invalid="ignore", divide="ignore"):
                unit = np.where(norm > 0, x / np.where(norm == 0, 1, norm), np.nan) if len(pdf) else x
            out = pdf[cols].copy()
            out["logits"] = list(z)
            out["pred"] = z.argmax(axis=1).astype("int32") if len(pdf) else pd.Series([], dtype="int32")
            out["p_max"] = p.max(axis=1) if len(pdf) else pd.Series([], dtype="float64")
            out["cell_emb"] = list(unit)
            yield out

    schema = df.select(*cols).schema.simpleString()[len("struct<"):-1]
    schema += ",logits array<double>,pred int,p_max double,cell_emb array<double>"
    return df.select(*cols, emb).mapInPandas(run, schema)
