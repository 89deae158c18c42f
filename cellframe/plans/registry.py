"""Registry of named queries: a Spark builder plus (optionally) its SQL oracle.

A builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame.  The
oracle is DuckDB SQL over the raw tables (stand-in views are inlined as
CTEs by ``with_views``).  Queries without an oracle are checked by row
count and by the property tests under ``tests/``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from cellframe.plans import (  # noqa: F401
        q_build, q_vocab, q_splits, q_metrics, q_vectors, q_metagenes, q_graph, q_io, q_stream,
    )
