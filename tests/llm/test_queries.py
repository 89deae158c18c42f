"""The registered queries: SQL parity where there is SQL, and whole results elsewhere."""

import pytest

from cellframe.llm.queries import ORACLES, QUERIES
from conftest import SF001, SF01


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    from oracle_check import compare
    ok, msg = compare(QUERIES[name](spark, SF01).toPandas(), duck.execute(ORACLES[name]).df())
    assert ok, msg


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_one_row_per_input_row(spark, name):
    rows = QUERIES[name](spark, SF001)
    key, table = next((k, t) for k, t in (("page_id", "pages"), ("conv_id", "conversations"), ("doc_id", "documents"))
                      if k in rows.columns)
    given = spark.read.parquet(f"{SF001}/{table}.parquet").select(key)
    assert rows.count() == (given.distinct() if table == "conversations" else given).count()


def test_thirteen_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
