"""Plan-shape guards: no pair explosion, one shuffle on the per-cell path."""

import re

import pytest

from cellframe.plans.registry import QUERIES, load_all

load_all()
SKIP_BUILD = {"communities", "communities_quality", "cluster_annotate"}  # iterative: their rounds run while building


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SKIP_BUILD))
def test_no_cartesian_or_nested_loop_join(spark, name):
    from conftest import SF001
    plan = QUERIES[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan), plan[:2000]


def test_flagship_shuffles_expression_rows_once_by_cell(spark):
    from conftest import SF001
    df = QUERIES["annotate_tokens"](spark, SF001)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # exactly one exchange of any kind carries rows of single genes; the range pass reuses it, and the other
    # exchanges on cells move cell-table rows or whole sequences
    lines = plan.splitlines()
    li = max(i for i, ln in enumerate(lines) if "l_partkey" in ln and "FileScan" in ln)
    assert li
    big = [ln for i, ln in enumerate(lines)
           if re.search(r"Exchange hashpartitioning\((sample|cell|o_custkey)", ln) and "Reused" not in ln
           and i + 1 < len(lines) and re.search(r"\bgene#|l_partkey#", lines[i + 1])]
    reused = [ln for ln in lines if "ReusedExchange" in ln and "l_quantity" in ln]
    assert len(big) == 1, big
    assert reused, "range pass should reuse the cell exchange"
