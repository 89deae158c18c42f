"""DuckDB text of the stand-in views, inlined as CTEs in every oracle query.

The oracle may only use the raw tables, so each oracle statement is
``WITH <needed views> <body>``.  Views may depend on each other; the
dependency order below is the order they are emitted in.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    "v_cells": """
SELECT r_name AS sample, c_custkey AS cell, n_name AS batch, c_mktsegment AS celltype, c_custkey AS row_pos
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "v_expr": """
SELECT r_name AS sample, o_custkey AS cell, l_partkey AS gene, SUM(l_quantity) AS value
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY r_name, o_custkey, l_partkey""",
    "v_expr_zero": """
SELECT l_returnflag AS sample, l_orderkey AS cell, l_partkey AS gene, MAX(ROUND(l_discount * 100)) AS value
FROM lineitem GROUP BY l_returnflag, l_orderkey, l_partkey""",
    "v_gene_vocab": """
SELECT p_partkey AS gene, CAST(ROW_NUMBER() OVER (ORDER BY p_partkey) AS INT) AS id FROM part WHERE p_size <= 40""",
    "v_label_vocab": """
SELECT name, CAST(ROW_NUMBER() OVER (ORDER BY first_pos) - 1 AS INT) AS id
FROM (SELECT c_mktsegment AS name, MIN(c_custkey) AS first_pos FROM customer GROUP BY c_mktsegment) t""",
    "v_emb": """
SELECT vec_id AS gene, CAST(embedding AS DOUBLE[]) AS vec, label AS cluster FROM embeddings""",
    "v_pred": """
SELECT vec_id AS cell, CAST(embedding[1:10] AS DOUBLE[]) AS logits, label FROM embeddings""",
    "v_stream_events": """
SELECT event_id, ts, user_id, event_type, value FROM events""",
}


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the CTEs it (transitively) references.

    ``extra`` adds query-local CTEs (name -> SQL) that may reference views;
    they are emitted after the views, in the given order.
    """
    extra = dict(extra or {})
    ctes: list[tuple[str, str]] = []
    seen: set[str] = set()

    def need(text: str) -> None:
        for name in VIEWS:
            if name not in seen and re.search(rf"\b{name}\b", text):
                seen.add(name)
                need(VIEWS[name])
                ctes.append((name, VIEWS[name]))

    for sql in list(extra.values()) + [body]:
        need(sql)
    ctes.extend(extra.items())
    if not ctes:
        return body.strip()
    head = ",\n".join(f"{n} AS ({s.strip()})" for n, s in ctes)
    return f"WITH {head}\n{body.strip()}"
