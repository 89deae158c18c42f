"""Write the formatted physical plan of chosen queries to docs/plans/<name>.txt.

Usage: python tools/dump_plans.py [sf_dir] name ...
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf_dir, args = args[0], args[1:]
    from cellframe.plans.registry import QUERIES, load_all
    from cellframe.session import local_session
    load_all()
    spark = local_session(8, 8)
    out_dir = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "docs", "plans")
    os.makedirs(out_dir, exist_ok=True)
    for name in args:
        df = QUERIES[name](spark, sf_dir)
        text = df._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        with open(os.path.join(out_dir, f"{name}.txt"), "w") as f:
            f.write(text)
        print(name, len(text.splitlines()), "lines")
    spark.stop()


if __name__ == "__main__":
    main()
