"""Python workers can import the package whatever the driver's working directory."""

import os
import subprocess
import sys
import textwrap

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_pandas_operators_run_from_another_directory(tmp_path):
    code = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {REPO!r})
        from cellframe.session import local_session
        from cellframe.operators import neighbors
        spark = local_session(2, 2)
        df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "gene long, vec array<double>")
        n = neighbors.cosine_pairs(df, "gene", "vec", 0.5, block_size=4).count()
        spark.stop()
        print("pairs", n)
    """)
    r = subprocess.run([sys.executable, "-c", code], cwd=str(tmp_path), capture_output=True, text=True, timeout=600)
    assert r.returncode == 0, r.stderr[-2000:]
    assert "pairs" in r.stdout
