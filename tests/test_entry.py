"""The driver's contract, with and without the training-data operators."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_runs(spark, sf_dir):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["doc_id", "node_count", "depth", "reason", "matches"] and df.count() > 0


def test_oracles_have_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_llm(tmp_path):
    skip = shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    code = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert len(q) > 100 and set(o) <= set(q); print(len([n for n in q if n.startswith('op')]))"
    got = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "repo", env=os.environ | {"PYTHONPATH": str(tmp_path / "repo")}, capture_output=True, text=True)
    assert got.returncode == 0, got.stderr
    assert got.stdout.split()[-1] == "0"


def test_nothing_else_imports_llm():
    for top, _, names in os.walk(os.path.join(ROOT, "leafmill")):
        for n in names:
            if n.endswith(".py") and os.sep + "llm" not in top:
                assert "leafmill.llm" not in open(os.path.join(top, n)).read()
