"""The driver contract on a copy of the repository without the parts that can be left out."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
IMPORT = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_training_data_part(tmp_path, pipeline):
    copy = tmp_path / "copy"
    left_out = ["__pycache__", ".git", "llm", "artifacts", "spark-warehouse"]
    if not pipeline:
        left_out.append("corpus_pipeline.py")
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(*left_out))
    assert not (copy / "shelflight" / "llm").exists()
    done = subprocess.run([sys.executable, "-c", IMPORT], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    queries, sql, has_pipeline = done.stdout.split()
    assert int(queries) == int(sql) > 40 and has_pipeline == "False"
