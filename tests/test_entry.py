"""The entry module with and without the corpus operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("gone", [["corpusloom/llm", "tests/llm"], ["corpusloom/llm", "tests/llm", "corpus_pipeline.py"]])
def test_queries_without_the_corpus_operators(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", *(Path(x).name for x in gone)))
    assert not any((copy / x).exists() for x in gone)
    code = "import __spark_entry__ as e; names = set(e.queries()); assert names and set(e.oracle_sql()) <= names; print(*sorted(names))"
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, check=True)
    names = said.stdout.split()
    assert not any(x.startswith("op") and x[2:3].isdigit() for x in names) and "pipeline" not in names and "retrieval_metrics" in names


def test_every_sql_has_a_query():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
