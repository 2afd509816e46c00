"""The driver's contract holds with and without the llm folders."""

from __future__ import annotations

import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from tessera.plans.queries import QUERIES, SQL

ROOT = Path(__file__).resolve().parent.parent
ASK = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


@pytest.mark.parametrize("gone", [("tessera/llm", "tests/llm"), ("tessera/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_without_the_llm_folders(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", ".hypothesis"))
    for name in gone:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", ASK], cwd=copy, env=env, capture_output=True, text=True, check=True)
    queries, sql = json.loads(done.stdout.splitlines()[-1])
    assert set(QUERIES) <= set(queries) and set(SQL) <= set(sql)
    if "tessera/llm" in gone:
        assert set(queries) == set(QUERIES) and set(sql) == set(SQL)
    assert "pipeline" not in queries


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
