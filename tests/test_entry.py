"""The driver's contract, with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_oracle_has_a_query():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 50


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_the_rest_works_without_the_subpackage(tmp_path):
    shutil.copytree(os.path.join(ROOT, "threatscan"), tmp_path / "threatscan", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print('N', len(e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert out.returncode == 0 and int(out.stdout.rpartition("N")[2]) > 40, out.stderr[-500:]
