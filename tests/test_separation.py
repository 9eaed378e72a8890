"""The core stands without the optional packages."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
import __spark_entry__ as entry
from ledgerline.session import local_session

assert not [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
assert set(entry.oracle_sql()) <= set(entry.queries())
print(local_session("2", app="separate").sql("SELECT 1").count(), entry.queries()["b01_enrich"](local_session("2"), sys.argv[1]).count())
"""


@pytest.mark.parametrize("pipeline_stays", [True, False])
def test_core_runs_without_the_training_data_package(tmp_path, sf, pipeline_stays):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "spark-warehouse", ".pytest_cache"))
    if not pipeline_stays and (copy / "corpus_pipeline.py").exists():
        (copy / "corpus_pipeline.py").unlink()
    assert not (copy / "ledgerline" / "llm").exists() and not (copy / "tests" / "llm").exists()
    env = {**os.environ, "PYTHONPATH": str(copy)}
    done = subprocess.run([sys.executable, "-c", SCRIPT, sf], cwd=copy, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
