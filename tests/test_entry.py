"""The entry module with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(k.startswith(('op', 'pipeline')) and k[2:3].isdigit() or k == 'pipeline' for k in e.queries()))"


def _shown(root: str) -> list[int]:
    env = {**os.environ, "PYTHONPATH": root, "PYTHONDONTWRITEBYTECODE": "1"}
    out = subprocess.run([sys.executable, "-c", SHOW], cwd=root, env=env, capture_output=True, text=True, check=True)
    return [int(x) for x in out.stdout.split()]


def test_the_other_queries_stay_without_the_subpackage(tmp_path):
    from tracewell.plans import registry

    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", "*.json")
    copy = shutil.copytree(ROOT, tmp_path / "with_pipeline_file", ignore=skip)
    assert os.path.exists(copy / "corpus_pipeline.py") and not os.path.exists(copy / "tracewell" / "llm")
    assert _shown(str(copy)) == [len(registry.queries()), len(registry.oracle_sql()), 0]
