"""The entry file with and without the subpackage for training corpora."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
COUNT = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), 'pipeline' in q, any(n.startswith('op1_') for n in q))"


def counted(folder):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", COUNT], cwd=folder, env=env, capture_output=True, text=True, check=True).stdout.split()
    return int(out[0]), out[1] == "True", out[2] == "True"


def test_queries_without_the_subpackage_and_the_pipeline(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json"))
    for gone in (["stratalake/llm", "tests/llm"], ["corpus_pipeline.py"]):
        for name in gone:
            place = tmp_path / "repo" / name
            shutil.rmtree(place, ignore_errors=True) if place.is_dir() else place.unlink(missing_ok=True)
        n, pipeline, operators = counted(tmp_path / "repo")
        assert n >= 34 and not pipeline and not operators
