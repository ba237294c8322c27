"""Without the llm folders and the pipeline, the registry still gives the library's queries."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("gone", [["provintel/llm", "tests/llm", "corpus_pipeline.py"], ["provintel/llm", "tests/llm"]])
def test_registry_without_llm(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for name in gone:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
        else:
            path.unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert q and o and 'pipeline' not in q and not any(k.startswith('op') for k in q); assert set(o) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)}, check=True, timeout=120)
