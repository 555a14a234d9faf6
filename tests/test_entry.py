"""The entry module stands alone when any of the training-data parts are gone."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("gone", [("millrace/llm", "tests/llm", "corpus_pipeline.py"), ("millrace/llm", "tests/llm"), ("corpus_pipeline.py",), ()])
def test_entry_without_parts(tmp_path, gone):
    for name in ("millrace", "corpus_pipeline.py", "__spark_entry__.py"):
        if (REPO / name).is_dir():
            shutil.copytree(REPO / name, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif (REPO / name).exists():
            shutil.copy(REPO / name, tmp_path / name)
    for name in gone:
        if (tmp_path / name).is_dir():
            shutil.rmtree(tmp_path / name)
        elif (tmp_path / name).exists():
            (tmp_path / name).unlink()
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q) > 100, set(s) <= set(q), sum(n.startswith('op') and n[2].isdigit() for n in q), 'pipeline' in q)"
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    left = (tmp_path / "millrace/llm").exists()
    want = f"True True {13 if left else 0} {left and (tmp_path / 'corpus_pipeline.py').exists()}"
    assert run.stdout.strip() == want, run.stderr[-2000:]
