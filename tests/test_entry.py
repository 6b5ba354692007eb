import shutil
import subprocess
import sys
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parent.parent
SAY = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(*q)"


@pytest.mark.parametrize("gone", [("sheafline/llm",), ("sheafline/llm", "corpus_pipeline.py")], ids=["llm", "both"])
def test_entry_without_the_corpus_operators(tmp_path, gone):
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "sheafline"):
        if (at := HERE / name).is_dir():
            shutil.copytree(at, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif at.exists():
            shutil.copy(at, tmp_path)
    for name in gone:
        if (at := tmp_path / name).is_dir():
            shutil.rmtree(at)
        else:
            at.unlink(missing_ok=True)
    got = subprocess.run([sys.executable, "-c", SAY], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert got.returncode == 0, got.stderr
    names = got.stdout.split()
    assert "q_extract_body" in names and not any(n == "pipeline" or n.startswith("op") for n in names)
