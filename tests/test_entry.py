"""The driver's entry with and without the parts that may be removed."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SAYS = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), any(n.startswith('op') or n == 'pipeline' for n in q), e.entry.__name__)"


@pytest.mark.parametrize("gone", [("tidemark/llm", "corpus_pipeline.py"), ("tidemark/llm",), ("tidemark/llm", "tests/llm")])
def test_entry_without_removed_parts(tmp_path, gone):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    shutil.copytree(ROOT / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("__pycache__"))
    for name in gone:
        path = tmp_path / name
        shutil.rmtree(path, ignore_errors=True) if path.is_dir() else path.unlink(missing_ok=True)
    out = subprocess.run([sys.executable, "-c", SAYS], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n, sql, llm, _ = out.stdout.split()[-4:]
    assert int(n) == int(sql) > 40 and llm == "False"


def test_errors_inside_a_part_are_not_hidden(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    (tmp_path / "tidemark" / "llm").mkdir()
    (tmp_path / "tidemark" / "llm" / "__init__.py").write_text("")
    (tmp_path / "tidemark" / "llm" / "catalog.py").write_text("import there_is_no_such_module")
    out = subprocess.run([sys.executable, "-c", SAYS], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode != 0 and "there_is_no_such_module" in out.stderr
