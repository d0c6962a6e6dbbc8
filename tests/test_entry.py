"""The driver contract, with and without the text operators."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]
SHOW = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(sum(n.startswith('op') or n == 'pipeline' for n in q), len(q))"


def run(folder: Path, code: str = SHOW) -> subprocess.CompletedProcess:
    return subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=folder, check=False)


def copy(to: Path, *left_out: str) -> Path:
    shutil.copytree(REPO / "plumbline", to / "plumbline", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (REPO / name).exists() and name not in left_out:
            shutil.copy(REPO / name, to)
    return to


@pytest.mark.parametrize("emptied", [False, True])
@pytest.mark.parametrize("pipeline", [False, True])
def test_the_rest_works_without_the_text_operators(tmp_path, emptied, pipeline):
    at = copy(tmp_path, *([] if pipeline else ["corpus_pipeline.py"]))
    shutil.rmtree(at / "plumbline" / "llm", ignore_errors=True)
    if emptied:
        (at / "plumbline" / "llm" / "__pycache__").mkdir(parents=True)
    done = run(at)
    assert done.returncode == 0, done.stderr
    text, whole = map(int, done.stdout.split())
    assert text == 0 and whole > 80


def test_errors_inside_the_text_operators_are_raised(tmp_path):
    at = copy(tmp_path)
    common = at / "plumbline" / "llm" / "common.py"
    if not common.exists():
        pytest.skip("no text operators")
    common.write_text("import no_such_module\n")
    assert "no_such_module" in run(at).stderr


def test_nothing_else_imports_the_text_operators():
    for path in (REPO / "plumbline").rglob("*.py"):
        if "llm" not in path.relative_to(REPO / "plumbline").parts:
            assert not re.search(r"plumbline\.llm|import llm|from \.+llm", path.read_text()), path
