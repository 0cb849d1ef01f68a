import importlib
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_registry():
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and "p2_found" in names


def test_imports_without_a_session():
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries(); e.oracle_sql()"], cwd=ROOT, check=True)


def test_only_the_entry_knows_the_subpackage():
    for path in (ROOT / "tidemark").rglob("*.py"):
        if "llm" not in path.parts:
            assert "tidemark.llm" not in path.read_text(), path
