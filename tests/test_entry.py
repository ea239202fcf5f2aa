import importlib
import sys

import __spark_entry__


def test_imports_without_the_training_data_operators(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)  # an import then fails
    bare = importlib.reload(__spark_entry__)
    names = set(bare.queries())
    assert "flagship_monthly_prevalence" in names and not {x for x in names if x.startswith("op") or x == "pipeline"}
    assert set(bare.oracle_sql()) <= names
    monkeypatch.undo()
    importlib.reload(__spark_entry__)


def test_nothing_else_imports_them():
    from pathlib import Path

    package = Path(__spark_entry__.__file__).parent / "fieldtally"
    for path in package.rglob("*.py"):
        assert path.parent.name == "llm" or "llm" not in path.read_text(), path
