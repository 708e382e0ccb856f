"""Only the entry module may know the training-data subpackage."""

from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_else_imports_it():
    for f in (ROOT / "maskwright").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert "llm" not in f.read_text(), f
