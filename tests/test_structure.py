"""The library stands without its corpus subpackage."""

import re
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_else_imports_the_corpus_operators():
    wrong = [str(f) for f in (ROOT / "postlens").rglob("*.py") if "llm" not in f.relative_to(ROOT).parts and re.search(r"^\s*(from|import) postlens\.llm", f.read_text(), re.M)]
    assert wrong == []


def test_no_machine_local_lineage_cuts():
    assert not [str(f) for f in (ROOT / "postlens").rglob("*.py") if "localCheckpoint" in f.read_text()]
