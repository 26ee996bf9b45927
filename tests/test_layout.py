"""What the entry point promises, and that the optional subpackage stays optional."""

import ast
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).parent.parent


def test_nothing_else_imports_the_optional_subpackage():
    for path in (ROOT / "docloom").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("docloom.llm") or n == "corpus_pipeline" for n in names), path


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 40


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
