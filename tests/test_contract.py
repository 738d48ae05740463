import ast
import importlib.util
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py")])
def test_imports_without_the_subpackage(tmp_path, gone):
    to = tmp_path / "repo"
    shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", *gone))
    code = "import __spark_entry__ as e; assert 'degree_rank' in e.queries() and not any(q.startswith('op') or q == 'pipeline' for q in e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=to, check=True, env=env)


def imported(tree):
    for x in ast.walk(tree):
        if isinstance(x, ast.Import):
            yield from (a.name for a in x.names)
        elif isinstance(x, ast.ImportFrom):
            yield from (f"{x.module or ''}.{a.name}" for a in x.names)


def test_library_does_not_import_the_subpackage():
    for p in (ROOT / "priospread").rglob("*.py"):
        if p.parent.name != "llm":
            assert not [m for m in imported(ast.parse(p.read_text())) if {"llm", "corpus_pipeline"} & set(m.split("."))], p
    assert importlib.util.find_spec("priospread.plans.queries")
