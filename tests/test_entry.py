"""The driver contract."""

import importlib.util
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() == 1


def test_sql_is_for_registered_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_llm_queries_come_with_the_subpackage():
    there = importlib.util.find_spec("millrace.llm") is not None
    assert any(n.startswith("op") and n[2].isdigit() for n in entry.queries()) == there


@pytest.mark.parametrize("gone", [["millrace/llm", "tests/llm"], ["millrace/llm", "tests/llm", "corpus_pipeline.py"]])
def test_works_without_the_subpackage(tmp_path, gone):
    """A whole copy of the repository without the llm folders registers the rest, and its tests import."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for path in map(copy.joinpath, gone):
        if path.is_dir():
            shutil.rmtree(path)
        else:
            path.unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'screen_eval' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    env = {"PYTHONPATH": str(copy), "PATH": os.environ["PATH"]}
    for command in (["-c", code], ["-m", "pytest", "tests", "--collect-only", "-q", "-p", "no:cacheprovider"]):
        done = subprocess.run([sys.executable, *command], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
        assert done.returncode == 0, done.stdout + done.stderr
