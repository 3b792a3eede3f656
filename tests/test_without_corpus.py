"""The rest works without the corpus operators."""

import os
import shutil
import subprocess
import sys

from conftest import ROOT
from seqlens.plans.catalog import QUERIES


def test_entry_imports_without_the_corpus_operators(tmp_path):
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", "corpus_pipeline.py", "tests")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    code = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.oracle_sql()), len(e.queries()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=env, capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == ["True", str(len(QUERIES))], out.stderr


def test_nothing_else_imports_the_corpus_operators():
    for folder, _, names in os.walk(os.path.join(ROOT, "seqlens")):
        if os.path.basename(folder) != "llm":
            for name in names:
                if name.endswith(".py"):
                    text = open(os.path.join(folder, name)).read()
                    assert "seqlens.llm" not in text and "import llm" not in text, name
