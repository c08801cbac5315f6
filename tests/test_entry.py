"""The entry module works with and without the training-data folder and the pipeline."""

import os
import shutil
import subprocess
import sys

import pytest

from tests.conftest import ROOT


@pytest.mark.parametrize("without", [("tessera/llm", "tests/llm", "corpus_pipeline.py"), ("tessera/llm", "tests/llm"), ("corpus_pipeline.py",)])
def test_entry_without_parts(tmp_path, without):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", *[os.path.basename(w) for w in without]))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print('NAMES', *q)"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, capture_output=True, text=True, timeout=120,
                          env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.returncode == 0, done.stderr
    names = done.stdout.rpartition("NAMES")[2].split()
    assert "series_features" in names and "pipeline" not in names
    assert not any(n.startswith("op") for n in names) or "tessera/llm" not in without


def test_nothing_else_imports_the_training_data_folder():
    for folder, _, files in os.walk(os.path.join(ROOT, "tessera")):
        if "llm" in folder:
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f)) as text:
                    assert "tessera.llm" not in text.read(), f
