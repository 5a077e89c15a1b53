"""The entry points with and without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SAY = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n.startswith('op') for n in q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"


def said(folder):
    return subprocess.run([sys.executable, "-c", SAY], cwd=folder, capture_output=True, text=True, check=True, timeout=120).stdout.split()


def copied(folder, *without):
    shutil.copytree(ROOT, folder, ignore=lambda d, names: [n for n in names if n in {".git", "__pycache__", *without}])
    return folder


def test_without_the_corpus_operators(tmp_path):
    all_, ops, pipeline, _ = said(ROOT)
    for n, gone in enumerate((("llm",), ("llm", "corpus_pipeline.py"))):
        rest, none, absent, whole = said(copied(tmp_path / f"copy{n}", *gone))
        assert (int(none), absent, whole) == (0, "False", "True")
        assert int(rest) >= int(all_) - int(ops) - (pipeline == "True") > 100
