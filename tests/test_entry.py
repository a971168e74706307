"""The driver's contract, with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

REPO = os.path.dirname(os.path.abspath(entry.__file__))


def test_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_llm(tmp_path):
    copy = tmp_path / "repo"
    # The caller's own path stays, as packages may come from it; this repository does not.
    others = [p for p in sys.path if p and os.path.abspath(p) != REPO]
    env = os.environ | {"PYTHONPATH": os.pathsep.join([str(copy), *others])}
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert not any(n.startswith('op') or n == 'pipeline' for n in q), q; assert set(e.oracle_sql()) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    # What a deletion can leave behind must not matter, and the rest's own tests pass.
    (copy / "webloom" / "llm" / "__pycache__").mkdir(parents=True)
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    some = [sys.executable, "-m", "pytest", "-q", "-x", "tests/test_twins.py", "-k", "url_parts or service_batch or telemetry_summary"]
    done = subprocess.run(some, cwd=copy, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stdout


def test_nothing_else_imports_llm():
    for folder, _, files in os.walk(f"{REPO}/webloom"):
        if folder.split(os.sep)[-1] == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                assert "webloom.llm" not in open(f"{folder}/{f}").read()
