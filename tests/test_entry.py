"""The driver's entry points, with and without the corpus operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as e

ROOT = Path(__file__).resolve().parents[1]


def test_every_oracle_has_a_query():
    assert e.oracle_sql().keys() <= e.queries().keys()


def test_entry_runs(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no tables here")
    assert e.entry(spark).count() > 0


CHECK = "import __spark_entry__ as e; q = e.queries(); assert 'plan_reasons' in q and 'pipeline' not in q and not any(k.startswith('op1') for k in q); assert e.oracle_sql().keys() <= q.keys()"


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_without_the_corpus_operators(tmp_path, with_pipeline):
    """Both llm folders deleted, corpus_pipeline.py left or deleted too: the entry imports, and the rest's tests pass."""
    for folder in ("zipstrata", "tests"):
        shutil.copytree(ROOT / folder, tmp_path / folder, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", *["corpus_pipeline.py"] * with_pipeline]:
        shutil.copy(ROOT / name, tmp_path)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", CHECK], cwd=tmp_path, env=env, check=True, timeout=120)
    rest = ["tests/test_bytes.py", "tests/test_entry.py", "-k", "not without and not broken and not test_entry_runs"]
    subprocess.run([sys.executable, "-m", "pytest", "-x", "-q", "-p", "no:cacheprovider", *rest], cwd=tmp_path, env=env, check=True, timeout=300)


def test_a_broken_operator_is_not_taken_for_a_missing_one(tmp_path):
    """An import that fails inside the corpus operators is an error."""
    shutil.copytree(ROOT / "zipstrata", tmp_path / "zipstrata", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(ROOT / name, tmp_path)
    if not (tmp_path / "zipstrata/llm").is_dir():
        pytest.skip("no corpus operators here")
    at = tmp_path / "zipstrata/llm/common.py"
    at.write_text("import no_such_module\n" + at.read_text().replace("from __future__ import annotations", ""))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    found = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert found.returncode and "no_such_module" in found.stderr
