"""The driver's contract, with and without the corpus subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
#: The driver's environment, without this repository on the path.
ALONE = os.environ | {"PYTHONPATH": ""}


def test_contract(spark, data):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


@pytest.mark.parametrize("left", [False, True])
def test_the_rest_works_without_the_corpus_operators(tmp_path, left):
    shutil.copytree(ROOT / "tidewatch", tmp_path / "tidewatch", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(ROOT / "tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if left:  # the pipeline's file may stay behind
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') or n == 'pipeline' for n in e.queries()))"], cwd=tmp_path, env=ALONE, capture_output=True, text=True)
    assert said.stdout.split()[1:] == ["False"], said.stderr
    collected = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=tmp_path, env=ALONE, capture_output=True, text=True)
    assert collected.returncode == 0, collected.stdout[-2000:]
    passed = subprocess.run([sys.executable, "-m", "pytest", "-q", "tests/test_text_and_geo.py"], cwd=tmp_path, env=ALONE, capture_output=True, text=True)
    assert passed.returncode == 0, passed.stdout[-2000:]


def test_a_broken_corpus_package_is_reported(tmp_path):
    shutil.copytree(ROOT / "tidewatch", tmp_path / "tidewatch", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "tidewatch" / "llm").mkdir()
    (tmp_path / "tidewatch" / "llm" / "__init__.py").touch()
    (tmp_path / "tidewatch" / "llm" / "queries.py").write_text("import no_such_module_here")
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env=ALONE, capture_output=True, text=True)
    assert said.returncode != 0 and "no_such_module_here" in said.stderr
