"""The entry point, also without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def test_without_the_subpackage(tmp_path):
    for what in ("packmill", "__spark_entry__.py"):
        (shutil.copytree if os.path.isdir(f"{ROOT}/{what}") else shutil.copy)(f"{ROOT}/{what}", tmp_path / what)
    shutil.rmtree(tmp_path / "packmill" / "llm", ignore_errors=True)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and not any(q.startswith('op') or q == 'pipeline' for q in e.queries())"], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert said.returncode == 0, said.stderr
