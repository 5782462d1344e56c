import os
import shutil
import subprocess
import sys

import pytest

from sigwright.plans import catalog

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(folder, *more):
    """The queries that the entry module in a folder offers."""
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"
    env = os.environ | {"PYTHONPATH": os.pathsep.join([*map(str, more), str(folder)]), "PYTHONDONTWRITEBYTECODE": "1"}
    return set(subprocess.run([sys.executable, "-c", code], cwd=folder, env=env, capture_output=True, text=True, check=True).stdout.split())


@pytest.mark.parametrize("left", ["nothing", "an empty folder", "compiled files", "the pipeline"])
def test_the_library_stands_without_the_subpackage(tmp_path, left):
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{ROOT}/sigwright", tmp_path / "sigwright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    if left in ("an empty folder", "compiled files"):
        (tmp_path / "sigwright/llm/__pycache__").mkdir(parents=True)
    if left == "compiled files":
        (tmp_path / "sigwright/llm/__pycache__/queries.cpython-313.pyc").write_bytes(b"left over")
    if left == "the pipeline" and os.path.exists(f"{ROOT}/corpus_pipeline.py"):
        shutil.copy(f"{ROOT}/corpus_pipeline.py", tmp_path)
    assert names(tmp_path) == set(catalog.QUERIES)


def test_the_library_stands_without_packages_of_the_subpackage(tmp_path):
    (tmp_path / "xxhash.py").write_text("raise ImportError('absent')")
    assert names(ROOT, tmp_path) == set(catalog.QUERIES)
