import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).parent.parent


def test_registry():
    import __spark_entry__ as entry

    assert len(entry.queries()) > 100 and entry.oracle_sql().keys() <= entry.queries().keys()


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py")])
def test_without_training_data_operators(tmp_path, gone):
    """Only what the driver deletes is deleted; the registry and the other tests work without it."""
    shutil.copytree(REPO, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", *gone))
    code = "import __spark_entry__ as e; n = e.queries(); assert len(n) > 100 and not any(x.startswith('op') or x == 'pipeline' for x in n); e.oracle_sql()"
    env = os.environ | {"PYTHONPATH": os.pathsep.join(p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and Path(p).resolve() != REPO)}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=env, check=True)
    if len(gone) == 1:  # all other tests can be collected, and some of each kind pass
        for arguments in (["--collect-only", "tests"], ["tests/test_entry.py", "tests/test_mappings.py", "tests/test_layout.py"]):
            run = [sys.executable, "-m", "pytest", *arguments, "-x", "-q", "-p", "no:cacheprovider", "--deselect", "tests/test_entry.py::test_without_training_data_operators"]
            left = subprocess.run(run, cwd=tmp_path / "repo", env=env, capture_output=True, text=True)
            assert left.returncode == 0, left.stdout[-2000:]


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
