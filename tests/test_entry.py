"""The driver's contract holds without the optional subpackage, and where something that it imports is missing."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SHOW = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), any(n.startswith('op') or n == 'pipeline' for n in q))"


@pytest.mark.parametrize("broken", [False, True])
def test_entry_without_training_data_queries(tmp_path, broken):
    from parcelspark.plans import registry

    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "parcelspark", tmp_path / "parcelspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    if broken:
        (tmp_path / "parcelspark" / "llm").mkdir()
        (tmp_path / "parcelspark" / "llm" / "__init__.py").touch()
        (tmp_path / "parcelspark" / "llm" / "queries.py").write_text("import no_such_module_anywhere\n")
    run = subprocess.run([sys.executable, "-c", SHOW], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert run.stdout.split() == [str(len(registry.QUERIES)), str(len(registry.ORACLE_SQL)), "False"], run.stderr
    assert ("no_such_module_anywhere" in run.stderr) == broken
