"""The entry point works with and without the optional folders."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_queries_have_sql():
    import __spark_entry__ as e
    from keyloom import catalog

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(catalog.queries()) == set(catalog.oracle_sql()) <= set(e.queries())


def test_without_the_optional_folders(tmp_path):
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    shutil.copytree(REPO / "keyloom", tmp_path / "keyloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'scan_full' in q and 'pipeline' not in q and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
