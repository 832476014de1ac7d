"""The driver contract."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert len(queries) >= 140
    assert all(callable(q) for q in queries.values())


def test_flagship(spark):
    found = entry.entry(spark)
    assert found.columns == ["i", "j", "n", "diff", "d"]
    assert found.count() > 0


def test_the_library_stands_alone(tmp_path):
    """Without the corpus operators everything else imports, and nothing imports them."""
    for name in ("dendrolith", "__spark_entry__.py", "bench.py"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "dendrolith" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e, pkgutil, importlib, dendrolith; [importlib.import_module(m.name) for m in pkgutil.walk_packages(dendrolith.__path__, 'dendrolith.')]; q = e.queries(); assert len(q) >= 140 and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
