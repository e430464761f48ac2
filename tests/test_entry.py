"""The driver's entry points, with and without the llm folders."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

REPO = Path(__file__).resolve().parent.parent


def test_oracles_are_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 50


def test_entry_runs(spark):
    out = entry.entry(spark)
    assert out.columns and out.count() > 0


def test_works_without_llm(tmp_path):
    copy = tmp_path / "repo"
    copy.mkdir()
    for name in ("kinfolk", "__spark_entry__.py"):
        (copy / name).symlink_to(REPO / name) if name.endswith(".py") else copy_tree(REPO / name, copy / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(k.startswith('op') and k[2].isdigit() for k in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, check=True, env={"PYTHONPATH": str(copy), "PATH": "/usr/bin:/bin"})


def copy_tree(a: Path, b: Path) -> None:
    import shutil

    shutil.copytree(a, b, ignore=lambda d, names: {"llm", "__pycache__"} & set(names))
