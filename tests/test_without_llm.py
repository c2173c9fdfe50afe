"""The library, its entry and its queries do without the subpackage for training data."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent


def path_of(copy: Path) -> dict[str, str]:
    """The environment of a process that finds the copy first, and all that this one finds."""
    rest = [p for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), *sys.path] if p and Path(p).resolve() not in (REPO, REPO / "tests")]
    return {**os.environ, "PYTHONPATH": os.pathsep.join([str(copy), *dict.fromkeys(rest)])}


def copied(to: Path, *names: str, ignored: tuple[str, ...] = ("llm", "__pycache__")) -> None:
    for name in names:
        source = REPO / name
        shutil.copytree(source, to / name, ignore=shutil.ignore_patterns(*ignored)) if source.is_dir() else shutil.copy(source, to / name)


@pytest.mark.parametrize("pipeline", [False, True])
def test_entry_without_the_subpackage(tmp_path, pipeline):
    """With both folders gone, and the pipeline's file with them or left behind."""
    own = ("corpus_pipeline.py",) if pipeline and (REPO / "corpus_pipeline.py").exists() else ()
    copied(tmp_path, "__spark_entry__.py", "tessera", *own)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and 'pipeline' not in q and not any(n.startswith('op') for n in q), q; assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=path_of(tmp_path), capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr


@pytest.mark.parametrize("missing", ["a_module"])
def test_entry_when_a_module_cannot_be_imported(tmp_path, missing):
    """What only the subpackage needs keeps no other query away."""
    if not (REPO / "tessera" / "llm").exists():
        pytest.skip("the subpackage is not here")
    copied(tmp_path, "__spark_entry__.py", "corpus_pipeline.py", "tessera", ignored=("__pycache__",))
    head = (tmp_path / "tessera" / "llm" / "common.py").read_text()
    (tmp_path / "tessera" / "llm" / "common.py").write_text(head.replace("import numpy as np", f"raise ImportError({missing!r})"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and 'pipeline' not in q, q"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=path_of(tmp_path), capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr


def test_the_other_tests_can_be_collected_without_it(tmp_path):
    """They import nothing of the two folders; the driver runs them there."""
    copied(tmp_path, "__spark_entry__.py", "tessera", "tests")
    done = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=tmp_path, env=path_of(tmp_path), capture_output=True, text=True, check=False)
    assert done.returncode == 0 and "test_catalog" in done.stdout, done.stdout + done.stderr


def test_nothing_else_imports_it():
    for p in (REPO / "tessera").rglob("*.py"):
        if "llm" not in p.relative_to(REPO).parts:
            assert "tessera.llm" not in p.read_text(), p
