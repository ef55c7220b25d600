"""The library without its corpus operators."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_else_imports_the_corpus_operators():
    for f in ROOT.joinpath("webloom").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert "webloom.llm" not in f.read_text() and "corpus_pipeline" not in f.read_text(), f


def test_entry_works_without_them(tmp_path):
    import shutil

    shutil.copytree(ROOT / "webloom", tmp_path / "webloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; n = e.queries(); assert 'html_extract_basic' in n and not any(x.startswith('op') for x in n); assert set(e.oracle_sql()) <= set(n)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "HOME": "/tmp", "PYTHONPATH": str(tmp_path)})


def test_entry_works_without_a_library_of_theirs(tmp_path):
    (tmp_path / "ahocorasick.py").write_text("raise ImportError('not there')\n")
    code = "import __spark_entry__ as e; n = e.queries(); assert 'html_extract_basic' in n and not any(x.startswith('op') for x in n)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, env={"PATH": "/usr/bin:/bin", "HOME": "/tmp", "PYTHONPATH": f"{tmp_path}:{ROOT}", "PYTHONDONTWRITEBYTECODE": "1"})


def test_a_cluster_names_its_shared_folder():
    """Without spark.checkpoint.dir a session of one machine takes a temporary folder, a cluster gets an error."""
    import pytest

    from webloom import session

    class Context:
        def __init__(self, master):
            self.master, self.folder = master, None

        def getCheckpointDir(self):  # noqa: N802
            return self.folder

        def setCheckpointDir(self, x):  # noqa: N802
            self.folder = x

        def getConf(self):  # noqa: N802
            return {}

    for master, fine in (("local", True), ("local[4]", True), ("local-cluster[2,1,1024]", False), ("spark://h:7077", False), ("yarn", False)):
        s = type("S", (), {"sparkContext": Context(master)})
        if fine:
            assert "webloom-checkpoints-" in session.checkpoint_folder(s)
        else:
            with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
                session.checkpoint_folder(s)
