"""The library and its queries stand without the training-data subpackage."""
import os
import shutil
import subprocess
import sys

from .conftest import ROOT


def test_entry_imports_without_the_llm_folders(tmp_path):
    for name in ("riskfold", "__spark_entry__.py", "corpus_pipeline.py"):
        src = os.path.join(ROOT, name)
        if os.path.isdir(src):
            shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif os.path.exists(src):
            shutil.copy(src, tmp_path / name)
    code = ("import __spark_entry__ as E; q = E.queries(); s = E.oracle_sql(); "
            "assert 'describe' in q and 'describe' in s; "
            "assert not [n for n in q if n.startswith('op') and '_' in n and n[2].isdigit()] and 'pipeline' not in q")
    for keep_pipeline in (True, False):
        if not keep_pipeline and (tmp_path / "corpus_pipeline.py").exists():
            (tmp_path / "corpus_pipeline.py").unlink()
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
