import os
import shutil
import subprocess
import sys

from shared import ROOT


def test_entry_works_without_the_training_data_part(tmp_path):
    shutil.copytree(os.path.join(ROOT, "marlstone"), tmp_path / "marlstone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'usage_trend' in q and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)


def test_nothing_else_imports_the_training_data_part():
    for folder, _, names in os.walk(os.path.join(ROOT, "marlstone")):
        if os.path.basename(folder) == "llm":
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    assert "marlstone.llm" not in f.read(), name


def test_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
