"""The driver's contract, with and without the removable subpackage."""

import os
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAYS = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(n[:2] == 'op' for n in q), 'pipeline' in q)"


def said(folder):
    run = subprocess.run([sys.executable, "-c", SAYS], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr
    return run.stdout.split()[-3:]


def test_entry_without_the_training_data_operators(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(HERE, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    total, operators, pipeline = said(copy)
    assert int(total) > 60 and operators == "0" and pipeline == "False"


def test_nothing_else_imports_them():
    for folder, _, files in os.walk(os.path.join(HERE, "weftline")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert "weftline.llm" not in open(os.path.join(folder, f), encoding="utf-8").read()


def test_flagship(spark, sf):
    import __spark_entry__

    got = __spark_entry__.entry(spark)
    assert got.columns == ["node", "depth"] and got.count() > 1
