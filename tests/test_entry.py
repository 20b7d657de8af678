"""The entry module works with and without the llm folders."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(folder):
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print('\\nNAMES', *q)"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, check=True)
    return out.stdout.rpartition("NAMES")[2].split()


def test_without_llm(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    plain = names(copy)
    assert len(plain) > 100 and not any(n.startswith("op") and n[2:3].isdigit() for n in plain)
    if os.path.isdir(f"{ROOT}/sluice/llm"):
        every = names(ROOT)
        assert set(plain) < set(every) and "pipeline" in every
        assert {n.split("_")[0] for n in every if n.startswith("op") and n[2:3].isdigit()} == {f"op{i}" for i in range(1, 14)}


def test_nothing_else_imports_llm():
    for d, _, files in os.walk(f"{ROOT}/sluice"):
        if "llm" in d:
            continue
        for f in files:
            if f.endswith(".py"):
                with open(f"{d}/{f}") as text:
                    assert "sluice.llm" not in text.read(), f
