"""The entry file with and without the subpackage llm."""

import os
import shutil
import subprocess
import sys

import pytest

from tests.conftest import ROOT

SAID = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), set(o) <= set(q), 'inventory_filter' in q, any(n == 'pipeline' or n.startswith('op1_') for n in q), callable(e.entry))"


@pytest.mark.parametrize("gone", [("loomwright/llm", "tests/llm", "corpus_pipeline.py"), ("loomwright/llm", "tests/llm"), ("corpus_pipeline.py",)])
def test_entry_without_the_subpackage(tmp_path, gone):
    copy = tmp_path / "copy"
    for name in ("loomwright", "tests"):
        shutil.copytree(f"{ROOT}/{name}", copy / name, ignore=lambda folder, names: [n for n in names if n == "__pycache__" or f"{folder}/{n}"[len(ROOT) + 1 :] in gone])
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in gone and os.path.isfile(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", copy / name)
    out = subprocess.run([sys.executable, "-c", SAID], cwd=copy, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 40 and out[1:] == ["True", "True", str("loomwright/llm" not in gone and os.path.isfile(f"{ROOT}/loomwright/llm/__init__.py")), "True"]
