"""The driver contract with and without the training-data operators."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_without_training_data_operators(tmp_path):
    """With the llm folders deleted, the rest imports and registers its queries."""
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "quernstone", "tests"):
        copy = shutil.copytree if os.path.isdir(f"{TOP}/{name}") else shutil.copy
        if os.path.exists(f"{TOP}/{name}"):
            copy(f"{TOP}/{name}", tmp_path / name)
    for left in ("none", "pipeline", "caches"):
        shutil.rmtree(tmp_path / "quernstone/llm", ignore_errors=True)
        shutil.rmtree(tmp_path / "tests/llm", ignore_errors=True)
        if left == "pipeline":
            (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
        if left == "caches":
            (tmp_path / "quernstone/llm/__pycache__").mkdir(parents=True)
        code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(x.startswith('op') and x[2].isdigit() for x in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
        done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr
