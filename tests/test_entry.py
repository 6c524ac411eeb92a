"""The driver's contract, also where the training-data operators can't be imported."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
BLOCKED = """
import sys
class Blocked:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r}:
            raise ImportError("blocked: " + name)
sys.meta_path.insert(0, Blocked())
import __spark_entry__ as e
assert "observation_queue_day" in e.queries() and set(e.oracle_sql()) <= set(e.queries())
assert not [q for q in e.queries() if q.startswith("op") or q == "pipeline"]
"""


@pytest.mark.parametrize("name", ["ahocorasick", "orbitweave.llm", "corpus_pipeline"])
def test_entry_imports_without_the_training_data_operators(name):
    env = os.environ | {"PYTHONPATH": str(ROOT), "PYTHONWARNINGS": "ignore"}
    done = subprocess.run([sys.executable, "-c", BLOCKED.format(name=name)], cwd=ROOT, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
