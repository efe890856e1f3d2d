"""The entry points: the flagship query runs, names agree, and the rest works without the training-data operators."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["user_id", "t", "smooth"] and df.count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_llm():
    code = (
        "import sys\n"
        "class Hide:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name in ('chunkwright.llm', 'corpus_pipeline'): raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, Hide())\n"
        "import __spark_entry__ as e\n"
        "names = e.queries()\n"
        "assert 'temporal_highpass' in names and not any(n.startswith('op') and n[2].isdigit() for n in names) and 'pipeline' not in names\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
