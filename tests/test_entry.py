import shutil
import subprocess
import sys
from pathlib import Path

HOME = Path(__file__).resolve().parents[1]
ASK = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
assert not [x for x in [*e.queries(), *e.oracle_sql()] if x.startswith("op") or x == "pipeline"]
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert e.entry(spark).count() > 0
"""


def test_without_the_operators_for_training_data(tmp_path):
    """A folder that has neither them nor their tests, with and without the pipeline's module."""
    for name in ("tidemill", "__spark_entry__.py", "corpus_pipeline.py"):
        source, target = HOME / name, tmp_path / name
        if source.is_dir():
            shutil.copytree(source, target, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif source.exists():
            shutil.copy(source, target)
    for _ in range(2):
        run = subprocess.run([sys.executable, "-B", "-c", ASK], cwd=tmp_path, capture_output=True, text=True, timeout=300)
        assert run.returncode == 0, run.stderr[-2000:]
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
