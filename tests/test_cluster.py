"""Queries where executors are processes of their own, which see nothing of the driver's memory."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from tests.test_queries import SF_DIR, as_rows, duck  # noqa: F401
from tidemark.plans.queries import ORACLE_SQL

ROOT = Path(__file__).resolve().parents[1]
RUN = """
import sys
from pyspark.sql import SparkSession
name, sf_dir, shared, out = sys.argv[1:]
conf = {"spark.master": "local-cluster[1,2,1024]", "spark.executor.memory": "700m", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC", "spark.driver.host": "127.0.0.1", "spark.checkpoint.dir": f"file://{shared}/checkpoint"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
import __spark_entry__
__spark_entry__.queries()[name](spark, sf_dir).write.parquet(out)
spark.stop()
"""


def run_apart(name, tmp_path):
    """A query's result as a folder, from a session with an executor of its own."""
    out = tmp_path / "out"
    env = os.environ | {"PYTHONPATH": str(ROOT), "SPARK_LOCAL_DIRS": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", RUN, name, SF_DIR, str(tmp_path), str(out)], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    return f"{out}/*.parquet"


@pytest.mark.parametrize("name", ["slot_lookup", "jdbc_bulk_load", "jdbc_apply"])
def test_on_a_cluster(duck, tmp_path, name):  # noqa: F811
    made = duck.execute(f"SELECT * FROM '{run_apart(name, tmp_path)}'")
    columns, rows = [c[0] for c in made.description], made.fetchall()
    want = duck.execute(ORACLE_SQL[name])
    assert as_rows(columns, rows) == as_rows([c[0] for c in want.description], want.fetchall())
