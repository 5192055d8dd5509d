"""Keys that are learned reach the rows of a table without all of them meeting in one task."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import envelope


@pytest.mark.parametrize("bound", [20_000, 1])
def test_learned_keys(spark, monkeypatch, bound):
    monkeypatch.setattr(envelope, "MOST_TABLES", bound)
    monkeypatch.setattr(envelope, "SALTS", 8)
    rows = [(i, "s", None if i % 2 else "t", "u" if i in (200, 301) else "c", ["k" + str(i % 2)] if i >= 200 else []) for i in range(400)]
    log = spark.createDataFrame(rows, "lsn long, schema string, table string, event string, key_columns array<string>")
    log = log.where("lsn >= 0")
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    before = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ("-1", "false"), strict=True):  # as for a log that is too large to be taken for small
        spark.conf.set(n, v)
    try:
        found = envelope.learned_keys(log, order="lsn").withColumn("task", F.spark_partition_id()).collect()
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)
    assert len(found) == 400
    assert {r.lsn: r.effective_keys for r in found} == {i: ["k0"] if i % 2 == 0 and i >= 200 else ["k1"] if i % 2 and i >= 301 else None for i in range(400)}
    for name in ("t", None):
        tasks = {r.task for r in found if r.table == name}
        assert len(tasks) > 1
