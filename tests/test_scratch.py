"""Scratch tables follow the session's checkpoint folder and never hide in a local one on a cluster."""

from types import SimpleNamespace

import pytest

from lamina.scratch import checkpoint_dir, drop_path, materialize
from lamina.ship import ship


def session(master, conf=None):
    context = SimpleNamespace(master=master, applicationId="app", getCheckpointDir=lambda: None)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: conf), sparkContext=context)


def test_folder():
    assert checkpoint_dir(session("spark://host:7077", "hdfs:///shared/")) == "hdfs:///shared"
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            checkpoint_dir(session(master))


def test_tables_are_written_read_and_dropped(spark):
    table, path = materialize(spark.range(10).selectExpr("id", "id % 2 = 0 AS even"), "t", partition_by=["even"])
    assert sorted(r["id"] for r in table.where("even").collect()) == [0, 2, 4, 6, 8]
    drop_path(spark, path)
    with pytest.raises(Exception, match="(?i)not.exist|not found|FileNotFound"):
        spark.read.parquet(path)


def test_shipping_twice_is_harmless(spark):
    ship(spark)
    ship(spark)
