"""Parallel listing of run directories."""

import os

import pytest
from pyspark.sql import functions as F

from sparkdraft.sources import inventory
from sparkdraft.sources.files import inventory_scan
from tests.test_sources import write


def tree(root):
    files = {"r1/config.yaml": "abc", "r1/model/config.json": "{}", "r1/model/deep/w.safetensors": "x" * 10, "r2/config.yaml": "", "r 3/ü.txt": "é", "loose.txt": "l", "r1/.hidden": "h", "r1/_tmp/x": "t", "_out/x": "o"}
    for name, text in files.items():
        write(os.path.join(root, name), text)
    os.makedirs(os.path.join(root, "empty", "er"))
    return root


def rows(df):
    return sorted(((r["run"], r["file"], r["length"]) for r in df.collect()), key=repr)


ALL = [("r 3", "ü.txt", 2), ("r1", "config.yaml", 3), ("r1", "model/config.json", 2), ("r1", "model/deep/w.safetensors", 10), ("r2", "config.yaml", 0), (None, "loose.txt", 1)]


def test_nested_folders(spark, tmp_dir):
    tree(tmp_dir)
    for root in (tmp_dir, tmp_dir + "/", "file:" + tmp_dir, "file://" + tmp_dir):
        assert rows(inventory_scan(spark, root)) == ALL
    one = inventory_scan(spark, tmp_dir).filter("file = 'model/config.json'").first()
    assert one["path"] == f"file:{tmp_dir}/r1/model/config.json"
    assert rows(inventory_scan(spark, tmp_dir, runs=["r2", "gone", "r1/model", "_out"])) == [("r2", "config.yaml", 0)]
    assert inventory_scan(spark, tmp_dir + "/empty").count() == 0
    with pytest.raises(Exception):
        inventory_scan(spark, tmp_dir + "/nowhere").count()


def test_filters_reach_the_listing(spark, tmp_dir):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    tree(tmp_dir)
    reader = inventory.FilteredReader({"root": tmp_dir})
    rest = [GreaterThan(("length",), 0)]
    assert list(reader.pushFilters([EqualTo(("run",), "r1"), *rest])) == rest
    assert [p.names for p in reader.partitions()] == [["r1"]]
    assert list(reader.pushFilters([In(("run",), ("r1", "r2"))])) == [] and reader.runs == ["r1"]
    key = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(key, "false")
    for on in ("true", "false"):
        spark.conf.set(key, on)
        found = inventory_scan(spark, tmp_dir).filter(F.col("run").isin("r2", "r 3"))
        assert rows(found) == [r for r in ALL if r[0] in ("r2", "r 3")]
    spark.conf.set(key, before)


def test_many_runs_are_dealt_to_many_tasks(spark, tmp_dir):
    for i in range(inventory.PER_TASK * 2 + 3):
        write(os.path.join(tmp_dir, f"run{i:04d}", "a"), "x")
    found = inventory_scan(spark, tmp_dir)
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() == 3
    assert found.select("run").distinct().count() == found.count() == inventory.PER_TASK * 2 + 3
