"""Stored tables: kept until dropped."""

import os

import pytest

from sparkdraft.llm import store


def test_stored_tables_are_read_back_and_dropped(spark, monkeypatch):
    monkeypatch.setattr(store, "_WRITTEN", [])
    df = store.stored(spark, spark.createDataFrame([(1, "a"), (None, None)], "a int, b string"), "t")
    assert sorted(map(tuple, df.collect()), key=repr) == sorted([(1, "a"), (None, None)], key=repr)
    assert store.stored(spark, df.limit(0), "t").count() == 0
    paths = [p.removeprefix("file:") for p in store._WRITTEN]
    assert all(os.path.isdir(p) for p in paths)
    assert store.drop_stored(spark) == 2
    assert not any(os.path.exists(p) for p in paths)
    with pytest.raises(Exception):
        df.collect()
