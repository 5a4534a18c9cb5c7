"""Distributed order primitives vs single-task references."""

import random

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkdraft.operators.ordering import grouped_prefix_sums, with_global_index
from sparkdraft.operators.quantiles import describe, equal_width_histogram, grouped_quantiles


def test_global_index_equals_row_number(spark):
    rnd = random.Random(0)
    rows = [(i, rnd.randint(0, 50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, k long").repartition(9)
    got = {r["id"]: r["idx"] for r in with_global_index(df, ["k", "id"], "idx").collect()}
    ref = {r["id"]: r["rn"] - 1 for r in df.withColumn("rn", F.row_number().over(Window.orderBy("k", "id"))).collect()}
    assert got == ref


def test_grouped_prefix_sums_hot_group(spark):
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < 0.6 else f"g{rnd.randint(0, 30)}", i, rnd.randint(0, 9)) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, step long, v long").repartition(11)
    got = grouped_prefix_sums(df, ["g"], ["step"], ["v"], suffix="_before")
    w = Window.partitionBy("g").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    ref = df.withColumn("ref", F.coalesce(F.sum("v").over(w), F.lit(0)))
    a = {(r["g"], r["step"]): r["v_before"] for r in got.collect()}
    b = {(r["g"], r["step"]): r["ref"] for r in ref.collect()}
    assert a == b


def test_grouped_quantiles_match_pandas(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice("abc"), rnd.gauss(0, 1)) for _ in range(999)] + [("d", 5.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: (r["q25"], r["q50"], r["q90"]) for r in grouped_quantiles(df, ["g"], "x", [0.25, 0.5, 0.9]).collect()}
    pdf = pd.DataFrame(rows, columns=["g", "x"])
    for g, sub in pdf.groupby("g"):
        exp = sub["x"].quantile([0.25, 0.5, 0.9]).tolist()
        assert all(abs(a - b) < 1e-12 for a, b in zip(got[g], exp))


def test_describe_and_histogram(spark):
    vals = [1.0, 2.0, 2.0, 3.0, 10.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    d = describe(df, ["x"]).collect()[0]
    s = pd.Series(vals).describe().round(1)
    assert (d["count"], d["mean"], d["std"], d["min"], d["p25"], d["p50"], d["p75"], d["max"]) == tuple(s.tolist())
    h = {r["bin"]: r["n"] for r in equal_width_histogram(df, "x", 10).collect()}
    import numpy as np

    assert [h[i] for i in range(10)] == np.histogram(vals, bins=10)[0].tolist()


def test_explicit_range_partitions_and_index_by_key(spark):
    from sparkdraft.operators.ordering import RANGE_PARTITIONS_CONF, index_by_key

    df = spark.createDataFrame([(i, f"x{i % 7}", "w" * (i % 50)) for i in range(2000)], "id long, k string, wide string")
    ref = {r["id"]: r["rn"] - 1 for r in df.withColumn("rn", F.row_number().over(Window.orderBy("k", "id"))).collect()}
    spark.conf.set(RANGE_PARTITIONS_CONF, "13")
    try:
        got = {r["id"]: r["idx"] for r in with_global_index(df, ["k", "id"], "idx").collect()}
    finally:
        spark.conf.unset(RANGE_PARTITIONS_CONF)
    assert got == ref
    got2 = {r["id"]: r["idx"] for r in index_by_key(df, ["k", "id"], ["id"], "idx").collect()}
    assert got2 == ref


def test_empty_inputs_and_empty_partitions(spark):
    from sparkdraft.operators.sweeps import ema

    few = spark.createDataFrame([(i, "g" if i < 6 else "h", float(i)) for i in range(10)], "id long, g string, v double")
    spread = few.repartition(40)  # most partitions empty
    idx = sorted((r["id"], r["idx"]) for r in with_global_index(spread, ["id"], "idx").collect())
    assert idx == [(i, i) for i in range(10)]
    ps = {r["id"]: r["v_before"] for r in grouped_prefix_sums(spread, ["g"], ["id"], ["v"]).collect()}
    assert ps[5] == 0.0 + 1 + 2 + 3 + 4 and ps[6] == 0.0
    e = {r["id"]: r["ema"] for r in ema(spread, ["g"], "id", "v", 0.5).collect()}
    assert e[0] == 0.0 and e[1] == 0.5 and e[6] == 6.0
    empty = few.filter("id < 0")
    assert with_global_index(empty, ["id"], "idx").count() == 0
    assert grouped_prefix_sums(empty, ["g"], ["id"], ["v"]).count() == 0
    assert ema(empty, ["g"], "id", "v").count() == 0
    assert grouped_quantiles(empty, ["g"], "v", [0.5]).count() == 0
    d = describe(empty, ["v"]).collect()[0]
    assert d["count"] == 0 and d["p50"] is None


def test_unpivot(spark):
    from sparkdraft.operators.quantiles import unpivot_values

    df = spark.createDataFrame([("g", 1, 2.5), ("h", 3, None)], "k string, a int, b double")
    rows = sorted((r["k"], r["column"], r["value"]) for r in unpivot_values(df, ["k"], ["a", "b"]).collect())
    assert rows == [("g", "a", 1.0), ("g", "b", 2.5), ("h", "a", 3.0), ("h", "b", None)]


def test_range_partitions_follow_the_input(spark, monkeypatch, tmp_dir):
    from sparkdraft.operators import ordering

    spark.range(200_000).write.parquet(f"{tmp_dir}/t")
    df = spark.read.parquet(f"{tmp_dir}/t")
    assert ordering._range_partitions(df, None) is None
    monkeypatch.setattr(ordering, "RANGE_PARTITION_BYTES", 20_000)
    n = ordering._range_partitions(df.join(df.withColumnRenamed("id", "j"), df["id"] > 5), None)
    assert 8 < n < 1000  # by the tables read, not by their product
    got = ordering.with_global_index(df, ["id"]).filter("idx <> id").count()
    assert got == 0


def test_running_sums_keep_other_columns_exact(spark):
    rows = [(None if i % 7 == 0 else f"g{i // 40}", i, None if i % 5 == 0 else i, (1 << 60) + i if i % 3 else None, [i, None]) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, step long, v int, big long, xs array<int>").repartition(5)
    got = {r["step"]: r for r in grouped_prefix_sums(df, ["g"], ["step"], ["v"], inclusive=True, suffix="_up_to").collect()}
    sums = {}
    for g, step, v, big, xs in sorted(rows, key=lambda r: r[1]):
        sums[g] = sums.get(g, 0) + (v or 0)
        r = got[step]
        assert (r["g"], r["v"], r["big"], r["xs"], r["v_up_to"]) == (g, v, big, xs, sums[g])


def test_keys_have_to_be_unique(spark):
    import pytest

    from sparkdraft.operators.ordering import index_by_key
    from sparkdraft.operators.prep import prepare_splits

    df = spark.createDataFrame([(None, "b", "wide"), ("1", "a", "wide"), ("2", "a", "wide")], "id string, k string, wide string")
    assert sorted((r["idx"], r["id"]) for r in index_by_key(df, ["k", "id"], ["id"]).collect()) == [(0, "1"), (1, "2"), (2, None)]
    twice = df.unionByName(df.filter("id = '2'"))
    with pytest.raises(Exception, match="stands for several rows"):
        index_by_key(twice, ["k", "id"], ["id"]).count()
    raw = twice.select("id", F.col("k").alias("prompt"), F.col("wide").alias("response"))
    with pytest.raises(Exception, match="stands for several rows"):
        prepare_splits(raw, family="chat", dataset_name="d", source_split="train", key_col="id", seed=1, n_train=2, n_val=1, n_eval=1).count()


def test_no_text_in_checkpoints_of_document_queries(spark):
    """What is sorted and checkpointed to place and split documents holds no text."""
    from pyspark.sql import DataFrame

    from sparkdraft.plans import QUERIES

    seen, real = [], DataFrame.checkpoint
    kind = type(spark.range(1))
    real = kind.checkpoint
    try:
        kind.checkpoint = lambda self, *a, **k: (seen.append(self.columns), real(self, *a, **k))[1]
        for name in ("alpaca_normalize", "prepare_splits", "split_counts", "split_completeness", "tokenize_documents", "cache_coherence"):
            before = len(seen)
            QUERIES[name](spark, "/root/testdata/sf0.001")
            assert len(seen) > before, name
    finally:
        kind.checkpoint = real
    narrow = {"id", "source_index", "_sd_usable", "_sd_shuffle", "cache", "place"}
    assert all(set(cols) <= narrow for cols in seen), seen
