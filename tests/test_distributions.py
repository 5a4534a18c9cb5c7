"""Loss and distribution fixtures (A3)."""

import math

import pytest
from pyspark.sql import functions as F

from sparkdraft.operators.distributions import (
    acceptance_by_temperature,
    argmax,
    categorical_draw,
    kd_losses,
    nucleus_long,
    nucleus_mask,
    pair_positions,
    proposal_distribution,
    residual_distribution,
    softmax,
)


def pairs(spark, student, teacher, labels, mask=None):
    n = len(student)
    s = spark.createDataFrame([(0, i, [float(x) for x in student[i]]) for i in range(n)], "seq long, pos int, logits array<double>")
    t = spark.createDataFrame([(0, i, [float(x) for x in teacher[i]]) for i in range(n)], "seq long, pos int, logits array<double>")
    m = mask or [True] * n
    lab = spark.createDataFrame([(0, i, labels[i], m[i]) for i in range(n)], "seq long, pos int, label int, mask boolean")
    return pair_positions(s, t, lab)


def losses(df, **kw):
    return {r["kind"]: r for r in kd_losses(df, **kw).collect()}


def test_masked_ce(spark):
    lg = [[3, 0, 0], [0, 4, 0], [0, 0, 5], [1, 1, 1]]
    out = losses(pairs(spark, lg, lg, [-100, 1, 2, -100]), alpha=1.0)
    assert out["ce"]["loss"] == pytest.approx(3.5654496281, abs=1e-9)
    assert out["ce"]["kd"] == 0.0


def test_fkl_rkl_jsd(spark):
    z = [0, 0, 0]
    df = pairs(spark, [z, [4, 0, -2], z], [z, [-1, 3, 0], z], [-100, -100, 1])
    out = losses(df, alpha=1.0)
    assert out["fkl"]["kd"] == pytest.approx(3.7709020082, abs=1e-9)
    assert out["rkl"]["kd"] == pytest.approx(3.8847646802, abs=1e-9)
    assert out["jsd"]["kd"] == pytest.approx(0.6004466515, abs=1e-9)
    assert out["fkl"]["kd"] != out["rkl"]["kd"]


def test_jsd_symmetric(spark):
    z = [0, 0]
    a = losses(pairs(spark, [z, [2, -1], z], [z, [-1, 2], z], [-100, -100, 0]))["jsd"]["kd"]
    b = losses(pairs(spark, [z, [-1, 2], z], [z, [2, -1], z], [-100, -100, 0]))["jsd"]["kd"]
    assert a == pytest.approx(0.5022822095, abs=1e-9) and abs(a - b) < 1e-12


def test_response_mask_excludes_positions(spark):
    st = [[0, 0], [3, -3], [-3, 3], [0, 0]]
    te = [[0, 0], [-3, 3], [-3, 3], [0, 0]]
    lab = [-100, 0, 1, -100]
    assert losses(pairs(spark, st, te, lab), alpha=1.0)["fkl"]["kd"] == pytest.approx(2.9851642611, abs=1e-9)
    masked = losses(pairs(spark, st, te, lab, [False, False, True, False]), alpha=1.0)["fkl"]["kd"]
    assert masked == pytest.approx(5.9703285221, abs=1e-9)


def test_temperature_and_mix(spark):
    z = [0, 0, 0]
    df = pairs(spark, [z, [4, 0, -2], z], [z, [-1, 3, 0], z], [-100, -100, 1])
    t2 = losses(df, temperature=2.0, alpha=0.25)
    r = t2["fkl"]
    assert r["loss"] == pytest.approx(0.25 * r["kd"] + 0.75 * r["ce"], abs=1e-12)
    with pytest.raises(ValueError):
        kd_losses(df, temperature=0.0)


def test_chunking_invariance(spark):
    import random

    rnd = random.Random(0)
    st = [[rnd.gauss(0, 1) for _ in range(11)] for _ in range(10)]
    te = [[rnd.gauss(0, 1) for _ in range(11)] for _ in range(10)]
    lab = [rnd.choice([-100, 1, 2, 3]) for _ in range(10)]
    df = pairs(spark, st, te, lab)
    a = losses(df)
    b = losses(df.repartition(7))
    for k in ("fkl", "rkl", "jsd", "ce"):
        assert a[k]["loss"] == pytest.approx(b[k]["loss"], abs=1e-9)


def test_top_p_edges(spark):
    df = spark.createDataFrame([([0.6, 0.3, 0.1],), ([0.95, 0.04, 0.01],), ([0.25, 0.25, 0.5],)], "p array<double>")
    got = [r["m"] for r in df.select(nucleus_mask(F.col("p"), 0.9).alias("m")).collect()]
    assert got[0] == [True, True, False]  # 0.6, 0.9 <= 0.9 kept; crossing token dropped
    assert got[1] == [True, False, False]  # first token alone above p is still kept
    assert got[2] == [True, True, True] or got[2] == [True, False, True]
    all_kept = [r["m"] for r in df.select(nucleus_mask(F.col("p"), 1.0).alias("m")).collect()]
    assert all(all(m) for m in all_kept)


def test_nucleus_long_matches_array(spark):
    df = spark.createDataFrame([(0, 0, [2.0, 1.0, 0.5, -1.0, 0.0])], "seq long, pos int, logits array<double>")
    long = {r["tok"]: r["keep"] for r in nucleus_long(df, "logits", 1.0, 0.8).collect()}
    arr = df.select(nucleus_mask(softmax("logits", 1.0), 0.8).alias("m")).collect()[0]["m"]
    assert [long[i] for i in range(5)] == arr


def test_argmax_greedy_residual_draw(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0, 0.0],)], "a array<double>")
    r = df.select(argmax("a").alias("i"), proposal_distribution("a", "greedy", 0.0, 1.0).alias("q")).collect()[0]
    assert r["i"] == 1
    assert r["q"][1] == pytest.approx(1 / (1 + 3e-9)) and sum(r["q"]) == pytest.approx(1.0)
    p = spark.createDataFrame([([0.5, 0.5, 0.0], [0.5, 0.5, 0.0])], "p array<double>, q array<double>")
    res = p.select(residual_distribution(F.col("p"), F.col("q")).alias("r")).collect()[0]["r"]
    assert res == [1.0, 0.0, 0.0]  # no residual mass -> argmax of p
    d = spark.createDataFrame([([0.2, 0.3, 0.5], 0.45), ([0.2, 0.3, 0.5], 0.1), ([0.2, 0.3, 0.5], 0.999)], "p array<double>, u double")
    assert [r["t"] for r in d.select(categorical_draw(F.col("p"), F.col("u")).alias("t")).collect()] == [1, 0, 2]


def test_expected_acceptance_identical_is_one(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0, 2.0])], "student array<double>, teacher array<double>")
    r = acceptance_by_temperature(df, [1.0]).collect()[0]
    assert r["mean_acceptance"] == pytest.approx(1.0)
    p = [math.exp(1) / (math.exp(1) + math.exp(2)), math.exp(2) / (math.exp(1) + math.exp(2))]
    assert r["mean_entropy_target"] == pytest.approx(-sum(x * math.log(x) for x in p))


def test_losses_from_chunks_equal_the_whole(spark, tmp_dir):
    import random

    from sparkdraft.operators.distributions import loss_states, losses_of, merge_losses
    from sparkdraft.sources.committed import append_runs, read_runs

    rnd = random.Random(1)
    st, te = ([[rnd.gauss(0, 1) for _ in range(7)] for _ in range(24)] for _ in range(2))
    lab = [rnd.choice([-100, 1, 2, 3]) for _ in range(24)]
    df = pairs(spark, st, te, lab, [i % 3 > 0 for i in range(24)]).withColumn("chunk", (F.col("pos") % 5).cast("string"))
    whole = losses(df, temperature=2.0, alpha=0.3)
    for c in ("0", "1", "1", "2", "3", "0", "4", "nothing"):
        append_runs(spark, loss_states(df.filter(F.col("chunk") == c), temperature=2.0, by=["chunk"]), tmp_dir, f"chunk-{c}", key="chunk")
    stored = read_runs(spark, tmp_dir)
    assert stored.count() == 5
    got = {r["kind"]: r for r in losses_of(merge_losses(stored), temperature=2.0, alpha=0.3).collect()}
    for k, r in whole.items():
        assert (got[k]["kd"], got[k]["ce"], got[k]["loss"]) == pytest.approx((r["kd"], r["ce"], r["loss"]), abs=1e-12)
        assert got[k]["n_positions"] == r["n_positions"]
    none = losses(df.limit(0))
    assert all((r["kd"], r["ce"], r["n_positions"]) == (0.0, 0.0, 0) for r in none.values())
    by_chunk = losses_of(loss_states(df, by=["chunk"]), by=["chunk"])
    assert by_chunk.count() == 20 and by_chunk.columns[0] == "chunk"
