"""Decode-log fixtures (A4) and stop-rule cases."""

import pytest
from pyspark.sql import functions as F

from sparkdraft.operators.decode import (
    COUNTER_ACCEPTED,
    COUNTER_DRAFT_TOKENS,
    COUNTER_DRAFTS,
    COUNTER_PER_POS,
    counter_totals,
    engine_totals,
    output_token_count,
    per_prompt_stats,
    positional_sums,
    positional_vector,
    repeat_means,
    replay_steps,
    run_totals,
    sampling_params,
    sd_aggregate,
)
from sparkdraft.functions.text import is_null_draft

STEP_SCHEMA = "prompt long, step long, u array<double>, q_x array<double>, p_x array<double>, xs array<int>, bonus int, resample int"
ACC = ([0.1] * 4, [0.5] * 4, [0.9] * 4)  # u*q <= p everywhere
REJ0 = ([0.99] * 4, [1.0] * 4, [0.1] * 4)  # first candidate rejected


def steps(spark, rows):
    return spark.createDataFrame(rows, STEP_SCHEMA)


def replay(spark, rows, max_new=64, eos=0):
    ran = replay_steps(steps(spark, rows), gamma=4, max_new_tokens=max_new, eos_id=eos)
    return {r["prompt"]: r for r in per_prompt_stats(ran, gamma=4).collect()}


def test_all_accepted_then_first_rejected(spark):
    out = replay(spark, [(1, 1, *ACC, [5, 6, 7, 8], 9, 10), (1, 2, *REJ0, [5, 6, 7, 8], 9, 11)])
    r = out[1]
    assert r["accepted_lens"] == [4, 0]
    assert r["total_new_tokens"] == 5 + 1
    assert (r["bonus_count"], r["resample_count"], r["finished_eos"]) == (1, 1, False)


def test_eos_inside_segment_no_cap(spark):
    # EOS at position 2 of the first segment, later steps discarded
    out = replay(spark, [(1, 1, *ACC, [5, 0, 7, 8], 9, 10), (1, 2, *ACC, [5, 6, 7, 8], 9, 10)])
    r = out[1]
    assert r["n_steps"] == 1 and r["total_new_tokens"] == 2 and r["finished_eos"] is True
    assert r["accepted_lens"] == [4]
    # EOS in a step that also crosses max_new: kept through EOS, cap not applied
    out = replay(spark, [(2, 1, *ACC, [5, 6, 7, 8], 9, 10), (2, 2, *ACC, [5, 6, 7, 0], 9, 10)], max_new=6)
    assert out[2]["total_new_tokens"] == 9 and out[2]["finished_eos"] is True


def test_overshoot_capped(spark):
    rows = [(3, s, *ACC, [5, 6, 7, 8], 9, 10) for s in range(1, 6)]
    out = replay(spark, rows, max_new=12)
    r = out[3]
    assert r["n_steps"] == 3  # 5, 10, 15 -> stop at the third step
    assert r["total_new_tokens"] == 12 and r["accepted_lens"] == [4, 4, 4]


def test_hot_prompt_spans_partitions(spark):
    rows = [(7, s, *REJ0, [5, 6, 7, 8], 9, 10) for s in range(1, 3000)]
    rows += [(p, 1, *ACC, [5, 6, 7, 8], 9, 10) for p in range(100, 140)]
    df = steps(spark, rows).repartition(9)
    ran = replay_steps(df, gamma=4, max_new_tokens=2500, eos_id=0)
    out = {r["prompt"]: r for r in per_prompt_stats(ran, gamma=4).collect()}
    assert out[7]["n_steps"] == 2500 and out[7]["total_new_tokens"] == 2500
    assert out[100]["total_new_tokens"] == 5


def test_speedup_fixture(spark):
    t = spark.createDataFrame([(1, "sd", 2.0, 4), (1, "vanilla", 8.0, 8)], "prompt long, arm string, seconds double, tokens int")
    r = run_totals(repeat_means(t)).collect()[0]
    assert (r["vanilla_time_s"], r["sd_time_s"], r["speedup"], r["tokens_per_second"]) == (8.0, 2.0, 4.0, 2.0)
    pp = spark.createDataFrame([([2],)], "accepted_lens array<int>")
    a = sd_aggregate(pp, 4).collect()[0]
    assert (a["acceptance_rate"], a["avg_accepted_tokens"], a["n_outer_steps"]) == (0.5, 2.0, 1)
    assert sd_aggregate(pp, None).collect()[0]["acceptance_rate"] == 0.0
    empty = spark.createDataFrame([([],)], "accepted_lens array<int>")
    assert sd_aggregate(empty, 4).collect()[0]["acceptance_rate"] == 0.0


def test_no_draft_and_skipped_baseline(spark):
    t = spark.createDataFrame([(1, "sd", 2.0, 4)], "prompt long, arm string, seconds double, tokens int")
    nd = run_totals(repeat_means(t), has_draft=False).collect()[0]
    assert nd["speedup"] == 1.0 and nd["vanilla_time_s"] == 2.0
    sk = run_totals(repeat_means(t), run_vanilla=False).collect()[0]
    import math

    assert math.isnan(sk["vanilla_time_s"]) and sk["speedup"] == 1.0 and sk["vanilla_tokens_per_second"] is None


def test_repeat_means_half_even(spark):
    t = spark.createDataFrame([(1, "sd", 1.0, 2), (1, "sd", 3.0, 3)], "prompt long, arm string, seconds double, tokens int")
    r = repeat_means(t).collect()[0]
    assert r["mean_s"] == 2.0 and r["mean_tokens"] == 2  # 2.5 rounds to even


def test_counters_fixture(spark):
    rows = [("r", COUNTER_DRAFTS, "3", None), ("r", COUNTER_DRAFT_TOKENS, "12", None), ("r", COUNTER_ACCEPTED, "6", None),
            ("r", COUNTER_PER_POS, None, [3.0, 2.0]), ("r", COUNTER_PER_POS, None, [0.0, 0.0, 1.0]),
            ("r", COUNTER_ACCEPTED, "oops", None)]
    m = spark.createDataFrame(rows, "run string, name string, value string, values array<double>")
    c = counter_totals(m).collect()[0]
    assert (c["acceptance_rate"], c["avg_accepted_tokens"]) == (0.5, 2.0)
    v = positional_vector(positional_sums(m)).collect()[0]["accepted_tokens_per_pos"]
    assert v == [3.0, 2.0, 1.0]
    zero = spark.createDataFrame([("z", COUNTER_DRAFTS, "0", None)], "run string, name string, value string, values array<double>")
    z = counter_totals(zero).collect()[0]
    assert (z["acceptance_rate"], z["avg_accepted_tokens"]) == (0.0, 0.0)


def test_engine_totals_last_repeat_tokens(spark):
    runs = spark.createDataFrame([("vllm", 0, 4.0, 10), ("vllm", 1, 6.0, 12)], "engine string, repeat int, seconds double, tokens long")
    r = engine_totals(runs).collect()[0]
    assert (r["time_s"], r["tokens"]) == (5.0, 12)
    outs = spark.createDataFrame([([1, 2],), ([3, 4],), (None,)], "token_ids array<int>")
    assert output_token_count(outs).collect()[0]["output_tokens"] == 4


def test_sampling_params_and_null_draft(spark):
    df = spark.createDataFrame([("greedy", 0.9, 0.5, 11, 64), ("sampling", 0.7, 0.9, 11, 32)],
                               "mode string, t double, p double, seed long, n int")
    rows = df.select(sampling_params("mode", "t", "p", "seed", "n").alias("s")).collect()
    assert tuple(rows[0]["s"]) == (64, 0.0, 1.0, None)
    assert tuple(rows[1]["s"]) == (32, 0.7, 0.9, 11)
    bad = spark.createDataFrame([("beam", 0.7, 0.9, 1, 8)], "mode string, t double, p double, seed long, n int")
    with pytest.raises(Exception):
        bad.select(sampling_params("mode", "t", "p", "seed", "n").alias("s")).collect()
    d = spark.createDataFrame([(None,), (" Vanilla ",), ("null",), ("none",), ("",), ("ckpt/x",)], "d string")
    assert [r["f"] for r in d.select(is_null_draft("d").alias("f")).collect()] == [True] * 5 + [False]


def test_generation_rows(spark):
    import pytest

    from sparkdraft.operators.decode import GENERATION_ROW, generation_rows

    prompts = spark.createDataFrame([("a", "p a"), ("b", "p b"), ("never run", "p")], "id string, prompt string")
    runs = spark.createDataFrame(
        [("a", 0, "first", [1, 2], 5, False), ("a", 1, "last", [3], 4, True), ("b", 0, "only", None, 7, None), ("no prompt", 0, "x", [1], 1, True)],
        "id string, repeat int, generation string, accepted_lens array<int>, n_new_tokens long, finished_eos boolean",
    )
    means = spark.createDataFrame([("a", "sd", 2.0, 2), ("a", "vanilla", 3.0, 2), ("b", "sd", 1.0, 1)], "id string, arm string, mean_s double, n_repeats long")
    got = {r["id"]: r for r in generation_rows(prompts, runs, means).collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"]["generation"], got["a"]["accepted_lens"], tuple(got["a"]["times"]), got["a"]["n_new_tokens"], got["a"]["n_repeats"], got["a"]["finished_eos"]) == ("last", [3], (2.0, 3.0), 4, 2, True)
    assert (got["b"]["accepted_lens"], tuple(got["b"]["times"]), got["b"]["finished_eos"]) == ([], (1.0, None), None)
    totals = spark.createDataFrame([(10.0, float("nan"), 4, 3)], "sd_time_s double, vanilla_time_s double, n_prompts long, n_repeats long")
    spread = generation_rows(prompts, runs, totals=totals)
    assert {r["id"]: (tuple(r["times"]), r["n_repeats"]) for r in spread.collect()} == {"a": ((2.5, None), 3), "b": ((2.5, None), 3)}
    assert spread.schema.simpleString() == spark.createDataFrame([], GENERATION_ROW).schema.simpleString()
    with pytest.raises(ValueError):
        generation_rows(prompts, runs)
