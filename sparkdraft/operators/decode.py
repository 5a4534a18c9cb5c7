"""Speculative-decoding logs -> per-prompt stats -> run summaries.

W10-W12 replay logged verification steps (accept prefix, committed
segment, stop rule); A01-A08 aggregate per-prompt and per-run numbers;
P15/P16/P28 derive runtime settings. Aggregations are partial (map-side
combined); the one list kept per prompt (accepted lengths) holds only the
steps that ran, at most ``max_new_tokens``. The only order-dependent step,
the stop rule, uses ``grouped_prefix_sums`` so a prompt with a third of
all steps is still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdraft.functions.numeric import usable_denominator

from sparkdraft.functions.text import col_, is_null_draft
from sparkdraft.operators.distributions import PROB_FLOOR
from sparkdraft.operators.ordering import grouped_prefix_sums

# Engine counter names.
COUNTER_DRAFTS = "vllm:spec_decode_num_drafts"
COUNTER_DRAFT_TOKENS = "vllm:spec_decode_num_draft_tokens"
COUNTER_ACCEPTED = "vllm:spec_decode_num_accepted_tokens"
COUNTER_PER_POS = "vllm:spec_decode_num_accepted_tokens_per_pos"


def accept_flags(u: str | Column, q_x: str | Column, p_x: str | Column) -> Column:
    """X06 over the gamma candidates of a step: u*max(q,1e-12) <= p."""
    return F.zip_with(
        F.zip_with(col_(u), col_(q_x), lambda a, b: F.struct(a.alias("u"), b.alias("q"))),
        col_(p_x),
        lambda uq, p: (uq["u"] * F.greatest(uq["q"], F.lit(PROB_FLOOR))) <= p,
    )


def accepted_prefix(flags: str | Column, gamma: int | Column) -> Column:
    """Number of leading accepted candidates (gamma if all accepted)."""
    g = F.lit(gamma) if isinstance(gamma, int) else gamma
    first_reject = F.array_position(col_(flags), False)
    return F.when(first_reject == 0, g).otherwise(first_reject - 1).cast("int")


def commit_segment(xs: str | Column, n: Column, gamma: int, bonus: str | Column, resample: str | Column) -> Column:
    """The accepted drafts plus the bonus token (all accepted) or the
    resampled token (rejection)."""
    last = F.when(n == gamma, col_(bonus)).otherwise(col_(resample))
    return F.concat(F.slice(col_(xs), 1, n), F.array(last))


def replay_steps(
    steps: DataFrame,
    *,
    gamma: int,
    max_new_tokens: int,
    eos_id: int | None,
    prompt_col: str = "prompt",
    step_col: str = "step",
) -> DataFrame:
    """Steps (prompt, step, u[], q_x[], p_x[], xs[], bonus,
    resample) -> the steps that actually ran, with their contribution.

    A prompt stops at the first step whose segment holds EOS (kept through
    the EOS, no length cap) or whose cumulative length reaches
    ``max_new_tokens`` (capped). Later logged steps are discarded. Running
    lengths come from a distributed grouped prefix sum.
    """
    flags = accept_flags("u", "q_x", "p_x")
    n = accepted_prefix(flags, gamma)
    s = steps.select(prompt_col, step_col, n.alias("n_accepted"), "xs", "bonus", "resample")
    seg = commit_segment("xs", F.col("n_accepted"), gamma, "bonus", "resample")
    eos_pos = F.array_position(seg, eos_id) if eos_id is not None else F.lit(0).cast("long")
    s = s.select(
        prompt_col,
        step_col,
        "n_accepted",
        F.size(seg).cast("long").alias("seg_len"),
        eos_pos.cast("long").alias("eos_pos"),
        (eos_pos > 0).cast("long").alias("has_eos"),
    )
    ps = grouped_prefix_sums(s, [prompt_col], [step_col], ["seg_len", "has_eos"], suffix="_before")
    ran = ps.filter((F.col("seg_len_before") < max_new_tokens) & (F.col("has_eos_before") == 0))
    contributed = F.when(
        F.col("has_eos") == 1, F.col("seg_len_before") + F.col("eos_pos")
    ).otherwise(F.least(F.col("seg_len_before") + F.col("seg_len"), F.lit(max_new_tokens)))
    return ran.select(
        prompt_col,
        step_col,
        "n_accepted",
        "seg_len",
        (F.col("has_eos") == 1).alias("has_eos"),
        contributed.alias("tokens_after"),
    )


def per_prompt_stats(ran: DataFrame, *, gamma: int, prompt_col: str = "prompt", step_col: str = "step") -> DataFrame:
    """SDStats per prompt from replayed steps: accepted_lens (step order,
    bounded by max_new_tokens), totals, EOS flag, bonus/resample counts."""
    return ran.groupBy(prompt_col).agg(
        F.count(F.lit(1)).alias("n_steps"),
        F.sum("n_accepted").cast("long").alias("n_accepted"),
        F.max("tokens_after").cast("long").alias("total_new_tokens"),
        F.bool_or("has_eos").alias("finished_eos"),
        F.count_if(F.col("n_accepted") == gamma).alias("bonus_count"),
        F.count_if(F.col("n_accepted") < gamma).alias("resample_count"),
        F.transform(
            F.array_sort(F.collect_list(F.struct(F.col(step_col).alias("s"), F.col("n_accepted").alias("n")))),
            lambda e: e["n"],
        ).alias("accepted_lens"),
    )


def sd_aggregate(per_prompt: DataFrame, gamma: int | None) -> DataFrame:
    """Pool accepted lengths over prompts (and repeats).

    acceptance = sum(accepted) / (n_steps * gamma), 0 when gamma is null or
    there are no steps; avg accepted per step; token/call/second totals
    when those columns are present.
    """
    lens = F.col("accepted_lens")
    n_steps = F.sum(F.size(lens))
    total_acc = F.sum(F.aggregate(lens, F.lit(0).cast("long"), lambda a, b: a + b))
    extra = [
        F.coalesce(F.sum(c), F.lit(0)).alias(c)
        for c in ("total_new_tokens", "target_calls", "draft_calls", "draft_forward_s", "target_forward_s")
        if c in per_prompt.columns
    ]
    agg = per_prompt.agg(n_steps.alias("n_outer_steps"), total_acc.alias("_acc"), *extra)
    steps = F.coalesce(F.col("n_outer_steps"), F.lit(0))
    acc = F.coalesce(F.col("_acc"), F.lit(0))
    rate = (
        F.when(steps > 0, acc.cast("double") / (steps * F.lit(gamma)).cast("double")).otherwise(F.lit(0.0))
        if gamma is not None
        else F.lit(0.0)
    )
    mean_acc = F.when(steps > 0, acc.cast("double") / steps.cast("double")).otherwise(F.lit(0.0))
    return agg.select(
        rate.alias("acceptance_rate"),
        mean_acc.alias("avg_accepted_tokens"),
        steps.cast("long").alias("n_outer_steps"),
        *[F.col(c) for c in agg.columns if c not in ("n_outer_steps", "_acc")],
    )


def repeat_means(timings: DataFrame, prompt_col: str = "prompt", arm_col: str = "arm") -> DataFrame:
    """Per prompt and arm, mean seconds over repeats and the mean
    token count rounded half-to-even."""
    return timings.groupBy(prompt_col, arm_col).agg(
        F.avg("seconds").alias("mean_s"),
        F.rint(F.avg("tokens")).cast("long").alias("mean_tokens"),
        F.count(F.lit(1)).alias("n_repeats"),
    )


def run_totals(means: DataFrame, *, has_draft: bool = True, run_vanilla: bool = True,
               arm_col: str = "arm") -> DataFrame:
    """Sum the per-prompt means into one run row.

    tokens/s = sd tokens / sd time (0 if no time); speedup = vanilla time /
    sd time. Without a draft the SD pass is the vanilla pass (speedup 1.0);
    with the baseline skipped vanilla time is NaN and speedup 1.0.
    """
    sd = F.col(arm_col) == "sd"
    va = F.col(arm_col) == "vanilla"
    agg = means.agg(
        F.count_distinct(F.col(means.columns[0])).alias("n_prompts"),
        F.coalesce(F.sum(F.when(sd, F.col("mean_s"))), F.lit(0.0)).alias("sd_time_s"),
        F.coalesce(F.sum(F.when(sd, F.col("mean_tokens"))), F.lit(0)).alias("sd_tokens"),
        F.coalesce(F.sum(F.when(va, F.col("mean_s"))), F.lit(0.0)).alias("_v_s"),
        F.coalesce(F.sum(F.when(va, F.col("mean_tokens"))), F.lit(0)).alias("_v_tok"),
    )
    if not has_draft:
        v_s, v_tok = F.col("sd_time_s"), F.col("sd_tokens")
    elif run_vanilla:
        v_s, v_tok = F.col("_v_s"), F.col("_v_tok")
    else:
        v_s, v_tok = F.lit(float("nan")), F.lit(0).cast("long")
    sd_s = F.col("sd_time_s")
    tps = F.when(usable_denominator(sd_s), F.col("sd_tokens") / sd_s).otherwise(F.lit(0.0))
    v_tps = F.when(usable_denominator(v_s) & (v_tok > 0), v_tok / v_s)
    speedup = F.when(usable_denominator(v_s) & usable_denominator(sd_s), v_s / sd_s).otherwise(F.lit(1.0))
    return agg.select(
        F.col("n_prompts").cast("long"),
        sd_s.alias("sd_time_s"),
        v_s.alias("vanilla_time_s"),
        F.col("sd_tokens").cast("long").alias("sd_tokens"),
        v_tok.cast("long").alias("vanilla_tokens"),
        tps.alias("tokens_per_second"),
        v_tps.alias("vanilla_tokens_per_second"),
        speedup.alias("speedup"),
    )


def engine_totals(runs: DataFrame, engine_col: str = "engine", repeat_col: str = "repeat") -> DataFrame:
    """Per engine, time = mean over repeats of whole-run time; tokens
    from the last repeat only (hazard H12)."""
    per_repeat = runs.groupBy(engine_col, repeat_col).agg(
        F.sum("seconds").alias("run_s"), F.sum("tokens").alias("run_tokens")
    )
    out = per_repeat.groupBy(engine_col).agg(
        F.avg("run_s").alias("time_s"),
        F.max_by("run_tokens", repeat_col).alias("tokens"),
        F.count(F.lit(1)).alias("n_repeats"),
    )
    return out.withColumn("tokens_per_second", F.when(usable_denominator(F.col("time_s")), F.col("tokens") / F.col("time_s")).otherwise(F.lit(0.0)))


def counter_totals(metrics: DataFrame, run_col: str = "run") -> DataFrame:
    """A05 + A07: sum the three scalar spec-decode counters per run
    (missing or non-numeric values count 0) and derive acceptance
    (accepted / draft tokens) and accepted per draft, 0 on zero
    denominators."""
    v = F.coalesce(F.col("value").try_cast("double"), F.lit(0.0))

    def total(name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("name") == name, v)), F.lit(0.0))

    agg = metrics.groupBy(run_col).agg(
        total(COUNTER_DRAFTS).alias("num_drafts"),
        total(COUNTER_DRAFT_TOKENS).alias("num_draft_tokens"),
        total(COUNTER_ACCEPTED).alias("num_accepted_tokens"),
    )
    return agg.select(
        run_col,
        *[F.col(c).cast("long").alias(c) for c in ("num_drafts", "num_draft_tokens", "num_accepted_tokens")],
        F.when(usable_denominator(F.col("num_draft_tokens")), F.col("num_accepted_tokens") / F.col("num_draft_tokens"))
        .otherwise(F.lit(0.0))
        .alias("acceptance_rate"),
        F.when(usable_denominator(F.col("num_drafts")), F.col("num_accepted_tokens") / F.col("num_drafts"))
        .otherwise(F.lit(0.0))
        .alias("avg_accepted_tokens"),
    )


def positional_sums(metrics: DataFrame, run_col: str = "run") -> DataFrame:
    """Element-wise sum of ragged per-position vectors (shorter ones
    count as zero-padded), long form (run, pos, total)."""
    x = metrics.filter(F.col("name") == COUNTER_PER_POS).select(
        run_col, F.posexplode(F.coalesce(F.col("values"), F.array().cast("array<double>"))).alias("pos", "v")
    )
    return x.groupBy(run_col, "pos").agg(F.sum(F.coalesce(F.col("v"), F.lit(0.0))).alias("total"))


def positional_vector(long_sums: DataFrame, run_col: str = "run") -> DataFrame:
    """A06 as arrays: one vector per run, bounded by the draft length."""
    return long_sums.groupBy(run_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "total"))), lambda e: e["total"]).alias(
            "accepted_tokens_per_pos"
        )
    )


def output_token_count(outputs: DataFrame, ids_col: str = "token_ids") -> DataFrame:
    """Total generated tokens; a missing output counts 0."""
    # size(NULL) is -1 when ANSI mode is off, so test for null explicitly.
    n = F.when(F.col(ids_col).isNull(), F.lit(0)).otherwise(F.size(ids_col))
    return outputs.agg(F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("output_tokens"))


def sampling_params(mode: str | Column, temperature: str | Column, top_p: str | Column,
                    seed: str | Column, max_new_tokens: str | Column) -> Column:
    """Greedy -> T 0, top_p 1, no seed; sampling -> as given + seed;
    any other mode fails the query."""
    m = F.lower(col_(mode))
    greedy = m == "greedy"
    sampling = m == "sampling"
    checked_t = F.when(greedy, F.lit(0.0)).when(sampling, col_(temperature).cast("double")).otherwise(
        F.raise_error(F.concat(F.lit("unknown sampling mode "), col_(mode).cast("string")))
    )
    return F.struct(
        col_(max_new_tokens).cast("int").alias("max_tokens"),
        checked_t.alias("temperature"),
        F.when(greedy, F.lit(1.0)).otherwise(col_(top_p).cast("double")).alias("top_p"),
        F.when(sampling, col_(seed).cast("long")).alias("seed"),
    )


def amortised_times(rows: DataFrame, sd_total: Column, vanilla_total: Column, n_prompts: Column) -> DataFrame:
    """Run time / n_prompts stamped on every row; the vanilla share is
    null when the vanilla time is not a positive number."""
    per_sd = F.when(n_prompts > 0, sd_total / n_prompts).otherwise(F.lit(0.0))
    per_v = F.when((n_prompts > 0) & usable_denominator(vanilla_total), vanilla_total / n_prompts)
    return rows.withColumn("sd_s_avg", per_sd).withColumn("vanilla_s_avg", per_v)


# The fields of a generation row.
GENERATION_ROW = (
    "id string, prompt string, generation string, accepted_lens array<int>, times struct<sd_s_avg: double, vanilla_s_avg: double>, "
    "n_new_tokens bigint, n_repeats bigint, finished_eos boolean"
)


def generation_rows(prompts: DataFrame, runs: DataFrame, means: DataFrame | None = None, totals: DataFrame | None = None) -> DataFrame:
    """One row per prompt that was run, as ``GENERATION_ROW`` has it.

    ``prompts``: (id, prompt). ``runs``: (id, repeat, generation, accepted_lens,
    n_new_tokens, finished_eos), of which the last repeat of a prompt counts
    (the larger row of two under one number). ``means`` (``repeat_means`` with the prompt
    as id): seconds of each prompt by arm, and its number of repeats. An engine
    that times only the whole run gives ``totals`` instead, one row (sd_time_s,
    vanilla_time_s, n_prompts, n_repeats) spread evenly over the prompts
    (``amortised_times``). Without a positive vanilla time that share is null.
    Prompts without a run give no row, and runs without a prompt neither; ids are strings.
    """
    if (means is None) == (totals is None):
        raise ValueError("generation rows take either times per prompt or totals of the run")
    fields = ["generation", "accepted_lens", "n_new_tokens", "finished_eos"]
    row = F.struct(*fields)
    last = runs.groupBy(F.col("id").cast("string").alias("id")).agg(F.max_by(row, F.struct("repeat", row)).alias("r")).select("id", "r.*")
    rows = prompts.select(F.col("id").cast("string").alias("id"), F.col("prompt").cast("string").alias("prompt")).join(last, "id")
    if means is not None:
        arm = lambda name, c: F.max(F.when(F.col("arm") == name, F.col(c)))
        times = means.groupBy(F.col("id").cast("string").alias("id")).agg(
            arm("sd", "mean_s").alias("sd_s_avg"), arm("vanilla", "mean_s").alias("vanilla_s_avg"), F.coalesce(arm("sd", "n_repeats"), F.lit(0)).alias("n_repeats")
        )
        timed = rows.join(times, "id", "left")
    else:
        one = totals.select(*[F.col(c).alias(f"_{c}") for c in ("sd_time_s", "vanilla_time_s", "n_prompts", "n_repeats")], F.lit(1).alias("_one"))
        beside = rows.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one")  # a single row
        timed = amortised_times(beside, F.col("_sd_time_s"), F.col("_vanilla_time_s"), F.col("_n_prompts")).withColumn("n_repeats", F.col("_n_repeats"))
    return timed.select(
        "id",
        "prompt",
        "generation",
        F.coalesce(F.col("accepted_lens").cast("array<int>"), F.array().cast("array<int>")).alias("accepted_lens"),
        F.struct(F.col("sd_s_avg").cast("double").alias("sd_s_avg"), F.col("vanilla_s_avg").cast("double").alias("vanilla_s_avg")).alias("times"),
        F.col("n_new_tokens").cast("bigint").alias("n_new_tokens"),
        F.col("n_repeats").cast("bigint").alias("n_repeats"),
        F.col("finished_eos").cast("boolean").alias("finished_eos"),
    )


def has_draft(draft: str | Column) -> Column:
    """P16 negated: a real draft model is configured."""
    return ~is_null_draft(draft)
