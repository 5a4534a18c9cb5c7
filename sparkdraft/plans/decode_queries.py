"""Decode-log queries over ``events``.

Stand-ins:
* verification steps: prompt = ``user_id``, step = ``event_id``, gamma 4;
  per-candidate uniforms u, draft probabilities q_x and target
  probabilities p_x are fixed integer arithmetic of ``value`` (in cents),
  ``props.k`` and ``event_id``;
  draft tokens, bonus and resample tokens are ids in [0, 50) with EOS 0.
* timings: ``click`` and ``purchase`` rows are SD repeats, all others vanilla
  repeats;
  seconds = ``value``, tokens = ``props.k``.
* engine runs: engine = ``event_type``, repeat = the event's date.
* counters: one metric row per event: run = ``event_type``, counter name
  chosen by ``user_id``, value ``props.k`` (some non-numeric), ragged
  per-position vectors from ``k``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdraft.operators.decode import (
    COUNTER_ACCEPTED,
    COUNTER_DRAFT_TOKENS,
    COUNTER_DRAFTS,
    COUNTER_PER_POS,
    GENERATION_ROW,
    counter_totals,
    engine_totals,
    generation_rows,
    per_prompt_stats,
    positional_sums,
    positional_vector,
    repeat_means,
    replay_steps,
    run_totals,
    sd_aggregate,
)
from sparkdraft.operators.discovery import run_summary
from sparkdraft.plans.registry import register, table
from sparkdraft.session import scratch_folder
from sparkdraft.sources.files import jsonl_scan, jsonl_sink
from sparkdraft.plugins.scorers import ScoreTable

GAMMA, MAX_NEW, EOS_ID, VOCAB = 4, 64, 0, 50
ROUND = 9
# Moduli and multipliers of the stand-in arithmetic. Integer
# arithmetic followed by one division gives bit-identical doubles in any
# engine (no reassociation of floating products).
U_MUL, U_MOD, Q_MUL, Q_MOD, P_MUL, P_MOD, EV_MUL = 7919, 10007, 131, 997, 71, 991, 104729


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def step_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.round(F.col("value") * 100).cast("long").alias("cents"), _k().alias("k")
    )
    c, k, e = F.col("cents"), F.col("k").cast("long"), F.col("event_id")
    r = range(GAMMA)
    return ev.select(
        F.col("user_id").alias("prompt"),
        F.col("event_id").alias("step"),
        F.array(*[((c * (i + 1) * U_MUL + e * EV_MUL) % U_MOD) / F.lit(float(U_MOD)) for i in r]).alias("u"),
        F.array(*[F.lit(0.05) + F.lit(0.9) * (((k * (i + 3) * Q_MUL) % Q_MOD) / F.lit(float(Q_MOD))) for i in r]).alias("q_x"),
        F.array(*[F.lit(0.05) + F.lit(0.9) * (((k * (i + 5) * P_MUL + c) % P_MOD) / F.lit(float(P_MOD))) for i in r]).alias("p_x"),
        F.array(*[((k * (i + 1) + e) % VOCAB).cast("int") for i in r]).alias("xs"),
        ((k + 7) % VOCAB).cast("int").alias("bonus"),
        ((k * 3 + 1) % VOCAB).cast("int").alias("resample"),
    )


def _steps_sql() -> str:
    us = ", ".join(f"((cents * {i + 1} * {U_MUL} + event_id * {EV_MUL}) % {U_MOD}) / {float(U_MOD)}" for i in range(GAMMA))
    qs = ", ".join(f"0.05 + 0.9 * (((k * {i + 3} * {Q_MUL}) % {Q_MOD}) / {float(Q_MOD)})" for i in range(GAMMA))
    ps = ", ".join(f"0.05 + 0.9 * (((k * {i + 5} * {P_MUL} + cents) % {P_MOD}) / {float(P_MOD)})" for i in range(GAMMA))
    xs = ", ".join(f"CAST((k * {i + 1} + event_id) % {VOCAB} AS INTEGER)" for i in range(GAMMA))
    flags = " ".join(
        f"WHEN NOT (u[{i + 1}] * greatest(q[{i + 1}], 1e-12) <= p[{i + 1}]) THEN {i}" for i in range(GAMMA)
    )
    return f"""
ev AS (SELECT event_id, user_id, CAST(round(value * 100) AS BIGINT) AS cents,
              CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) AS BIGINT) AS k FROM events),
arr AS (SELECT user_id AS prompt, event_id AS step, [{us}]::DOUBLE[] AS u, [{qs}]::DOUBLE[] AS q, [{ps}]::DOUBLE[] AS p,
               [{xs}] AS xs, CAST((k + 7) % {VOCAB} AS INTEGER) AS bonus, CAST((k * 3 + 1) % {VOCAB} AS INTEGER) AS resample FROM ev),
nn AS (SELECT *, CASE {flags} ELSE {GAMMA} END AS n FROM arr),
sg AS (SELECT *, list_concat(xs[1:n], [CASE WHEN n = {GAMMA} THEN bonus ELSE resample END]) AS seg FROM nn),
st AS (SELECT prompt, step, n, len(seg) AS seg_len, coalesce(list_position(seg, {EOS_ID}), 0) AS eos_pos,
              CASE WHEN coalesce(list_position(seg, {EOS_ID}), 0) > 0 THEN 1 ELSE 0 END AS has_eos FROM sg),
w AS (SELECT *, coalesce(sum(seg_len) OVER (PARTITION BY prompt ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cb,
              coalesce(sum(has_eos) OVER (PARTITION BY prompt ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS eb FROM st),
ran AS (SELECT *, CASE WHEN has_eos = 1 THEN cb + eos_pos ELSE least(cb + seg_len, {MAX_NEW}) END AS tokens_after
        FROM w WHERE cb < {MAX_NEW} AND eb = 0),
pp AS (SELECT prompt, count(*) AS n_steps, CAST(sum(n) AS BIGINT) AS n_accepted, CAST(max(tokens_after) AS BIGINT) AS total_new_tokens,
              bool_or(has_eos = 1) AS finished_eos, count(*) FILTER (WHERE n = {GAMMA}) AS bonus_count,
              count(*) FILTER (WHERE n < {GAMMA}) AS resample_count, string_agg(CAST(n AS VARCHAR), ',' ORDER BY step) AS accepted_lens
       FROM ran GROUP BY prompt)
"""


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    ran = replay_steps(step_log(spark, sf_dir), gamma=GAMMA, max_new_tokens=MAX_NEW, eos_id=EOS_ID)
    return per_prompt_stats(ran, gamma=GAMMA)


@register("decode_replay", f"WITH {_steps_sql()} SELECT * FROM pp")
def q_decode_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted prefix per step, committed segment, stop at EOS or
    max_new_tokens; per-prompt SD stats."""
    pp = replayed(spark, sf_dir)
    return pp.select(
        "prompt",
        "n_steps",
        "n_accepted",
        "total_new_tokens",
        "finished_eos",
        "bonus_count",
        "resample_count",
        F.array_join("accepted_lens", ",").alias("accepted_lens"),
    )


SD_AGG_SQL = f"""WITH {_steps_sql()}
SELECT round(CASE WHEN sum(n_steps) > 0 THEN sum(n_accepted) / (sum(n_steps) * {GAMMA}) ELSE 0.0 END, {ROUND}) AS acceptance_rate,
       round(CASE WHEN sum(n_steps) > 0 THEN sum(n_accepted) / sum(n_steps) ELSE 0.0 END, {ROUND}) AS avg_accepted_tokens,
       CAST(sum(n_steps) AS BIGINT) AS n_outer_steps, CAST(sum(total_new_tokens) AS BIGINT) AS total_new_tokens
FROM pp
"""


@register("sd_aggregate", SD_AGG_SQL)
def q_sd_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A01 + SO1: pooled acceptance over all prompts' replayed steps."""
    agg = sd_aggregate(replayed(spark, sf_dir), GAMMA)
    return agg.select(
        F.round("acceptance_rate", ROUND).alias("acceptance_rate"),
        F.round("avg_accepted_tokens", ROUND).alias("avg_accepted_tokens"),
        "n_outer_steps",
        F.col("total_new_tokens").cast("long").alias("total_new_tokens"),
    )


def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("user_id").alias("prompt"),
        F.when(F.col("event_type").isin("click", "purchase"), "sd").otherwise("vanilla").alias("arm"),
        F.col("value").alias("seconds"),
        _k().alias("tokens"),
    )


TIMING_SQL = """
t AS (SELECT user_id AS prompt, CASE WHEN event_type IN ('click', 'purchase') THEN 'sd' ELSE 'vanilla' END AS arm, value AS seconds,
             CAST(json_extract_string(props, '$.k') AS INTEGER) AS tokens FROM events),
m AS (SELECT prompt, arm, avg(seconds) AS mean_s, CAST(round_even(avg(tokens), 0) AS BIGINT) AS mean_tokens, count(*) AS n_repeats
      FROM t GROUP BY prompt, arm)
"""


@register("prompt_timings", f"WITH {TIMING_SQL} SELECT prompt, arm, round(mean_s, {ROUND}) AS mean_s, mean_tokens, n_repeats FROM m")
def q_prompt_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A02 + X13: per-prompt repeat means, tokens rounded half-to-even."""
    m = repeat_means(timings(spark, sf_dir))
    return m.select("prompt", "arm", F.round("mean_s", ROUND).alias("mean_s"), "mean_tokens", "n_repeats")


RUN_TOTALS_SQL = f"""WITH {TIMING_SQL},
a AS (SELECT count(DISTINCT prompt) AS n_prompts,
             coalesce(sum(mean_s) FILTER (WHERE arm = 'sd'), 0.0) AS sd_s, coalesce(sum(mean_tokens) FILTER (WHERE arm = 'sd'), 0) AS sd_tok,
             coalesce(sum(mean_s) FILTER (WHERE arm = 'vanilla'), 0.0) AS v_s, coalesce(sum(mean_tokens) FILTER (WHERE arm = 'vanilla'), 0) AS v_tok
      FROM m)
SELECT CAST(n_prompts AS BIGINT) AS n_prompts, round(sd_s, {ROUND}) AS sd_time_s, round(v_s, {ROUND}) AS vanilla_time_s,
       CAST(sd_tok AS BIGINT) AS sd_tokens, CAST(v_tok AS BIGINT) AS vanilla_tokens,
       round(CASE WHEN sd_s > 0 THEN sd_tok / sd_s ELSE 0.0 END, {ROUND}) AS tokens_per_second,
       round(CASE WHEN v_s > 0 AND v_tok > 0 THEN v_tok / v_s END, {ROUND}) AS vanilla_tokens_per_second,
       round(CASE WHEN v_s > 0 AND sd_s > 0 THEN v_s / sd_s ELSE 1.0 END, {ROUND}) AS speedup
FROM a
"""


@register("run_totals", RUN_TOTALS_SQL)
def q_run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A03 + X14: summed means -> tokens/s and time-ratio speedup."""
    t = run_totals(repeat_means(timings(spark, sf_dir)))
    return t.select(
        "n_prompts",
        *[F.round(c, ROUND).alias(c) for c in ("sd_time_s", "vanilla_time_s")],
        "sd_tokens",
        "vanilla_tokens",
        *[F.round(c, ROUND).alias(c) for c in ("tokens_per_second", "vanilla_tokens_per_second", "speedup")],
    )


ENGINE_SQL = f"""
WITH r AS (SELECT event_type AS engine, CAST(ts AS DATE) AS repeat, sum(value) AS run_s,
                  sum(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS run_tokens FROM events GROUP BY 1, 2),
e AS (SELECT engine, avg(run_s) AS time_s, arg_max(run_tokens, repeat) AS tokens, count(*) AS n_repeats FROM r GROUP BY engine)
SELECT engine, round(time_s, {ROUND}) AS time_s, CAST(tokens AS BIGINT) AS tokens, n_repeats,
       round(CASE WHEN time_s > 0 THEN tokens / time_s ELSE 0.0 END, {ROUND}) AS tokens_per_second
FROM e
"""


@register("engine_totals", ENGINE_SQL)
def q_engine_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-run time averaged over repeats, tokens of the last repeat."""
    ev = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("engine"),
        F.to_date("ts").alias("repeat"),
        F.col("value").alias("seconds"),
        _k().alias("tokens"),
    )
    e = engine_totals(ev)
    return e.select(
        "engine",
        F.round("time_s", ROUND).alias("time_s"),
        F.col("tokens").cast("long").alias("tokens"),
        "n_repeats",
        F.round("tokens_per_second", ROUND).alias("tokens_per_second"),
    )


COUNTER_NAMES = [COUNTER_DRAFTS, COUNTER_DRAFT_TOKENS, COUNTER_ACCEPTED, COUNTER_PER_POS, "vllm:other_counter"]


def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_type", "user_id", _k().alias("k"))
    k = F.col("k")
    return ev.select(
        F.col("event_type").alias("run"),
        F.element_at(F.array(*[F.lit(n) for n in COUNTER_NAMES]), (F.col("user_id") % 5 + 1).cast("int")).alias("name"),
        F.when(k % 17 == 0, F.lit("n/a")).otherwise(k.cast("string")).alias("value"),
        F.slice(F.array(*[(k % m).cast("double") for m in (3, 5, 7, 11)]), 1, (k % 4 + 1).cast("int")).alias("values"),
    )


_METRIC_SQL = f"""
mr AS (SELECT event_type AS run, ['{"', '".join(COUNTER_NAMES)}'][user_id % 5 + 1] AS name,
              CASE WHEN k % 17 = 0 THEN 'n/a' ELSE CAST(k AS VARCHAR) END AS value,
              [CAST(k % 3 AS DOUBLE), CAST(k % 5 AS DOUBLE), CAST(k % 7 AS DOUBLE), CAST(k % 11 AS DOUBLE)][1:k % 4 + 1] AS vals
       FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))
"""

COUNTERS_SQL = f"""WITH {_METRIC_SQL},
c AS (SELECT run, coalesce(sum(coalesce(TRY_CAST(value AS DOUBLE), 0.0)) FILTER (WHERE name = '{COUNTER_DRAFTS}'), 0.0) AS d,
             coalesce(sum(coalesce(TRY_CAST(value AS DOUBLE), 0.0)) FILTER (WHERE name = '{COUNTER_DRAFT_TOKENS}'), 0.0) AS dt,
             coalesce(sum(coalesce(TRY_CAST(value AS DOUBLE), 0.0)) FILTER (WHERE name = '{COUNTER_ACCEPTED}'), 0.0) AS a
      FROM mr GROUP BY run)
SELECT run, CAST(d AS BIGINT) AS num_drafts, CAST(dt AS BIGINT) AS num_draft_tokens, CAST(a AS BIGINT) AS num_accepted_tokens,
       round(CASE WHEN dt > 0 THEN a / dt ELSE 0.0 END, {ROUND}) AS acceptance_rate,
       round(CASE WHEN d > 0 THEN a / d ELSE 0.0 END, {ROUND}) AS avg_accepted_tokens
FROM c
"""


@register("counter_metrics", COUNTERS_SQL)
def q_counter_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A05 + A07: counter sums by name per run, derived acceptance."""
    c = counter_totals(metric_rows(spark, sf_dir))
    return c.select(
        "run",
        "num_drafts",
        "num_draft_tokens",
        "num_accepted_tokens",
        F.round("acceptance_rate", ROUND).alias("acceptance_rate"),
        F.round("avg_accepted_tokens", ROUND).alias("avg_accepted_tokens"),
    )


PER_POS_SQL = f"""WITH {_METRIC_SQL},
x AS (SELECT run, unnest(generate_series(0, len(vals) - 1)) AS pos, unnest(vals) AS v FROM mr WHERE name = '{COUNTER_PER_POS}')
SELECT run, CAST(pos AS INTEGER) AS pos, sum(v) AS total FROM x GROUP BY run, pos
"""


@register("accepted_per_position", PER_POS_SQL)
def q_accepted_per_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ragged per-position accepted-token vectors summed per run."""
    return positional_sums(metric_rows(spark, sf_dir))


@register("accepted_vectors", f"""WITH {_METRIC_SQL},
x AS (SELECT run, unnest(generate_series(0, len(vals) - 1)) AS pos, unnest(vals) AS v FROM mr WHERE name = '{COUNTER_PER_POS}'),
t AS (SELECT run, pos, sum(v) AS total FROM x GROUP BY run, pos)
SELECT run, string_agg(CAST(CAST(total AS BIGINT) AS VARCHAR), ',' ORDER BY pos) AS accepted_tokens_per_pos FROM t GROUP BY run""")
def q_accepted_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A06 as one vector per run, as a summary document holds it (written out as text)."""
    vectors = positional_vector(positional_sums(metric_rows(spark, sf_dir)))
    return vectors.select("run", F.array_join(F.transform("accepted_tokens_per_pos", lambda x: x.cast("bigint").cast("string")), ",").alias("accepted_tokens_per_pos"))


AMORTISED_SQL = f"""WITH {TIMING_SQL},
tot AS (SELECT count(DISTINCT prompt) AS n, coalesce(sum(mean_s) FILTER (WHERE arm = 'sd'), 0.0) AS sd_s,
               coalesce(sum(mean_s) FILTER (WHERE arm = 'vanilla'), 0.0) AS v_s FROM m)
SELECT m.prompt, m.arm, round(CASE WHEN tot.n > 0 THEN tot.sd_s / tot.n ELSE 0.0 END, {ROUND}) AS sd_s_avg,
       round(CASE WHEN tot.n > 0 AND tot.v_s > 0 THEN tot.v_s / tot.n END, {ROUND}) AS vanilla_s_avg
FROM m, tot
"""


@register("amortised_prompt_times", AMORTISED_SQL)
def q_amortised_prompt_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-run SD and vanilla times divided by the prompt count,
    stamped on every per-prompt row (the run total is one row, joined by
    broadcast)."""
    from sparkdraft.operators.decode import amortised_times

    m = repeat_means(timings(spark, sf_dir))
    tot = run_totals(m).select("n_prompts", F.col("sd_time_s").alias("_sd"), F.col("vanilla_time_s").alias("_v"))
    j = m.withColumn("_k", F.lit(1)).join(F.broadcast(tot.withColumn("_k", F.lit(1))), "_k").drop("_k")
    out = amortised_times(j, F.col("_sd"), F.col("_v"), F.col("n_prompts"))
    return out.select(
        "prompt", "arm", F.round("sd_s_avg", ROUND).alias("sd_s_avg"), F.round("vanilla_s_avg", ROUND).alias("vanilla_s_avg")
    )


RUN_SUMMARY_SQL = f"""
WITH t AS ({RUN_TOTALS_SQL}), p AS ({SD_AGG_SQL}),
q AS (SELECT round(coalesce(avg(CASE WHEN l.quality = 1 OR d.text = d.lang THEN 1.0 ELSE 0.0 END), 0.0), {ROUND}) AS score FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
SELECT 'draft-run' AS model, 'target-8b' AS target, 'draft-1b' AS draft, acceptance_rate, avg_accepted_tokens, vanilla_time_s, sd_time_s, speedup, tokens_per_second,
       score AS exact_match, 'greedy' AS mode, {GAMMA} AS num_assistant_tokens, n_prompts, 1 AS n_warmup, 3 AS n_repeats,
       speedup AS engine_speedup, acceptance_rate AS engine_acceptance_rate, n_outer_steps AS engine_n_outer_steps, false AS engine_batched
FROM t, p, q
"""


@register("run_summary", RUN_SUMMARY_SQL)
def q_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run-summary document (A01-A03, A30) of one run, from the pooled
    replay, the summed timings and the declared scores."""
    from sparkdraft.functions.text import clean

    labelled = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    texts = labelled.select(
        clean("text").alias("generation"), F.when(F.col("quality") == 1, clean("text")).otherwise(F.col("lang")).alias("target_generation")
    )
    doc = run_summary(
        run_totals(repeat_means(timings(spark, sf_dir))),
        sd_aggregate(replayed(spark, sf_dir), GAMMA),
        ScoreTable().scores(texts, ["exact_match_vs_target"]),
        model="draft-run", target="target-8b", draft="draft-1b", engine="hf",
        decoding={"mode": "greedy", "max_new_tokens": MAX_NEW, "num_assistant_tokens": GAMMA, "temperature": 0.0, "top_p": 1.0},
        n_warmup=1, n_repeats=3,
    )
    r = lambda c, name: F.round(c, ROUND).alias(name)
    return doc.select(
        "model", "target", "draft",
        *[r(c, c) for c in ("acceptance_rate", "avg_accepted_tokens", "vanilla_time_s", "sd_time_s", "speedup", "tokens_per_second")],
        r(F.try_element_at("quality_score", F.lit("exact_match_vs_target")), "exact_match"),
        F.col("decoding.mode").alias("mode"), F.col("decoding.num_assistant_tokens").alias("num_assistant_tokens"),
        "n_prompts", "n_warmup", "n_repeats",
        r(F.col("engines.hf.speedup"), "engine_speedup"), r(F.col("engines.hf.acceptance_rate"), "engine_acceptance_rate"),
        F.col("engines.hf.n_outer_steps").alias("engine_n_outer_steps"), F.col("engines.hf.batched").alias("engine_batched"),
    )


GENERATIONS_SQL = f"""WITH {_steps_sql()}, {TIMING_SQL},
d AS (SELECT doc_id, CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, 1, strpos(text, chr(10)) - 1) ELSE text END AS prompt, regexp_extract(text, '(?s)^[^\\n]*\\n(.*)$', 1) AS generation FROM documents)
SELECT CAST(d.doc_id AS VARCHAR) AS id, d.prompt, d.generation, pp.accepted_lens, round(s.mean_s, {ROUND}) AS sd_s_avg, round(v.mean_s, {ROUND}) AS vanilla_s_avg,
       pp.total_new_tokens AS n_new_tokens, coalesce(s.n_repeats, 0) AS n_repeats, pp.finished_eos
FROM d JOIN pp ON pp.prompt = d.doc_id LEFT JOIN m s ON s.prompt = d.doc_id AND s.arm = 'sd' LEFT JOIN m v ON v.prompt = d.doc_id AND v.arm = 'vanilla'
"""


@register("generation_rows", GENERATIONS_SQL)
def q_generation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generation rows of an evaluation (id, prompt, generation, accepted
    lengths, mean times by arm, tokens, repeats, end), written as JSON Lines and
    read again. Stand-in: a document is a prompt (first line) and its generation
    (the rest); the user of that number has its decode log and timings."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("prompt"), F.regexp_extract("text", r"(?s)^[^\n]*\n(.*)$", 1).alias("generation")
    )
    stats = replayed(spark, sf_dir).select(F.col("prompt").alias("id"), F.lit(0).alias("repeat"), "accepted_lens", F.col("total_new_tokens").alias("n_new_tokens"), "finished_eos")
    rows = generation_rows(docs.select("id", "prompt"), stats.join(docs.select("id", "generation"), "id"), repeat_means(timings(spark, sf_dir)).withColumnRenamed("prompt", "id"))
    path = scratch_folder(spark, "generations")
    jsonl_sink(rows, path)
    read = jsonl_scan(spark, path, GENERATION_ROW)
    return read.select(
        "id", "prompt", "generation", F.array_join("accepted_lens", ",").alias("accepted_lens"), F.round("times.sd_s_avg", ROUND).alias("sd_s_avg"), F.round("times.vanilla_s_avg", ROUND).alias("vanilla_s_avg"), "n_new_tokens", "n_repeats", "finished_eos"
    )
