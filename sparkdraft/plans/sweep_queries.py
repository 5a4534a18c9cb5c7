"""Sweep-analytics queries.

Stand-in grid: ``lineitem`` rows are timed prompts of runtime runs:
gamma = ``l_linenumber``, temperature = ``l_discount``, length from
``l_returnflag`` (A/N/R -> 128/256/512). Each (gamma, temperature, length)
cell is aggregated to one sweep row first (speedup = avg quantity / 25.5,
acceptance = avg tax x 10, tokens/s = avg extended price / 100, rounded to
9 places) - the unique-cell precondition of the pivots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdraft.functions.text import str_to_bool
from sparkdraft.operators.sweeps import (
    param_grid,
    best_rows,
    categorical_rank,
    delta_summary,
    delta_vs_reference,
    derived_run_metrics,
    distinct_sorted,
    effect_table,
    grid_argmax,
    grid_balance,
    grouped_stats,
    infer_response_source,
    linear_fit,
    matched_deltas,
    number_tag,
    parse_runtime_name,
    pivot_grid,
    reconcile_grid,
    reliability,
    runtime_run_name,
    sampling_mode_for,
    unique_cells,
)
from sparkdraft.plans.registry import register, table

ROUND = 9
CKPT = "qwen3-0p6b-jsd"
TEMPS = [round(i / 100, 2) for i in range(11)]
METRICS = ["speedup", "acceptance_rate", "tokens_per_second"]


def sweep_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    length = F.when(F.col("l_returnflag") == "A", 128).when(F.col("l_returnflag") == "N", 256).when(
        F.col("l_returnflag") == "R", 512
    )
    cells = li.groupBy(
        F.col("l_linenumber").cast("int").alias("gamma"),
        F.col("l_discount").alias("temperature"),
        length.alias("max_new_tokens"),
    ).agg(
        F.round(F.avg("l_quantity") / 25.5, ROUND).alias("speedup"),
        F.round(F.avg("l_tax") * 10.0, ROUND).alias("acceptance_rate"),
        F.round(F.avg("l_extendedprice") / 100.0, ROUND).alias("tokens_per_second"),
        F.count(F.lit(1)).alias("n_prompts"),
    )
    return cells.withColumn("status", F.lit("ok")).withColumn(
        "run", runtime_run_name(F.lit(CKPT), "gamma", number_tag(F.format_number("temperature", 2)), "max_new_tokens")
    )


CELLS_SQL = f"""
cells AS (SELECT CAST(l_linenumber AS INTEGER) AS gamma, l_discount AS temperature,
                 CASE l_returnflag WHEN 'A' THEN 128 WHEN 'N' THEN 256 WHEN 'R' THEN 512 END AS max_new_tokens,
                 round(avg(l_quantity) / 25.5, {ROUND}) AS speedup, round(avg(l_tax) * 10.0, {ROUND}) AS acceptance_rate,
                 round(avg(l_extendedprice) / 100.0, {ROUND}) AS tokens_per_second, count(*) AS n_prompts
          FROM lineitem GROUP BY 1, 2, 3),
named AS (SELECT *, '{CKPT}_runtime_g' || gamma || '_t' || translate(printf('%.2f', temperature), '-.', 'mp') || '_max' || max_new_tokens AS run
          FROM cells)
"""


def _tname(t: float) -> str:
    return f"t{int(round(t * 100)):03d}"


PIVOT_SQL = f"WITH {CELLS_SQL} SELECT gamma, " + ", ".join(
    f"max(CASE WHEN temperature = {t} THEN speedup END) AS {_tname(t)}" for t in TEMPS
) + " FROM cells WHERE max_new_tokens = 256 GROUP BY gamma"


@register("sweep_pivot", PIVOT_SQL)
def q_sweep_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F01 + A14: speedup grid (gamma x temperature) at length 256, after the
    unique-cell check."""
    from sparkdraft.operators.sweeps import filter_ok_runs

    rows = filter_ok_runs(sweep_rows(spark, sf_dir), 256, ["gamma", "temperature", "speedup"])
    cells = unique_cells(rows, ["gamma", "temperature"], ["speedup"])
    return pivot_grid(cells, "gamma", "temperature", "speedup", TEMPS, [_tname(t) for t in TEMPS])


@register("sweep_axes", f"WITH {CELLS_SQL} SELECT DISTINCT temperature FROM cells")
def q_sweep_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct sorted temperature axis."""
    return distinct_sorted(sweep_rows(spark, sf_dir), "temperature")


def _r(c: str) -> str:
    return f"round({c}, {ROUND})"


STATS_SQL = f"WITH {CELLS_SQL} SELECT max_new_tokens, " + ", ".join(
    f"{_r(f'avg({m})')} AS {m}_mean, {_r(f'stddev_samp({m})')} AS {m}_std, {_r(f'quantile_cont({m}, 0.5)')} AS {m}_median"
    for m in METRICS
) + " FROM cells GROUP BY max_new_tokens"


@register("sweep_length_stats", STATS_SQL)
def q_sweep_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: mean / std / exact median of each metric per length."""
    g = grouped_stats(sweep_rows(spark, sf_dir), ["max_new_tokens"], METRICS)
    return g.select("max_new_tokens", *[F.round(c, ROUND).alias(c) for c in g.columns if c != "max_new_tokens"])


RELIABILITY_SQL = f"""WITH {CELLS_SQL}
SELECT max_new_tokens, count(*) AS n, count(*) FILTER (WHERE speedup > 1.0) AS n_above,
       {_r('avg(CASE WHEN speedup > 1.0 THEN 1.0 ELSE 0.0 END)')} AS frac_above, min(speedup) AS min, max(speedup) AS max
FROM cells GROUP BY max_new_tokens
"""


@register("sweep_reliability", RELIABILITY_SQL)
def q_sweep_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11 + A19: configurations beating the baseline per length."""
    r = reliability(sweep_rows(spark, sf_dir), ["max_new_tokens"], "speedup", 1.0)
    return r.withColumn("frac_above", F.round("frac_above", ROUND))


FIT_SQL = f"""WITH {CELLS_SQL},
a AS (SELECT corr(acceptance_rate, speedup) AS corr_all FROM cells),
f AS (SELECT corr(1 + acceptance_rate, speedup) AS corr, regr_slope(speedup, 1 + acceptance_rate) AS slope,
             regr_intercept(speedup, 1 + acceptance_rate) AS intercept, count(*) AS n
      FROM cells WHERE gamma = 1 AND temperature <= 0.05)
SELECT {_r('corr_all')} AS corr_all, {_r('corr')} AS corr, {_r('slope')} AS slope, {_r('intercept')} AS intercept, n,
       {_r('slope * 2.0 + intercept')} AS prediction
FROM a, f
"""


@register("sweep_fit", FIT_SQL)
def q_sweep_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12 + A13 + F07: Pearson r over all cells; least squares of speedup
    on token yield (1 + acceptance) for gamma 1, T <= 0.05; cap at yield 2."""
    rows = sweep_rows(spark, sf_dir)
    in_slice = (F.col("gamma") == 1) & (F.col("temperature") <= 0.05)
    # One pass: the slice enters the fit through null-masked inputs
    # (regression aggregates skip rows with a null operand).
    y = F.when(in_slice, F.col("speedup"))
    x = F.when(in_slice, F.lit(1.0) + F.col("acceptance_rate"))
    out = linear_fit(rows, y, x, at=2.0, extra=[F.corr("acceptance_rate", "speedup").alias("corr_all")])
    return out.select(*[F.round(c, ROUND).alias(c) if c != "n" else F.col(c) for c in ["corr_all", "corr", "slope", "intercept", "n", "prediction"]])


PAIRED_SQL = f"""WITH {CELLS_SQL},
d AS (""" + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, '{v}' AS versus, max(CASE WHEN max_new_tokens = {v} THEN {m} END) - max(CASE WHEN max_new_tokens = 128 THEN {m} END) AS delta FROM cells GROUP BY gamma, temperature"
    for m in METRICS
    for v in (256, 512)
) + f""")
SELECT metric, versus, {_r('avg(delta)')} AS mean_delta, {_r('avg(CASE WHEN delta < 0 THEN 1.0 ELSE 0.0 END)')} AS frac_negative,
       count(*) AS n_pairs, {_r('quantile_cont(delta, 0.5)')} AS median_delta
FROM d WHERE delta IS NOT NULL GROUP BY metric, versus
"""


@register("sweep_paired_deltas", PAIRED_SQL)
def q_sweep_paired_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J09 + A35 + A18: matched (gamma, T) pairs across lengths; mean,
    median and fraction negative of 256-128 and 512-128 per metric."""
    d = matched_deltas(sweep_rows(spark, sf_dir), ["gamma", "temperature"], "max_new_tokens", 128, [256, 512], METRICS)
    s = delta_summary(d, ["gamma", "temperature"], METRICS, [256, 512])
    return s.select(
        "metric", "versus",
        F.round("mean_delta", ROUND).alias("mean_delta"),
        F.round("frac_negative", ROUND).alias("frac_negative"),
        "n_pairs",
        F.round("median_delta", ROUND).alias("median_delta"),
    )


BEST_SQL = f"WITH {CELLS_SQL} " + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, arg_max(run, ({m}, -gamma, -temperature, -max_new_tokens)) AS best, max({m}) AS value FROM named WHERE isfinite({m})"
    for m in METRICS
)


@register("sweep_best", BEST_SQL)
def q_sweep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best run per metric; ties go to the first run in
    (gamma, temperature, length) order."""
    return best_rows(sweep_rows(spark, sf_dir), "run", ["gamma", "temperature", "max_new_tokens"], METRICS)


ARGMAX_SQL = f"""WITH {CELLS_SQL}
SELECT max_new_tokens, arg_max(gamma, (speedup, -gamma, -temperature)) AS gamma,
       arg_max(temperature, (speedup, -gamma, -temperature)) AS temperature, max(speedup) AS speedup
FROM cells WHERE isfinite(speedup) GROUP BY max_new_tokens
"""


@register("sweep_argmax", ARGMAX_SQL)
def q_sweep_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best (gamma, temperature) per length, missing cells ignored."""
    return grid_argmax(sweep_rows(spark, sf_dir), ["max_new_tokens"], "speedup", ["gamma", "temperature"])


VS_G1_SQL = f"""WITH {CELLS_SQL},
ref AS (SELECT temperature, max_new_tokens, max(CASE WHEN gamma = 1 THEN speedup END) AS r FROM cells GROUP BY 1, 2)
SELECT c.gamma, c.temperature, c.max_new_tokens, {_r('c.speedup - ref.r')} AS speedup_delta
FROM cells c LEFT JOIN ref ON c.temperature = ref.temperature AND c.max_new_tokens = ref.max_new_tokens
"""


@register("sweep_vs_gamma1", VS_G1_SQL)
def q_sweep_vs_gamma1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speedup relative to the gamma=1 run of the same (T, length)."""
    d = delta_vs_reference(sweep_rows(spark, sf_dir), ["temperature", "max_new_tokens"], "gamma", 1, ["speedup"])
    return d.select("gamma", "temperature", "max_new_tokens", F.round("speedup_delta", ROUND).alias("speedup_delta"))


NAMES_SQL = f"""WITH {CELLS_SQL},
p AS (SELECT run, gamma, temperature, max_new_tokens, acceptance_rate,
             regexp_matches(run, '_runtime_g(\\d+)_t([0-9mp]+)_max(\\d+)$') AS ok,
             CAST(regexp_extract(run, '_runtime_g(\\d+)_t([0-9mp]+)_max(\\d+)$', 1) AS INTEGER) AS g2,
             CAST(translate(regexp_extract(run, '_runtime_g(\\d+)_t([0-9mp]+)_max(\\d+)$', 2), 'pm', '.-') AS DOUBLE) AS t2,
             CAST(regexp_extract(run, '_runtime_g(\\d+)_t([0-9mp]+)_max(\\d+)$', 3) AS INTEGER) AS m2
      FROM named)
SELECT run, g2 AS parsed_gamma, t2 AS parsed_temperature, m2 AS parsed_max_new_tokens,
       (g2 = gamma AND t2 = temperature AND m2 = max_new_tokens) AS roundtrip,
       CASE WHEN t2 = 0 THEN 'greedy' ELSE 'sampling' END AS mode,
       CASE WHEN ends_with(run, '_target_gen') OR contains(run, '_tgen_') THEN 'target_generated' ELSE 'original' END AS response_source,
       {_r('1 + acceptance_rate')} AS token_yield
FROM p WHERE ok
"""


@register("sweep_run_names", NAMES_SQL)
def q_sweep_run_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P20 build + P21 parse round trip, P19 source inference, mode from T,
    P27 token yield."""
    rows = sweep_rows(spark, sf_dir)
    parsed = rows.withColumn("p", parse_runtime_name("run")).filter(F.col("p").isNotNull())
    return parsed.select(
        "run",
        F.col("p.gamma").alias("parsed_gamma"),
        F.col("p.temperature").alias("parsed_temperature"),
        F.col("p.max_new_tokens").alias("parsed_max_new_tokens"),
        ((F.col("p.gamma") == F.col("gamma")) & (F.col("p.temperature") == F.col("temperature"))
         & (F.col("p.max_new_tokens") == F.col("max_new_tokens"))).alias("roundtrip"),
        sampling_mode_for("p.temperature").alias("mode"),
        infer_response_source("run").alias("response_source"),
        F.round(derived_run_metrics("acceptance_rate", "gamma", "acceptance_rate")[0], ROUND).alias("token_yield"),
    )


BALANCE_SQL = f"""WITH {CELLS_SQL},
g AS (SELECT * FROM cells WHERE temperature IN (0.0, 0.05, 0.1) AND max_new_tokens IN (128, 256, 512))
SELECT count(*) AS n_cells, count(*) FILTER (WHERE max_new_tokens = 128) AS n_128,
       count(*) FILTER (WHERE max_new_tokens = 256) AS n_256, count(*) FILTER (WHERE max_new_tokens = 512) AS n_512,
       count(DISTINCT n_prompts) AS distinct_n_prompts,
       (count(*) = 63 AND count(*) FILTER (WHERE max_new_tokens = 128) = 21
        AND count(*) FILTER (WHERE max_new_tokens = 256) = 21 AND count(*) FILTER (WHERE max_new_tokens = 512) = 21
        AND count(DISTINCT n_prompts) = 1) AS balanced
FROM g
"""


@register("sweep_balance", BALANCE_SQL)
def q_sweep_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F02 + F04: balanced-grid membership and its check (7 gammas x 3
    temperatures x 3 lengths = 63 cells, 21 per length, one number of prompts)."""
    rows = sweep_rows(spark, sf_dir).filter(
        F.col("temperature").isin(0.0, 0.05, 0.1) & F.col("max_new_tokens").isin(128, 256, 512)
    )
    L = F.col("max_new_tokens")
    out = rows.agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.count_if(L == 128).alias("n_128"),
        F.count_if(L == 256).alias("n_256"),
        F.count_if(L == 512).alias("n_512"),
        F.count_distinct("n_prompts").alias("distinct_n_prompts"),
    )
    ok = (F.col("n_cells") == 63) & (F.col("n_128") == 21) & (F.col("n_256") == 21) & (F.col("n_512") == 21) & (F.col("distinct_n_prompts") == 1)
    return out.withColumn("balanced", ok)


# ---------------------------------------------------------------------------
# Training-objective study: orders as (loss, response source) runs
# ---------------------------------------------------------------------------

# The loss kinds in the reference's display order.
LOSS_ORDER = ["pretrained", "ce", "fkl", "rkl", "jsd"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def loss_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in: order priority -> loss kind, status F -> original, any other
    -> target-generated responses; metrics from the total price."""
    o = table(spark, sf_dir, "orders")
    loss = F.element_at(F.array(*[F.lit(x) for x in LOSS_ORDER]),
                        F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), F.col("o_orderpriority")).cast("int"))
    src = F.when(F.col("o_orderstatus") == "F", "original").otherwise("target_generated")
    return o.groupBy(loss.alias("loss"), src.alias("source")).agg(
        F.round(F.avg("o_totalprice") / 500000.0, ROUND).alias("acceptance_rate"),
        F.count(F.lit(1)).alias("n_prompts"),
    ).withColumn("speedup", F.round(F.lit(0.3) + F.col("acceptance_rate"), ROUND))


LOSS_SQL = f"""
lr0 AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'pretrained' WHEN '2-HIGH' THEN 'ce' WHEN '3-MEDIUM' THEN 'fkl'
                 WHEN '4-NOT SPECIFIED' THEN 'rkl' WHEN '5-LOW' THEN 'jsd' END AS loss,
               CASE WHEN o_orderstatus = 'F' THEN 'original' ELSE 'target_generated' END AS source,
               round(avg(o_totalprice) / 500000.0, {ROUND}) AS acceptance_rate, count(*) AS n_prompts
        FROM orders GROUP BY 1, 2),
lr AS (SELECT *, round(0.3 + acceptance_rate, {ROUND}) AS speedup FROM lr0)
"""

EFFECT_SQL = f"""WITH {LOSS_SQL},
a AS (SELECT loss, acceptance_rate AS ab, speedup AS sb FROM lr WHERE source = 'original'),
b AS (SELECT loss, acceptance_rate AS ao, speedup AS so FROM lr WHERE source = 'target_generated')
SELECT a.loss, ab AS acceptance_rate_base, ao AS acceptance_rate_other, {_r('ao - ab')} AS acceptance_rate_delta,
       {_r('CASE WHEN ab <> 0 THEN 100.0 * (ao - ab) / ab END')} AS acceptance_rate_gain_pct, ao - ab > 0 AS acceptance_rate_better,
       sb AS speedup_base, so AS speedup_other, {_r('so - sb')} AS speedup_delta,
       {_r('CASE WHEN sb <> 0 THEN 100.0 * (so - sb) / sb END')} AS speedup_gain_pct, so - sb > 0 AS speedup_better,
       CAST(CASE WHEN list_position({LOSS_ORDER!r}, a.loss) > 0 THEN list_position({LOSS_ORDER!r}, a.loss) ELSE 6 END AS INTEGER) AS loss_rank
FROM a JOIN b ON a.loss = b.loss
"""


@register("loss_effects", EFFECT_SQL)
def q_loss_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J07 + A36 + L04: target-generated vs original responses per loss
    (delta, relative gain %, better flag), ranked in display order."""
    e = effect_table(loss_runs(spark, sf_dir), "loss", "source", "original", "target_generated",
                     ["acceptance_rate", "speedup"])
    out = e.select(
        "loss",
        *[F.round(c, ROUND).alias(c) if c.endswith(("_delta", "_gain_pct")) else F.col(c) for c in e.columns if c != "loss"],
        categorical_rank("loss", LOSS_ORDER).cast("int").alias("loss_rank"),
    )
    return out.orderBy("loss_rank")


MEAN_GAIN_SQL = f"""WITH {LOSS_SQL},
a AS (SELECT loss, acceptance_rate AS ab, speedup AS sb FROM lr WHERE source = 'original'),
b AS (SELECT loss, acceptance_rate AS ao, speedup AS so FROM lr WHERE source = 'target_generated')
SELECT {_r('avg(ao - ab)')} AS mean_acceptance_delta, {_r('avg(so - sb)')} AS mean_speedup_delta, count(*) AS n_losses
FROM a JOIN b ON a.loss = b.loss WHERE a.loss <> 'pretrained'
"""


@register("loss_mean_gain", MEAN_GAIN_SQL)
def q_loss_mean_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean delta over the tuned (non-pretrained) losses."""
    e = effect_table(loss_runs(spark, sf_dir), "loss", "source", "original", "target_generated",
                     ["acceptance_rate", "speedup"])
    return e.filter(F.col("loss") != "pretrained").agg(
        F.round(F.avg("acceptance_rate_delta"), ROUND).alias("mean_acceptance_delta"),
        F.round(F.avg("speedup_delta"), ROUND).alias("mean_speedup_delta"),
        F.count(F.lit(1)).alias("n_losses"),
    )


VS_BASE_SQL = f"""WITH {LOSS_SQL},
base AS (SELECT source, acceptance_rate AS b FROM lr WHERE loss = 'pretrained')
SELECT lr.loss, lr.source, {_r('lr.acceptance_rate - base.b')} AS acceptance_vs_pretrained
FROM lr JOIN base ON lr.source = base.source
"""


@register("loss_vs_pretrained", VS_BASE_SQL)
def q_loss_vs_pretrained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run against the single pretrained baseline of its
    response source (an equi-join on the source; the baseline side has one
    row per source)."""
    lr = loss_runs(spark, sf_dir)
    base = lr.filter(F.col("loss") == "pretrained").select("source", F.col("acceptance_rate").alias("_b"))
    return lr.join(base, "source").select(
        "loss", "source", F.round(F.col("acceptance_rate") - F.col("_b"), ROUND).alias("acceptance_vs_pretrained")
    )


BOOL_SQL = """
SELECT o_orderkey, lower(trim(o_orderpriority)) IN ('1', 'true', 'yes', 'y', 'on') OR
       lower(trim(CASE o_orderstatus WHEN 'F' THEN 'yes' WHEN 'O' THEN ' On ' ELSE 'no' END)) IN ('1', 'true', 'yes', 'y', 'on') AS flag
FROM orders
"""


@register("str_to_bool_flags", BOOL_SQL)
def q_str_to_bool_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P26 over two string columns per order (priority text and a yes/On/no
    rendering of the status)."""
    o = table(spark, sf_dir, "orders")
    txt = F.when(F.col("o_orderstatus") == "F", "yes").when(F.col("o_orderstatus") == "O", " On ").otherwise("no")
    return o.select("o_orderkey", (str_to_bool("o_orderpriority") | str_to_bool(txt)).alias("flag"))


PLAN_SQL = f"""WITH {CELLS_SQL},
g AS (SELECT unnest(generate_series(1, 9)) AS gamma),
t AS (SELECT unnest(generate_series(0, 12)) AS k),
n AS (SELECT unnest([128, 256, 512, 1024]) AS max_new_tokens)
SELECT CAST(g.gamma AS INTEGER) AS gamma, CAST(t.k AS INTEGER) AS temperature_pct, n.max_new_tokens,
       '{CKPT}_runtime_g' || g.gamma || '_t' || translate(printf('%.2f', t.k / 100.0), '-.', 'mp') || '_max' || n.max_new_tokens AS run
FROM g, t, n WHERE NOT EXISTS (SELECT 1 FROM cells c WHERE c.gamma = g.gamma AND c.temperature = t.k / 100.0 AND c.max_new_tokens = n.max_new_tokens)
"""


@register("sweep_plan", PLAN_SQL)
def q_sweep_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J10 + J03 + P20: the cells of a parameter grid that the sweep has not run yet."""
    grid = param_grid(spark, gamma=list(range(1, 10)), temperature_pct=list(range(13)), max_new_tokens=[128, 256, 512, 1024])
    named = grid.withColumn("run", runtime_run_name(F.lit(CKPT), "gamma", number_tag(F.format_number(F.col("temperature_pct") / 100.0, 2)), "max_new_tokens"))
    done = sweep_rows(spark, sf_dir).select("run")
    return named.join(done, "run", "left_anti").select("gamma", "temperature_pct", "max_new_tokens", "run")


# Runs as they were started: a cell may have been run twice (large orders without tax are a second run).
RUNS_SQL = """
runs AS (SELECT CAST(l_linenumber AS INTEGER) AS gamma, CAST(round(l_discount * 100) AS INTEGER) AS temperature_pct,
                CASE l_returnflag WHEN 'A' THEN 128 WHEN 'N' THEN 256 WHEN 'R' THEN 512 END AS max_new_tokens,
                l_quantity >= 49 AND l_tax = 0 AS again, CASE WHEN max(l_linenumber) >= 6 AND max(l_discount) > 0.08 THEN 32 ELSE 50 END AS n_prompts
         FROM lineitem GROUP BY 1, 2, 3, 4),
wanted AS (SELECT CAST(g AS INTEGER) AS gamma, CAST(t AS INTEGER) AS temperature_pct, n AS max_new_tokens
           FROM (SELECT unnest(generate_series(1, 6)) AS g), (SELECT unnest(generate_series(0, 12)) AS t), (SELECT unnest([128, 256, 512]) AS n)),
held AS (SELECT gamma, temperature_pct, max_new_tokens, count(*) AS n_runs, min(n_prompts) AS low, max(n_prompts) AS high FROM runs GROUP BY ALL),
found AS (
  SELECT coalesce(h.gamma, w.gamma) AS gamma, coalesce(h.temperature_pct, w.temperature_pct) AS temperature_pct, coalesce(h.max_new_tokens, w.max_new_tokens) AS max_new_tokens,
         CASE WHEN h.n_runs IS NULL THEN 'missing' WHEN w.gamma IS NULL THEN 'extra' WHEN h.n_runs > 1 THEN 'duplicated' END AS finding,
         CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(NULL AS VARCHAR) AS "column", CAST(NULL AS VARCHAR) AS value
  FROM held h FULL OUTER JOIN wanted w ON h.gamma = w.gamma AND h.temperature_pct = w.temperature_pct AND h.max_new_tokens = w.max_new_tokens
  UNION ALL SELECT gamma, temperature_pct, max_new_tokens, 'uneven', n_runs, 'n_prompts', '32' FROM held WHERE low = 32)
"""


def started_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(wanted cells, runs) of a grid."""
    li = table(spark, sf_dir, "lineitem")
    length = F.when(F.col("l_returnflag") == "A", 128).when(F.col("l_returnflag") == "N", 256).when(F.col("l_returnflag") == "R", 512)
    runs = li.groupBy(
        F.col("l_linenumber").cast("int").alias("gamma"), F.round(F.col("l_discount") * 100).cast("int").alias("temperature_pct"), length.alias("max_new_tokens"), ((F.col("l_quantity") >= 49) & (F.col("l_tax") == 0)).alias("again")
    ).agg(F.when((F.max("l_linenumber") >= 6) & (F.max("l_discount") > 0.08), 32).otherwise(50).alias("n_prompts"))
    return param_grid(spark, gamma=list(range(1, 7)), temperature_pct=list(range(13)), max_new_tokens=[128, 256, 512]), runs


AXES = ["gamma", "temperature_pct", "max_new_tokens"]


@register("grid_findings", f"WITH {RUNS_SQL} SELECT * FROM found WHERE finding IS NOT NULL")
def q_grid_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F04 + J10: wanted cells without a run, runs of cells not wanted, cells run
    more than once, and cells with another number of prompts than most."""
    wanted, runs = started_runs(spark, sf_dir)
    return reconcile_grid(wanted, runs, AXES, ["n_prompts"])


@register("grid_balance", f"""WITH {RUNS_SQL}
SELECT (SELECT count(*) FROM wanted) AS n_cells, (SELECT count(*) FROM runs) AS n_runs, count(*) FILTER (WHERE finding = 'missing') AS n_missing, count(*) FILTER (WHERE finding = 'extra') AS n_extra,
       count(*) FILTER (WHERE finding = 'duplicated') AS n_duplicated, count(*) FILTER (WHERE finding = 'uneven') AS n_uneven, count(finding) = 0 AS balanced FROM found""")
def q_grid_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """findings of the grid by kind, and whether it is balanced."""
    wanted, runs = started_runs(spark, sf_dir)
    return grid_balance(wanted, runs, AXES, ["n_prompts"])
