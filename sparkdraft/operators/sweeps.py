"""Sweep analytics over run summaries (A10-A20, A33, A35, A36, J01-J05,
J07, J09, L04-L06, W07-W09, W13, F01-F07, P19-P21, P26, P27).

Inputs are flat sweep rows (one per run) or logged curves. The operators
are grouping, conditional aggregation and equi-joins (hot keys salted);
orderings that pick "the best" or "the first" row are ``max_by``/``min_by``
over struct keys, which combine map-side instead of sorting a group in one
task. The EMA recursion is the one scan: range-partitioned, checkpointed,
with pandas inside each partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdraft.functions.numeric import is_finite as finite
from sparkdraft.functions.numeric import relative_gain_pct
from sparkdraft.functions.text import col_
from sparkdraft.operators.quantiles import grouped_quantiles


def finite_or_null(c: str | Column) -> Column:
    """Keep finite numbers, blank everything else."""
    return F.when(finite(c), col_(c).cast("double"))


def filter_ok_runs(df: DataFrame, max_new_tokens: int, required: Sequence[str]) -> DataFrame:
    """status 'ok' and the requested generation length; a missing
    column is an error before planning, an empty result fails the query."""
    missing = [c for c in ["status", "max_new_tokens", *required] if c not in df.columns]
    if missing:
        raise ValueError(f"sweep table lacks columns {missing}")
    out = df.filter((F.col("status") == "ok") & (F.col("max_new_tokens") == max_new_tokens))
    # One row says that something is left; without it the join fails the query.
    n = out.agg(F.count(F.lit(1)).alias("_sd_n"))
    some = n.select(F.explode(F.when(F.col("_sd_n") > 0, F.array(F.lit(1))).otherwise(F.raise_error(F.lit("no successful run of the requested length"))).cast("array<int>")).alias("_sd_ok"))
    return out.withColumn("_sd_ok", F.lit(1)).join(F.broadcast(some), "_sd_ok").drop("_sd_ok")


def unique_cells(df: DataFrame, keys: Sequence[str], value_cols: Sequence[str]) -> DataFrame:
    """A14 precondition: one value per cell; a duplicated cell fails the
    query (pandas ``pivot`` raises on duplicates)."""
    return df.groupBy(*keys).agg(
        *[
            F.when(F.count(F.lit(1)) == 1, F.first(c)).otherwise(
                F.raise_error(F.lit("duplicate cell in pivot input"))
            ).alias(c)
            for c in value_cols
        ]
    )


def pivot_grid(df: DataFrame, index: str, column: str, value: str, values: Sequence, names: Sequence[str]) -> DataFrame:
    """Index x column -> value with explicit column values (no extra
    pass to discover them); a missing cell is null, a column value that is
    not listed fails the query."""
    return df.groupBy(index).agg(
        *[
            F.max(F.when(F.col(column) == F.lit(v), F.col(value)).when(listed(column, values), F.lit(None))).alias(n)
            for v, n in zip(values, names)
        ]
    )


def listed(column: str | Column, values: Sequence) -> Column:
    """True for a listed value; any other fails the query by name."""
    x = col_(column)
    return F.when(x.isin(*values), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("unlisted value: "), F.coalesce(x.cast("string"), F.lit("null")))).cast("boolean")
    )


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of an axis in ascending order."""
    return df.select(column).distinct().orderBy(column)


def grouped_stats(df: DataFrame, group: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """A10: mean, sample std (null for one row, H15) and exact median per
    group and metric."""
    from sparkdraft.operators.quantiles import unpivot_values

    base = df.groupBy(*group).agg(
        *[F.avg(m).alias(f"{m}_mean") for m in metrics],
        *[F.stddev_samp(m).alias(f"{m}_std") for m in metrics],
    )
    # One quantile pass for all metrics: sort (group, metric, value) once.
    long = unpivot_values(df, group, metrics, "_sd_metric")
    med = grouped_quantiles(long, [*group, "_sd_metric"], "value", [0.5], ["_sd_med"])
    wide = med.groupBy(*group).agg(
        *[F.max(F.when(F.col("_sd_metric") == m, F.col("_sd_med"))).alias(f"{m}_median") for m in metrics]
    )
    return base.join(wide, list(group), "left")


def reliability(df: DataFrame, group: Sequence[str], metric: str, threshold: float = 1.0) -> DataFrame:
    """A11 + A19: count, count above threshold, fraction, min, max."""
    above = F.col(metric) > F.lit(threshold)
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(above).alias("n_above"),
        F.avg(above.cast("double")).alias("frac_above"),
        F.min(metric).alias("min"),
        F.max(metric).alias("max"),
    )


def linear_fit(df: DataFrame, y: str | Column, x: str | Column, at: float | None = None,
               extra: Sequence[Column] = ()) -> DataFrame:
    """A12 + A13: Pearson r, least-squares slope/intercept over the rows
    where both operands are present (so a slice can be expressed as
    null-masked inputs in the same pass), optionally the prediction
    ``slope*at + intercept``; ``extra`` aggregates ride along."""
    yy, xx = col_(y), col_(x)
    out = df.agg(
        *extra,
        F.corr(xx, yy).alias("corr"),
        F.regr_slope(yy, xx).alias("slope"),
        F.regr_intercept(yy, xx).alias("intercept"),
        F.count(F.when(xx.isNotNull() & yy.isNotNull(), F.lit(1))).alias("n"),
    )
    if at is not None:
        out = out.withColumn("prediction", F.col("slope") * F.lit(float(at)) + F.col("intercept"))
    return out


def matched_deltas(df: DataFrame, keys: Sequence[str], arm: str, base_value, other_values: Sequence,
                   metrics: Sequence[str]) -> DataFrame:
    """J09 + A35: per matched key, metric(arm=v) - metric(arm=base) for each
    other arm value; conditional aggregation instead of a self-join."""
    aggs = []
    for m in metrics:
        base = F.max(F.when(F.col(arm) == F.lit(base_value), F.col(m)))
        for v in other_values:
            aggs.append((F.max(F.when(F.col(arm) == F.lit(v), F.col(m))) - base).alias(f"{m}__{v}"))
    return df.groupBy(*keys).agg(*aggs)


def delta_summary(deltas: DataFrame, keys: Sequence[str], metrics: Sequence[str], others: Sequence) -> DataFrame:
    """Unpivot matched deltas, then mean, exact median and fraction
    negative per (metric, arm value)."""
    cols = [f"{m}__{v}" for m in metrics for v in others]
    long = deltas.select(
        *keys,
        F.explode(
            F.array(*[F.struct(F.lit(c.split("__")[0]).alias("metric"), F.lit(str(c.split("__")[1])).alias("versus"),
                               F.col(c).cast("double").alias("delta")) for c in cols])
        ).alias("d"),
    ).select(*keys, "d.*").filter(F.col("delta").isNotNull())
    base = long.groupBy("metric", "versus").agg(
        F.avg("delta").alias("mean_delta"),
        F.avg((F.col("delta") < 0).cast("double")).alias("frac_negative"),
        F.count(F.lit(1)).alias("n_pairs"),
    )
    med = grouped_quantiles(long, ["metric", "versus"], "delta", [0.5], ["median_delta"])
    return base.join(med, ["metric", "versus"], "left")


def best_rows(df: DataFrame, row_key: str, order_cols: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """For each metric the row with the largest value (NaN/null
    skipped, H1); ties go to the first row in ``order_cols`` order."""
    def key(m: str) -> Column:
        k = F.struct(F.col(m).cast("double").alias("v"), *[(-F.col(c)).alias(f"o{i}") for i, c in enumerate(order_cols)])
        return F.when(finite(m), k)  # max_by passes over null keys

    one = df.agg(*[F.max(F.struct(key(m).alias("k"), F.col(row_key).alias("r"))).alias(f"_b{i}") for i, m in enumerate(metrics)])
    rows = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.when(F.col(f"_b{i}.k").isNotNull(), F.col(f"_b{i}.r")).alias("best"), F.col(f"_b{i}.k.v").alias("value"))
            for i, m in enumerate(metrics)
        ]
    )
    return one.select(F.explode(rows).alias("x")).select("x.*")


def grid_argmax(df: DataFrame, group: Sequence[str], metric: str, tie_cols: Sequence[str]) -> DataFrame:
    """Per group, the cell with the highest finite metric; ties by
    ascending ``tie_cols``. A struct max_by, so no per-group sort."""
    key = F.struct(F.col(metric).alias("v"), *[(-F.col(c)).alias(f"t{i}") for i, c in enumerate(tie_cols)])
    return df.filter(finite(metric)).groupBy(*group).agg(
        F.max_by(F.struct(*[F.col(c) for c in tie_cols], F.col(metric)), key).alias("best")
    ).select(*group, "best.*")


def delta_vs_reference(df: DataFrame, keys: Sequence[str], ref_col: str, ref_value, metrics: Sequence[str]) -> DataFrame:
    """Metric minus the metric of the reference row (ref_col ==
    ref_value) sharing ``keys``; the reference table has one row per key
    and is joined back on the keys."""
    ref = df.groupBy(*keys).agg(
        *[F.max(F.when(F.col(ref_col) == F.lit(ref_value), F.col(m))).alias(f"_ref_{m}") for m in metrics]
    )
    # A key may hold a large share of the rows: adaptive execution splits the
    # skewed partitions of the left side.
    j = df.join(ref, list(keys), "left")
    return j.select(
        *df.columns, *[(F.col(m) - F.col(f"_ref_{m}")).alias(f"{m}_delta") for m in metrics]
    )


def categorical_rank(c: str | Column, order: Sequence[str]) -> Column:
    """Position in a fixed category list (unknown values last)."""
    pos = F.array_position(F.array(*[F.lit(v) for v in order]), col_(c))
    return F.when(pos > 0, pos).otherwise(F.lit(len(order) + 1))


def effect_table(df: DataFrame, key: str, arm: str, base_arm: str, other_arm: str, metrics: Sequence[str]) -> DataFrame:
    """J07 + A36: per key, metric under ``other_arm`` vs ``base_arm``: delta,
    relative gain in percent and a better flag (an equi self-join on key)."""
    a = df.filter(F.col(arm) == base_arm).select(key, *[F.col(m).alias(f"{m}_base") for m in metrics])
    b = df.filter(F.col(arm) == other_arm).select(key, *[F.col(m).alias(f"{m}_other") for m in metrics])
    j = a.join(b, key, "inner")
    out = [F.col(key)]
    for m in metrics:
        d = F.col(f"{m}_other") - F.col(f"{m}_base")
        out += [
            F.col(f"{m}_base"),
            F.col(f"{m}_other"),
            d.alias(f"{m}_delta"),
            relative_gain_pct(f"{m}_other", f"{m}_base").alias(f"{m}_gain_pct"),
            (d > 0).alias(f"{m}_better"),
        ]
    return j.select(*out)


def _segments(pdf, group):
    """Contiguous runs of equal group keys in a sorted batch, in order
    (vectorized boundary detection)."""
    import numpy as np

    g = pdf[group]
    change = (g != g.shift()).any(axis=1).to_numpy()
    starts = np.flatnonzero(change)
    ends = list(starts[1:]) + [len(pdf)]
    for i, j in zip(starts, ends):
        yield tuple(g.iloc[int(i)].tolist()), int(i), int(j)


def before_divergence(df: DataFrame, group: Sequence[str], order: str, value: str) -> DataFrame:
    """The rows of each curve before its first value that is null, NaN or
    infinite (one grouped minimum, joined back)."""
    end = df.filter(~finite(value)).groupBy(*group).agg(F.min(order).alias("_sd_end")).select(
        *[F.col(g).alias(f"_sd_g{i}") for i, g in enumerate(group)], "_sd_end"
    )
    same = [F.col(g).eqNullSafe(F.col(f"_sd_g{i}")) for i, g in enumerate(group)]
    return df.join(end, same, "left").filter(F.col("_sd_end").isNull() | (F.col(order) < F.col("_sd_end"))).select(*df.columns)


def ema(df: DataFrame, group: Sequence[str], order: str, value: str, beta: float = 0.9) -> DataFrame:
    """Exponential moving average seeded with the first value,
    e_1 = x_1, e_t = beta*e_{t-1} + (1-beta)*x_t, per group, in ``order``.

    The recursion is sequential, so it runs as a distributed scan instead
    of collecting a group into one task:

    1. range-partitioned sort + reliable checkpoint: a group holding a
       third of the rows spans many partitions;
    2. pass 1 streams each partition and summarises its first and last
       group segment as an affine map e_out = a*e_in + b (<= 2 rows per
       partition);
    3. for every group that starts some partition, a grouped fold over its
       boundary segments (at most one per partition it spans) gives the
       carry into each partition;
    4. pass 2 streams each partition again and runs pandas
       ``ewm(adjust=False)`` per segment, starting from the carry.
    A curve ends before its first value that is not finite (or null), so
    the scan sees numbers only and no carry can be mistaken for a missing one.
    Output: group columns, ``order``, ``ema``.
    """
    import numpy as np
    import pandas as pd

    from sparkdraft.operators.ordering import stable_sort

    group = list(group)
    base = before_divergence(df, group, order, value).select(*group, F.col(order), F.col(value).cast("double").alias("_x"))
    s = stable_sort(base, [*group, order]).withColumn("_pid", F.spark_partition_id())
    gfields = [f for f in base.schema.fields if f.name in group]
    gtypes = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in gfields)
    otype = base.schema[order].dataType.simpleString()

    def summarize(it):
        pid, segs = None, []  # segs: [key, n, a, b, x0] in partition order
        for pdf in it:
            if pdf.empty:
                continue
            pid = int(pdf["_pid"].iloc[0])
            x_all = pdf["_x"].to_numpy(dtype="float64")
            for key, i, j in _segments(pdf, group):
                m = j - i
                a = beta**m
                b = float((1.0 - beta) * np.power(beta, np.arange(m - 1, -1, -1, dtype="float64")) @ x_all[i:j])
                if segs and segs[-1][0] == key:
                    k, n0, a0, b0, x0 = segs[-1]
                    segs[-1] = [k, n0 + (j - i), a0 * a, a * b0 + b, x0]
                else:
                    segs.append([key, j - i, a, b, float(x_all[i])])
                if len(segs) > 2:
                    del segs[1]  # keep only the first and the latest segment
        if pid is None:
            return
        rows = []
        for key, n, a, b, x0 in segs:
            r = dict(zip(group, key))
            r.update(_pid=pid, _n=n, _a=a, _b=b, _x0=x0)
            rows.append(r)
        yield pd.DataFrame(rows, columns=["_pid", *group, "_n", "_a", "_b", "_x0"])

    summ = s.mapInPandas(summarize, f"_pid int, {gtypes}, _n long, _a double, _b double, _x0 double")
    firsts = s.groupBy("_pid").agg(F.min(F.struct(*group)).alias("_g")).select(
        *[F.col("_g." + g).alias(g) for g in group]
    ).distinct()
    boundary = summ.join(F.broadcast(firsts), [summ[g].eqNullSafe(firsts[g]) for g in group], "left_semi")

    def fold(pdf):
        pdf = pdf.sort_values("_pid")
        e, rows = None, []
        cols = zip(pdf["_pid"].tolist(), pdf["_n"].tolist(), pdf["_a"].tolist(), pdf["_b"].tolist(), pdf["_x0"].tolist())
        for pid_, n_, a_, b_, x0_ in cols:
            if e is not None:
                rows.append((pid_, e))
            if e is None:
                head = beta ** (n_ - 1)
                e = head * x0_ + (b_ - (1.0 - beta) * head * x0_)
            else:
                e = a_ * e + b_
        out = pd.DataFrame(rows, columns=["_pid", "_carry"])
        for g in group:
            out[g] = pdf[g].iloc[0]
        return out[["_pid", *group, "_carry"]]

    carry = boundary.groupBy(*group).applyInPandas(fold, f"_pid int, {gtypes}, _carry double")
    carry = carry.select(F.col("_pid").alias("_cpid"), *[F.col(g).alias("_c_" + g) for g in group], "_carry")
    cond = [F.col("_pid") == F.col("_cpid")] + [F.col(g).eqNullSafe(F.col("_c_" + g)) for g in group]
    with_carry = s.join(F.broadcast(carry), cond, "left").select(*s.columns, "_carry")

    def run(it):
        last_key, last_e = None, None
        for pdf in it:
            if pdf.empty:
                continue
            x_all = pdf["_x"].to_numpy(dtype="float64")
            out = pdf[group + [order]].reset_index(drop=True)
            ema_vals = [0.0] * len(pdf)
            for key, i, j in _segments(pdf, group):
                if key == last_key:
                    e0 = last_e
                else:
                    c = pdf["_carry"].iloc[i]
                    e0 = None if pd.isna(c) else float(c)
                xs = pd.Series(x_all[i:j])
                if e0 is None:
                    vals = xs.ewm(alpha=1.0 - beta, adjust=False).mean().to_numpy()
                else:
                    vals = pd.concat([pd.Series([e0]), xs], ignore_index=True).ewm(alpha=1.0 - beta, adjust=False).mean().to_numpy()[1:]
                ema_vals[i:j] = list(vals)
                last_key, last_e = key, float(vals[-1])
            out["ema"] = ema_vals
            yield out

    return with_carry.mapInPandas(run, f"{gtypes}, `{order}` {otype}, ema double")


def convergence_status(df: DataFrame, group: Sequence[str], order: str, value: str,
                       smoothed: DataFrame | None = None, smoothed_col: str = "ema") -> DataFrame:
    """DIVERGED if any raw value is not finite; otherwise OK when the
    last (smoothed, if ``smoothed`` = (group, order, smoothed_col) is
    given) value is below the first value, else STALLED. ``min_by`` /
    ``max_by`` on the step combine map-side; the smoothed side has one row
    per group after its own aggregate."""
    g = df.groupBy(*group).agg(
        F.bool_or(~finite(value)).alias("_bad"),
        F.min_by(F.col(value), F.col(order)).alias("first"),
        F.max_by(F.col(value), F.col(order)).alias("last"),
        F.count(F.lit(1)).alias("n_points"),
    )
    if smoothed is not None:
        last = smoothed.groupBy(*group).agg(F.max_by(F.col(smoothed_col), F.col(order)).alias("_last_s"))
        g = g.join(last, list(group), "left").withColumn("last", F.col("_last_s")).drop("_last_s")
    status = F.when(F.col("_bad"), "DIVERGED").when(F.col("last") < F.col("first"), "OK").otherwise("STALLED")
    return g.select(*group, "first", "last", "n_points", status.alias("status"))


def snapshot_rows(df: DataFrame, group: Sequence[str], order: str, every: int) -> DataFrame:
    """The first step, every ``every``-th step, and the last step of
    each group (the last via a per-group max joined back)."""
    last = df.groupBy(*group).agg(F.max(order).alias("_last"))
    # The partitions of a run with most of the points are split at run time.
    j = df.join(last, list(group), "left")
    keep = (F.col(order) == 1) | (F.col(order) % every == 0) | (F.col(order) == F.col("_last"))
    return j.filter(keep).drop("_last")


def logging_buckets(df: DataFrame, group: Sequence[str], step: str, every: int, values: Sequence[str]) -> DataFrame:
    """Mean of each value over logging buckets of ``every`` steps
    (bucket = floor((step-1)/every))."""
    b = F.floor((F.col(step) - 1) / F.lit(every)).cast("long").alias("bucket")
    return df.groupBy(*group, b).agg(*[F.avg(v).alias(f"{v}_mean") for v in values], F.max(step).alias("flush_step"))


def best_checkpoint(df: DataFrame, group: Sequence[str], order: str, metric: str, greater_is_better: bool = False) -> DataFrame:
    """The step with the best metric (argmin by default); ties to the
    earliest step."""
    ok = df.filter(finite(metric))
    if greater_is_better:
        key = F.struct(F.col(metric).alias("m"), (-F.col(order)).alias("s"))
        pick = F.max_by(F.struct(F.col(order).alias("best_step"), F.col(metric).alias("best_value")), key)
    else:
        key = F.struct(F.col(metric).alias("m"), F.col(order).alias("s"))
        pick = F.min_by(F.struct(F.col(order).alias("best_step"), F.col(metric).alias("best_value")), key)
    return ok.groupBy(*group).agg(pick.alias("b")).select(*group, "b.*")


def sweep_rollup(status: DataFrame, status_col: str = "status") -> DataFrame:
    """Runs per status, failure count and the overall outcome."""
    return status.agg(
        F.count(F.lit(1)).alias("n_runs"),
        *[F.count_if(F.col(status_col) == s).alias(f"n_{s}") for s in ("ok", "failed", "cached", "missing_checkpoint", "missing", "not_run")],
        F.coalesce(F.bool_or(F.col(status_col) == "failed"), F.lit(False)).alias("any_failed"),
    ).withColumn("outcome", F.when(F.col("any_failed"), "failure").otherwise("success"))


def run_status(rc: str | Column, summary_exists: str | Column, cached: str | Column,
               has_checkpoint: str | Column) -> Column:
    """A33 per run: missing_checkpoint, cached, ok (rc 0 and a summary),
    failed (nonzero rc), missing (rc 0 but no summary), not_run (no rc)."""
    r = col_(rc)
    return (
        F.when(~col_(has_checkpoint), "missing_checkpoint")
        .when(col_(cached), "cached")
        .when(r.isNull(), "not_run")
        .when((r == 0) & col_(summary_exists), "ok")
        .when(r == 0, "missing")
        .otherwise("failed")
    )


# Dataset ids recognised inside run names, checked in order.
DATA_IDS = ["ultrachat_50k_target_gen", "ultrachat_50k", "ultrachat_25k", "ultrachat_10k", "alpaca_50k"]


def infer_data_id(run_name: str | Column) -> Column:
    """The first known dataset id contained in the run name, else ""."""
    n = col_(run_name)
    out = None
    for d in DATA_IDS:
        out = F.when(n.contains(d), F.lit(d)) if out is None else out.when(n.contains(d), F.lit(d))
    return out.otherwise(F.lit(""))


def infer_response_source(run_name: str | Column, data_id: str | Column | None = None) -> Column:
    """P19: 'target_generated' when the data id (or, without one, the run
    name) ends with ``_target_gen`` or the run name contains ``_tgen_``,
    else 'original'."""
    n = col_(run_name)
    d = col_(data_id) if data_id is not None else n
    return F.when(d.endswith("_target_gen") | n.contains("_tgen_"), "target_generated").otherwise("original")


def base_dataset(data_id: str | Column) -> Column:
    """P20: dataset name without the ``_target_gen`` suffix."""
    return F.regexp_replace(col_(data_id), "_target_gen$", "")


def number_tag(x: str | Column) -> Column:
    """P20: '-' -> 'm', '.' -> 'p' in a formatted number."""
    return F.translate(col_(x).cast("string"), "-.", "mp")


def alpha_tag(alpha: str | Column) -> Column:
    """P20, on the value as written: "0.5" -> a05, "1.0"/"1" -> a1,
    otherwise "a" + the text without dots ("0.50" -> a050)."""
    a = col_(alpha).cast("string")
    return F.when(a == "0.5", "a05").when(a.isin("1.0", "1"), "a1").otherwise(
        F.concat(F.lit("a"), F.regexp_replace(a, r"\.", ""))
    )


def eval_run_name(ckpt: str | Column, gamma: str | Column, max_new: str | Column) -> Column:
    """P20: ``<ckpt>_eval_g{gamma}_max{n}``."""
    return F.format_string("%s_eval_g%d_max%d", col_(ckpt), col_(gamma).cast("int"), col_(max_new).cast("int"))


def runtime_run_name(ckpt: str | Column, gamma: str | Column, temp_tag: str | Column, max_new: str | Column) -> Column:
    """P20: ``<ckpt>_runtime_g{gamma}_t{tag}_max{n}``."""
    return F.format_string("%s_runtime_g%d_t%s_max%d", col_(ckpt), col_(gamma).cast("int"), col_(temp_tag), col_(max_new).cast("int"))


RUNTIME_NAME_PATTERN = r"_runtime_g(\d+)_t(\d+p\d+)_max(\d+)$"


def parse_runtime_name(name: str | Column) -> Column:
    """struct(gamma, temperature, max_new_tokens) from a runtime run
    name; null when it does not match."""
    n = col_(name)
    ok = n.rlike(RUNTIME_NAME_PATTERN)
    t = F.translate(F.regexp_extract(n, RUNTIME_NAME_PATTERN, 2), "p", ".")
    return F.when(
        ok,
        F.struct(
            F.regexp_extract(n, RUNTIME_NAME_PATTERN, 1).try_cast("int").alias("gamma"),
            t.try_cast("double").alias("temperature"),
            F.regexp_extract(n, RUNTIME_NAME_PATTERN, 3).try_cast("int").alias("max_new_tokens"),
        ),
    )


def sampling_mode_for(temperature: str | Column) -> Column:
    """P20 automatic mode, on the value as written: "0", "0.0" or "0.00"
    -> greedy, anything else -> sampling (numbers are rendered first)."""
    return F.when(col_(temperature).cast("string").isin("0", "0.0", "0.00"), "greedy").otherwise("sampling")


def derived_run_metrics(acceptance: str | Column, gamma: str | Column, accepted: str | Column) -> list[Column]:
    """Token yield = 1 + acceptance; draft tokens per accepted token."""
    return [
        (F.lit(1.0) + col_(acceptance)).alias("token_yield"),
        F.try_divide(col_(gamma).cast("double"), col_(accepted).cast("double")).alias("draft_per_accepted"),
    ]


def cache_state(manifests: DataFrame, counts: DataFrame, expected_model: str,
                splits: Sequence[str] = ("train", "val"), cache_col: str | None = None) -> DataFrame:
    """Coherence of target-generated caches.

    ``manifests``: (split, target_model) rows found; ``counts``: (split,
    n_rows) of the cached data; with ``cache_col`` both also name their cache and
    the result has one row per cache, else one row in all. State: 'absent' when
    nothing exists, 'mismatch' when a manifest names another target model,
    'partial' when a split or its manifest is missing or empty, else 'reuse'.
    """
    keys = [cache_col] if cache_col else []
    want = F.array(*[F.lit(x) for x in splits])
    model = manifests.filter(F.col("split").isin(*splits)).select(*keys, "split", "target_model", F.lit(None).cast("long").alias("n_rows"))
    rows = counts.filter(F.col("split").isin(*splits)).select(*keys, "split", F.lit(None).cast("string").alias("target_model"), F.col("n_rows").cast("long").alias("n_rows"))
    both = model.unionByName(rows).groupBy(*keys, "split").agg(
        F.bool_or(F.col("target_model").isNotNull()).alias("named"),
        F.bool_or(F.col("target_model") != expected_model).alias("other"),
        (F.coalesce(F.sum("n_rows"), F.lit(0)) > 0).alias("filled"),
    )
    named, other, filled = (F.coalesce(c, F.lit(False)) for c in ("named", "other", "filled"))
    agg = both.groupBy(*keys).agg(
        F.count_if(named | filled).alias("n_present"),
        F.count_if(other).alias("n_mismatch"),
        (F.size(want) - F.count_if(named & filled)).alias("n_incomplete"),
    )
    state = (
        F.when(F.col("n_present") == 0, "absent")
        .when(F.col("n_mismatch") > 0, "mismatch")
        .when(F.col("n_incomplete") > 0, "partial")
        .otherwise("reuse")
    )
    return agg.select(*keys, state.alias("state"), "n_present", "n_mismatch", "n_incomplete")


def param_grid(spark, **axes: Sequence) -> DataFrame:
    """The full grid of run parameters (e.g. max_new_tokens x gamma x
    temperature, or loss x data) as rows, built by exploding one literal
    array per axis from a single row - no cross join. Axis order is the
    keyword order; the grid size is the product of the axis lengths."""
    if not axes:
        raise ValueError("param_grid needs at least one axis")
    df = spark.range(1).select()
    for name, values in axes.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def reconcile_grid(wanted: DataFrame, runs: DataFrame, axes: Sequence[str], same: Sequence[str] = ()) -> DataFrame:
    """One row per finding about a grid of cells (``axes``) and the
    runs that should fill it, each cell once.

    'missing': a wanted cell without a run; 'extra': runs of a cell not wanted;
    'duplicated': more than one run of a wanted cell; 'uneven': a cell whose
    value of a ``same`` column is not the one that most cells have (the least
    of several such). Columns: the axes, finding, n_runs, and for 'uneven'
    column and value (as text). A null is a value like any other on an axis. One
    aggregate of the runs by cell and one full outer join of cells.
    """
    axes = list(axes)
    none = F.lit(None).cast("string")
    held = runs.groupBy(*axes).agg(F.count(F.lit(1)).alias("n_runs"), *[F.min(c).cast("string").alias(f"_low_{c}") for c in same], *[F.max(c).cast("string").alias(f"_high_{c}") for c in same])
    asked = wanted.select(*axes).distinct().withColumn("_wanted", F.lit(True))
    pairs = [F.col(f"h.{a}").eqNullSafe(F.col(f"w.{a}")) for a in axes]
    on = pairs[0]
    for p in pairs[1:]:
        on = on & p
    both = held.alias("h").join(asked.alias("w"), on, "full_outer").select(
        *[F.coalesce(F.col(f"h.{a}"), F.col(f"w.{a}")).alias(a) for a in axes], F.coalesce("n_runs", F.lit(0)).cast("long").alias("n_runs"), F.coalesce("_wanted", F.lit(False)).alias("_wanted")
    )
    finding = F.when(F.col("n_runs") == 0, "missing").when(~F.col("_wanted"), "extra").when(F.col("n_runs") > 1, "duplicated")
    out = both.select(*axes, finding.alias("finding"), "n_runs", none.alias("column"), none.alias("value")).filter(F.col("finding").isNotNull())
    for c in same:
        low, high = F.col(f"_low_{c}"), F.col(f"_high_{c}")
        # One row: the commonest value over cells.
        usual = held.groupBy(low.alias("_usual")).agg(F.count(F.lit(1)).alias("_n")).agg(F.min_by("_usual", F.struct(-F.col("_n"), F.col("_usual"))).alias("_usual"))
        beside = held.withColumn("_one", F.lit(1)).join(F.broadcast(usual.withColumn("_one", F.lit(1))), "_one")
        odd = beside.filter(~(low.eqNullSafe(F.col("_usual")) & high.eqNullSafe(F.col("_usual"))))
        value = F.when(low.eqNullSafe(high), low).otherwise(F.concat_ws(" to ", low, high))
        out = out.unionByName(odd.select(*axes, F.lit("uneven").alias("finding"), F.col("n_runs").cast("long"), F.lit(c).alias("column"), value.alias("value")))
    return out


def grid_balance(wanted: DataFrame, runs: DataFrame, axes: Sequence[str], same: Sequence[str] = ()) -> DataFrame:
    """one row: wanted cells, runs, findings by kind, and whether the grid is balanced (none)."""
    found = reconcile_grid(wanted, runs, axes, same).agg(*[F.count_if(F.col("finding") == k).alias(f"n_{k}") for k in ("missing", "extra", "duplicated", "uneven")])
    sizes = [df.agg(F.count(F.lit(1)).alias(n)) for df, n in ((wanted.select(*axes).distinct(), "n_cells"), (runs, "n_runs"))]
    rows = sizes[0].unionByName(sizes[1], allowMissingColumns=True).unionByName(found, allowMissingColumns=True)
    out = rows.agg(*[F.max(c).alias(c) for c in rows.columns])
    return out.withColumn("balanced", F.col("n_missing") + F.col("n_extra") + F.col("n_duplicated") + F.col("n_uneven") == 0)
