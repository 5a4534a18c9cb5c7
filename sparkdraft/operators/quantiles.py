"""Exact quantiles without buffering a group in one task.

Spark's exact ``percentile``/``median`` keep every distinct value of a
group in one aggregation buffer; a group with a third of the rows would
sit in one executor. Here the values are globally sorted by
(group, value) with range partitioning (a hot group spans many
partitions), each row gets its global rank, and only the two ranks around
each requested quantile are looked up. Interpolation is linear between
ranks ``floor((n-1)p)`` and ``ceil((n-1)p)`` - the rule of pandas
``quantile`` and SQL ``quantile_cont``/``percentile_cont``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdraft.operators.ordering import with_global_index


def grouped_quantiles(
    df: DataFrame,
    group_cols: Sequence[str],
    value_col: str,
    probs: Sequence[float],
    names: Sequence[str] | None = None,
) -> DataFrame:
    """One row per group with one column per probability.

    Nulls and NaN are ignored (pandas semantics). ``names`` default to
    ``q<percent>``.
    """
    group_cols = list(group_cols)
    names = list(names or [f"q{int(round(p * 100))}" for p in probs])
    x = df.select(*group_cols, F.col(value_col).cast("double").alias("_sd_v")).filter(
        F.col("_sd_v").isNotNull() & ~F.isnan("_sd_v")
    )
    ranked = with_global_index(x, [*group_cols, "_sd_v"], "_sd_r")
    stats = ranked.groupBy(*group_cols).agg(
        F.min("_sd_r").alias("_sd_start"), F.count(F.lit(1)).alias("_sd_n")
    )
    wanted = []
    for i, p in enumerate(probs):
        pos = (F.col("_sd_n") - 1).cast("double") * F.lit(float(p))
        lo = F.floor(pos)
        wanted.append(
            F.struct(
                F.lit(i).alias("qi"),
                (F.col("_sd_start") + lo).alias("lo_r"),
                (F.col("_sd_start") + F.ceil(pos)).alias("hi_r"),
                (pos - lo).alias("frac"),
            )
        )
    t = stats.select(*group_cols, F.explode(F.array(*wanted)).alias("_sd_t")).select(
        *group_cols, "_sd_t.*"
    )
    # Only <= 2 x groups x probs ranks are needed: pick them from the ranked
    # table with one semi join (adaptive execution broadcasts the rank list
    # if its measured size allows), then look up lo/hi values in the small result.
    needed = t.select(F.explode(F.array("lo_r", "hi_r")).alias("_sd_r")).distinct()
    picked = ranked.select("_sd_r", "_sd_v").join(needed, "_sd_r", "left_semi")
    lo_v = picked.select(F.col("_sd_r").alias("lo_r"), F.col("_sd_v").alias("lo_v"))
    hi_v = picked.select(F.col("_sd_r").alias("hi_r"), F.col("_sd_v").alias("hi_v"))
    j = t.join(lo_v, "lo_r").join(hi_v, "hi_r")
    q = F.col("lo_v") + F.col("frac") * (F.col("hi_v") - F.col("lo_v"))
    return j.groupBy(*group_cols).agg(
        *[F.max(F.when(F.col("qi") == i, q)).alias(n) for i, n in enumerate(names)]
    )


def unpivot_values(df: DataFrame, group_cols: Sequence[str], value_cols: Sequence[str], name_col: str = "column") -> DataFrame:
    """Long form (group..., column, value) so statistics over several
    columns share one grouped pass (and one sort for the quantiles)."""
    items = [F.struct(F.lit(c).alias(name_col), F.col(c).cast("double").alias("value")) for c in value_cols]
    return df.select(*group_cols, F.explode(F.array(*items)).alias("_sd_u")).select(*group_cols, "_sd_u.*")


def describe(df: DataFrame, value_cols: Sequence[str], places: int = 1) -> DataFrame:
    """Count, mean, std, min, 25%, 50%, 75%, max per column, one row
    per column, rounded half-to-even to ``places``. All columns go through
    one unpivoted aggregation and one distributed quantile pass."""
    long = unpivot_values(df, [], value_cols)
    base = long.groupBy("column").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    qs = grouped_quantiles(long, ["column"], "value", [0.25, 0.5, 0.75], ["p25", "p50", "p75"])
    # One row per requested column even for empty input (count 0), like
    # pandas; the column list is a literal table of proven size.
    names = df.sparkSession.createDataFrame([(c,) for c in value_cols], "column string")
    row = F.broadcast(names).join(base, "column", "left").join(qs, "column", "left")
    return row.select(
        "column",
        F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"),
        *[F.bround(F.col(s_), places).alias(s_) for s_ in ("mean", "std", "min", "p25", "p50", "p75", "max")],
    )


def equal_width_histogram(df: DataFrame, value_col: str, bins: int = 10) -> DataFrame:
    """``bins`` equal-width bins over [min, max], last bin closed.

    min/max come from one partial aggregate (a single row, so the broadcast
    is bounded); empty bins appear with count 0.
    """
    rng = df.agg(F.min(F.col(value_col).cast("double")).alias("lo"), F.max(F.col(value_col).cast("double")).alias("hi"))
    x = df.select(F.col(value_col).cast("double").alias("_sd_x")).filter(F.col("_sd_x").isNotNull())
    x = x.withColumn("_k", F.lit(1)).join(F.broadcast(rng.withColumn("_k", F.lit(1))), "_k")
    span = F.col("hi") - F.col("lo")
    scaled = F.when(span > 0, (F.col("_sd_x") - F.col("lo")) * F.lit(float(bins)) / span).otherwise(F.lit(0.0))
    counts = x.select(F.least(F.floor(scaled), F.lit(bins - 1)).cast("int").alias("bin")).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n")
    )
    width = span / F.lit(float(bins))
    edges = rng.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", "hi").select(
        "bin",
        (F.col("lo") + F.col("bin") * width).alias("lo_edge"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("hi_edge"),
    )
    return F.broadcast(edges).join(counts, "bin", "left").select(
        "bin", "lo_edge", "hi_edge", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )
