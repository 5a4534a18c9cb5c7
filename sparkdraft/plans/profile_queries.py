"""Profiling queries over conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkdraft.operators.profile import profile_turns
from sparkdraft.operators.quantiles import describe, equal_width_histogram
from sparkdraft.plans.registry import register, table

PROFILE_SQL_BODY = """
WITH p AS (
  SELECT conv_id,
         coalesce(arg_min(text, turn) FILTER (WHERE role = 'user'), '') AS pr,
         coalesce(arg_min(text, turn) FILTER (WHERE role = 'assistant'), '') AS rs,
         count(*) AS turns
  FROM conversations GROUP BY conv_id),
prof AS (
  SELECT conv_id, CAST(length(pr) AS INTEGER) AS prompt_chars, CAST(length(rs) AS INTEGER) AS response_chars, turns,
         replace(substr(pr, 1, 100), chr(10), ' ') AS prompt_preview,
         replace(substr(rs, 1, 100), chr(10), ' ') AS response_preview
  FROM p)
"""


@register("chat_profile", PROFILE_SQL_BODY + "SELECT * FROM prof")
def q_chat_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P12 + P13 per conversation."""
    return profile_turns(table(spark, sf_dir, "conversations"))


def _describe_sql() -> str:
    parts = []
    for c in ("prompt_chars", "response_chars", "turns"):
        parts.append(f"""
SELECT '{c}' AS "column", count({c}) AS count,
       round_even(avg({c}), 1) AS mean, round_even(stddev_samp({c}), 1) AS std,
       round_even(min({c})::DOUBLE, 1) AS min,
       round_even(quantile_cont({c}::DOUBLE, 0.25), 1) AS p25,
       round_even(quantile_cont({c}::DOUBLE, 0.5), 1) AS p50,
       round_even(quantile_cont({c}::DOUBLE, 0.75), 1) AS p75,
       round_even(max({c})::DOUBLE, 1) AS max
FROM prof""")
    return PROFILE_SQL_BODY + " UNION ALL ".join(parts)


@register("profile_describe", _describe_sql())
def q_profile_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """describe() of the profile lengths with exact quantiles."""
    prof = profile_turns(table(spark, sf_dir, "conversations"))
    return describe(prof, ["prompt_chars", "response_chars", "turns"])


HIST_SQL = PROFILE_SQL_BODY + """
, rng AS (SELECT min(response_chars)::DOUBLE AS lo, max(response_chars)::DOUBLE AS hi FROM prof),
b AS (SELECT CAST(least(floor(CASE WHEN hi > lo THEN (response_chars - lo) * 10.0 / (hi - lo) ELSE 0.0 END), 9) AS INTEGER) AS bin
      FROM prof, rng),
c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)
SELECT CAST(g.bin AS INTEGER) AS bin, lo + g.bin * ((hi - lo) / 10.0) AS lo_edge,
       lo + (g.bin + 1) * ((hi - lo) / 10.0) AS hi_edge, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM range(10) g(bin) CROSS JOIN rng LEFT JOIN c ON c.bin = g.bin
"""


@register("length_histogram", HIST_SQL)
def q_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10 equal-width bins of the first response length."""
    prof = profile_turns(table(spark, sf_dir, "conversations"))
    return equal_width_histogram(prof, "response_chars", 10)
