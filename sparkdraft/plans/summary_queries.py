"""Run-summary document queries (P22-P25, A31, SO2).

Stand-in: every sweep cell (see ``sweep_queries``) becomes one run-summary
JSON document built with ``to_json``: the cell metrics, a decoding block,
a vLLM engine block with counters derived from the cell, one quality
score, and a NaN vanilla time for cells of gamma 6. Cells of gamma 7 have
no speedup, so their document lacks that required key (``to_json`` omits
nulls). The queries then parse these documents like files read from disk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdraft.operators.summaries import SUMMARY_SCHEMA, flatten_metrics_long, flatten_summary, validate_summaries
from sparkdraft.plans.registry import register
from sparkdraft.plans.sweep_queries import CELLS_SQL, CKPT, sweep_rows

ROUND = 9


def summary_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = sweep_rows(spark, sf_dir)
    doc = F.struct(
        F.col("run").alias("model"),
        F.lit("target-8b").alias("target"),
        F.lit(CKPT).alias("draft"),
        "acceptance_rate",
        (F.col("acceptance_rate") * F.col("gamma")).alias("avg_accepted_tokens"),
        F.when(F.col("gamma") == 6, F.lit(float("nan"))).otherwise(F.col("speedup") * 10.0).alias("vanilla_time_s"),
        F.lit(10.0).alias("sd_time_s"),
        F.when(F.col("gamma") != 7, F.col("speedup")).alias("speedup"),
        "tokens_per_second",
        F.create_map(F.lit("exact_match_vs_target"), F.col("acceptance_rate") / 2).alias("quality_score"),
        F.struct(
            F.when(F.col("temperature") == 0, "greedy").otherwise("sampling").alias("mode"),
            "max_new_tokens",
            F.col("gamma").alias("num_assistant_tokens"),
            "temperature",
            F.lit(0.9).alias("top_p"),
        ).alias("decoding"),
        "n_prompts",
        F.lit(1).alias("n_warmup"),
        F.lit(3).alias("n_repeats"),
        F.struct(
            F.struct(
                F.col("n_prompts").alias("num_drafts"),
                (F.col("n_prompts") * F.col("gamma")).alias("num_draft_tokens"),
                F.round(F.col("n_prompts") * F.col("gamma") * F.col("acceptance_rate")).cast("long").alias("num_accepted_tokens"),
                F.lit(8).alias("request_batch_size"),
                F.lit(True).alias("batched"),
            ).alias("vllm")
        ).alias("engines"),
    )
    # Files have NaN as a bare word; to_json puts it in quotes.
    return c.select("run", F.regexp_replace(F.to_json(doc), '":"NaN"', '":NaN').alias("value"))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = summary_docs(spark, sf_dir)
    return docs.select("run", F.from_json("value", SUMMARY_SCHEMA, {"allowNonNumericNumbers": "true"}).alias("s")).select(
        "run", "s.*"
    )


@register("summary_validation", f"""WITH {CELLS_SQL}
SELECT run, 'missing required key: speedup' AS problem FROM named WHERE gamma = 7""")
def q_summary_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P25 + SO3: required keys and object-typed keys of every summary."""
    return validate_summaries(summary_docs(spark, sf_dir))


FLAT_SQL = f"""WITH {CELLS_SQL}
SELECT run, CASE WHEN gamma <> 7 THEN speedup END AS speedup, acceptance_rate, acceptance_rate * gamma AS avg_accepted_tokens,
       tokens_per_second, CAST(10.0 AS DOUBLE) AS sd_time_s, CASE WHEN gamma <> 6 THEN speedup * 10.0 END AS vanilla_time_s,
       CAST(n_prompts AS INTEGER) AS n_prompts, 1 AS n_warmup, 3 AS n_repeats,
       CAST(n_prompts AS BIGINT) AS vllm_num_drafts, CAST(n_prompts * gamma AS BIGINT) AS vllm_num_draft_tokens,
       CAST(round(n_prompts * gamma * acceptance_rate) AS BIGINT) AS vllm_num_accepted_tokens, CAST(8 AS BIGINT) AS vllm_request_batch_size,
       acceptance_rate / 2 AS "quality_score.exact_match_vs_target"
FROM named
"""


@register("summary_flatten", FLAT_SQL)
def q_summary_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P22 + P23 + A31 + SO2: parse each summary with the fixed schema (NaN
    accepted), blank non-finite metrics, flatten the engine block and one
    column per score name asked for."""
    p = parsed(spark, sf_dir)
    return flatten_summary(p, ["exact_match_vs_target"])


_NUMERIC = [
    ("acceptance_rate", "acceptance_rate"), ("avg_accepted_tokens", "acceptance_rate * gamma"),
    ("speedup", "CASE WHEN gamma <> 7 THEN speedup END"), ("tokens_per_second", "tokens_per_second"),
    ("sd_time_s", "10.0"), ("vanilla_time_s", "CASE WHEN gamma <> 6 THEN speedup * 10.0 ELSE 'NaN'::DOUBLE END"),
    ("n_prompts", "n_prompts"), ("n_warmup", "1"), ("n_repeats", "3"),
    ("vllm/num_drafts", "n_prompts"), ("vllm/num_draft_tokens", "n_prompts * gamma"),
    ("vllm/num_accepted_tokens", "round(n_prompts * gamma * acceptance_rate)"), ("vllm/request_batch_size", "8"),
    ("quality/exact_match_vs_target", "acceptance_rate / 2"),
]

LONG_SQL = f"WITH {CELLS_SQL}, m AS (" + " UNION ALL ".join(
    f"SELECT run, 'eval/{k}' AS metric, CAST({e} AS DOUBLE) AS value FROM named" for k, e in _NUMERIC
) + ") SELECT * FROM m WHERE value IS NOT NULL"


@register("summary_metrics_long", LONG_SQL)
def q_summary_metrics_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every numeric field as (run, metric, value); booleans and text
    never enter, missing values are dropped, NaN stays a number."""
    return flatten_metrics_long(summary_docs(spark, sf_dir))
