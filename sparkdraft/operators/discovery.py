"""Checkpoint discovery, run summaries and the sweep table (J01, J02, J04,
J05, F06; the inventory comes from ``sources.files.inventory_scan``).

Each function joins on the run's key; nothing is collected, and the side with
one row per run is left to the planner.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdraft.functions.text import truthy_str
from sparkdraft.operators.summaries import SWEEP_CSV_COLUMNS
from sparkdraft.operators.sweeps import eval_run_name, infer_data_id, infer_response_source

# Files that make a checkpoint usable, relative to its folder.
CONFIG_FILE = "config.yaml"
MODEL_CONFIG_FILE = "model/config.json"
WEIGHT_FILES = r"^model/([^/]*\.safetensors|pytorch_model[^/]*\.bin|model\.safetensors\.index\.json|pytorch_model\.bin\.index\.json)$"


def checkpoint_inventory(files: DataFrame, run_col: str = "run_id", file_col: str = "file") -> DataFrame:
    """J04 + F06: (run, complete, reason) in one grouped pass over the file
    inventory; single, sharded and indexed weights all count, and the
    reason lists every missing piece."""
    file = F.col(file_col)
    pieces = {
        f"missing {CONFIG_FILE}": F.bool_or(file == CONFIG_FILE),
        f"missing {MODEL_CONFIG_FILE}": F.bool_or(file == MODEL_CONFIG_FILE),
        "missing model weights": F.bool_or(file.rlike(WEIGHT_FILES)),
    }
    found = files.groupBy(run_col).agg(*[F.coalesce(has, F.lit(False)).alias(f"_p{i}") for i, has in enumerate(pieces.values())])
    lacking = F.array_compact(F.array(*[F.when(~F.col(f"_p{i}"), F.lit(text)) for i, text in enumerate(pieces)]))
    return found.select(run_col, (F.size(lacking) == 0).alias("complete"), F.when(F.size(lacking) > 0, F.concat_ws("; ", lacking)).alias("reason"))


def checkpoint_records(
    inventory: DataFrame,
    configs: DataFrame,
    metas: DataFrame,
    *,
    gamma: int,
    max_new_tokens: int,
    default_target: str,
    checkpoint_root: str,
    results_root: str,
) -> DataFrame:
    """One run record per complete checkpoint, the precedence field by field.

    ``configs`` has one row per ``dir`` with run_name, data_id,
    response_source, target, draft_init, draft_default, loss_kind, loss_alpha,
    loss_temperature, seed, steps and prompts_jsonl; ``metas`` with run_name,
    dataset_id, draft_init, train_loss_final and steps. Where a field is in
    both, a config value goes first, but for draft_init and steps, which the
    metadata of the finished training settle.
    """
    c = configs.select("dir", *[F.col(x).alias(f"c_{x}") for x in configs.columns if x != "dir"])
    m = metas.select("dir", *[F.col(x).alias(f"m_{x}") for x in metas.columns if x != "dir"])
    j = inventory.filter("complete").select(F.col("run_id").cast("string").alias("dir")).join(c, "dir", "left").join(m, "dir", "left")
    named = j.withColumn("checkpoint_run", F.coalesce("c_run_name", truthy_str("m_run_name"), "dir"))
    data = named.withColumn("data_id", F.coalesce("c_data_id", truthy_str("m_dataset_id"), infer_data_id("checkpoint_run")))
    run = eval_run_name("checkpoint_run", F.lit(gamma), F.lit(max_new_tokens))
    path = lambda *parts: F.concat_ws("/", *parts)
    root, results = F.lit(checkpoint_root.rstrip("/")), F.lit(results_root.rstrip("/"))
    return data.select(
        run.alias("run"),
        "checkpoint_run",
        F.col("dir").alias("checkpoint_dir_name"),
        F.coalesce("c_target", F.lit(default_target)).alias("target_model"),
        F.coalesce(truthy_str("m_draft_init"), truthy_str("c_draft_init"), "c_draft_default", F.lit("")).alias("draft_init"),
        F.coalesce("c_loss_kind", F.lit("")).alias("loss_kind"),
        F.col("c_loss_alpha").alias("loss_alpha"),
        F.col("c_loss_temperature").alias("loss_temperature"),
        "data_id",
        F.coalesce("c_response_source", infer_response_source("checkpoint_run", "data_id")).alias("response_source"),
        F.col("c_seed").alias("seed"),
        F.col("m_train_loss_final").alias("train_loss_final"),
        F.coalesce("m_steps", "c_steps").alias("steps"),
        path(root, "dir").alias("checkpoint_dir"),
        path(root, "dir", F.lit("model")).alias("model_dir"),
        path(root, "dir", F.lit(CONFIG_FILE)).alias("config_path"),
        F.col("c_prompts_jsonl").alias("prompts_jsonl"),
        path(results, run, F.lit("eval_summary.json")).alias("summary_path"),
    )


def sweep_table(records: DataFrame, statuses: DataFrame, summaries: DataFrame, eval_config: Mapping[str, object], score_cols: Sequence[str] = ()) -> DataFrame:
    """J01 + J02: the fixed sweep columns and one ``quality_score.<name>`` per
    named score: every record with its process status (``not_run`` without
    one) and the flat metrics of its summary (blank without one).

    ``statuses``: run, status, returncode, elapsed_s. ``summaries``: as
    ``flatten_summary`` gives them, with ``summary_path``.
    """
    extras = sorted(f"quality_score.{n}" for n in score_cols)
    flat = summaries.select("summary_path", *[F.col(f"`{c}`") for c in summaries.columns if c in SWEEP_CSV_COLUMNS or c in extras if c not in ("run", "summary_path")])
    j = records.join(statuses.select("run", "status", "returncode", "elapsed_s"), "run", "left").join(flat, "summary_path", "left")
    j = j.withColumn("status", F.coalesce("status", F.lit("not_run")))
    have = set(j.columns)

    def column(name: str) -> Column:
        if name in eval_config:
            return F.lit(eval_config[name]).alias(name)
        return F.col(f"`{name}`") if name in have else F.lit(None).cast("string").alias(name)

    return j.select(*[column(c) for c in [*SWEEP_CSV_COLUMNS, *extras]])


def run_summary(
    totals: DataFrame,
    pooled: DataFrame,
    scores: DataFrame,
    *,
    model: str,
    target: str,
    draft: str | None,
    engine: str,
    decoding: Mapping[str, object],
    n_warmup: int,
    n_repeats: int,
) -> DataFrame:
    """The run-summary document of one run, one row with the 14 required keys
    and ``engines``, from the one-row results of ``run_totals`` and
    ``sd_aggregate`` and the rows of the score table. A baseline that was not
    run is NaN at the top and null in the engine block."""
    one = lambda df, name: df.select(F.struct("*").alias(name)).withColumn("_one", F.lit(1))
    quality = scores.agg(F.map_from_entries(F.coalesce(F.collect_list(F.struct("name", "score")), F.array().cast("array<struct<name:string,score:double>>"))).alias("quality_score"))
    # Three single rows meet under one key.
    j = one(totals, "t").join(F.broadcast(one(pooled, "p")), "_one").join(F.broadcast(quality.withColumn("_one", F.lit(1))), "_one")
    t, p = (lambda c: F.col(f"t.{c}")), (lambda c: F.col(f"p.{c}"))
    block = F.struct(
        t("sd_time_s").alias("sd_time_s"),
        F.when(~F.isnan(t("vanilla_time_s")), t("vanilla_time_s")).alias("vanilla_time_s"),
        *[t(c).alias(c) for c in ("tokens_per_second", "speedup")],
        *[p(c).alias(c) for c in pooled.columns],
        F.lit(False).alias("batched"),
    )
    return j.select(
        F.lit(model).alias("model"),
        F.lit(target).alias("target"),
        F.lit(draft).cast("string").alias("draft"),
        p("acceptance_rate").alias("acceptance_rate"),
        p("avg_accepted_tokens").alias("avg_accepted_tokens"),
        *[t(c).alias(c) for c in ("vanilla_time_s", "sd_time_s", "speedup", "tokens_per_second")],
        "quality_score",
        F.struct(*[F.lit(v).alias(k) for k, v in decoding.items()]).alias("decoding"),
        t("n_prompts").alias("n_prompts"),
        F.lit(n_warmup).alias("n_warmup"),
        F.lit(n_repeats).alias("n_repeats"),
        F.struct(block.alias(engine)).alias("engines"),
    )
