"""Checkpoint discovery, record precedence, the sweep table and the summary builder."""

import pytest
from pyspark.sql import functions as F

from sparkdraft.operators.discovery import checkpoint_inventory, checkpoint_records, run_summary, sweep_table
from sparkdraft.operators.summaries import REQUIRED_SUMMARY_KEYS, SWEEP_CSV_COLUMNS, validate_summaries

CONFIG = "dir string, run_name string, data_id string, response_source string, target string, draft_init string, draft_default string, loss_kind string, loss_alpha double, loss_temperature double, seed long, steps long, prompts_jsonl string"
META = "dir string, run_name string, dataset_id string, draft_init string, train_loss_final double, steps long"


def inventory(spark, weights):
    rows = [(r, f) for r, w in weights.items() for f in ["config.yaml", "model/config.json", w]]
    return checkpoint_inventory(spark.createDataFrame(rows, "run_id string, file string"))


def test_any_kind_of_weights_completes_a_checkpoint(spark):
    weights = {
        "a": "model/model.safetensors", "b": "model/model-00001-of-00002.safetensors", "c": "model/pytorch_model-1.bin", "d": "model/model.safetensors.index.json",
        "e": "model/pytorch_model.bin.index.json", "f": "model/optimizer.bin", "g": "other/model.safetensors", "h": "model/sub/x.safetensors",
    }
    got = {r["run_id"]: (r["complete"], r["reason"]) for r in inventory(spark, weights).collect()}
    assert all(got[k] == (True, None) for k in "abcde")
    assert all(got[k] == (False, "missing model weights") for k in "fgh")
    bare = checkpoint_inventory(spark.createDataFrame([("x", "notes.txt")], "run_id string, file string")).collect()[0]
    assert bare["reason"] == "missing config.yaml; missing model/config.json; missing model weights"


def records(spark, configs, metas, dirs):
    files = inventory(spark, {d: "model/model.safetensors" for d in dirs})
    df = checkpoint_records(
        files, spark.createDataFrame(configs, CONFIG), spark.createDataFrame(metas, META),
        gamma=4, max_new_tokens=256, default_target="t0", checkpoint_root="/c/", results_root="/r",
    )
    return df


def test_precedence_by_field(spark):
    configs = [("full", "named", "set", "src", "t1", "ci", "cd", "jsd", 0.5, 1.0, 7, 100, "/p"), ("bare", *[None] * 12)]
    metas = [("full", "mn", "md", "mi", 1.25, 90), ("bare", "", "", "", None, None)]
    got = {r["checkpoint_dir_name"]: r.asDict() for r in records(spark, configs, metas, ["full", "bare", "jsd_tgen_1"]).collect()}
    full = got["full"]
    assert (full["run"], full["data_id"], full["response_source"], full["target_model"]) == ("named_eval_g4_max256", "set", "src", "t1")
    assert (full["draft_init"], full["steps"], full["train_loss_final"]) == ("mi", 90, 1.25)
    assert full["summary_path"] == "/r/named_eval_g4_max256/eval_summary.json" and full["model_dir"] == "/c/full/model"
    bare = got["bare"]
    assert (bare["checkpoint_run"], bare["data_id"], bare["response_source"], bare["target_model"], bare["draft_init"], bare["steps"]) == ("bare", "", "original", "t0", "", None)
    assert got["jsd_tgen_1"]["response_source"] == "target_generated"


def test_sweep_table_has_all_columns_and_blanks(spark):
    recs = records(spark, [("a", *[None] * 12), ("b", *[None] * 12)], [], ["a", "b"])
    statuses = spark.createDataFrame([("a_eval_g4_max256", "ok", 0, 2.5)], "run string, status string, returncode int, elapsed_s double")
    flat = spark.createDataFrame([("/r/a_eval_g4_max256/eval_summary.json", 1.5, 0.25)], "summary_path string, speedup double, `quality_score.x` double")
    out = sweep_table(recs, statuses, flat, {"gamma": 4}, ["x"])
    assert out.columns == [*SWEEP_CSV_COLUMNS, "quality_score.x"]
    got = {r["run"]: r for r in out.collect()}
    a, b = got["a_eval_g4_max256"], got["b_eval_g4_max256"]
    assert (a["status"], a["returncode"], a["speedup"], a["quality_score.x"], a["gamma"]) == ("ok", 0, 1.5, 0.25, 4)
    assert (b["status"], b["returncode"], b["speedup"], b["quality_score.x"]) == ("not_run", None, None, None)


@pytest.mark.parametrize("vanilla", [8.0, float("nan")])
def test_summary_is_valid(spark, vanilla):
    totals = spark.createDataFrame([(1, 2.0, vanilla, 1.4, 3.0)], "n_prompts long, sd_time_s double, vanilla_time_s double, speedup double, tokens_per_second double")
    pooled = spark.createDataFrame([(0.5, 2.0, 9)], "acceptance_rate double, avg_accepted_tokens double, n_outer_steps long")
    scores = spark.createDataFrame([("x", 0.5)], "name string, score double")
    for s in (scores, scores.limit(0)):
        doc = run_summary(totals, pooled, s, model="m", target="t", draft="d", engine="hf", decoding={"mode": "greedy", "top_p": 1.0}, n_warmup=1, n_repeats=1)
        assert set(REQUIRED_SUMMARY_KEYS) | {"engines"} == set(doc.columns)
        row = doc.collect()[0]
        assert (row["engines"]["hf"]["vanilla_time_s"] is None) == (vanilla != vanilla)
        raw = doc.select(F.lit("r").alias("run"), F.to_json(F.struct("*"), {"allowNonNumericNumbers": "true"}).alias("value"))
        assert validate_summaries(raw).count() == 0
