"""Sources/sinks (S01-S15) and summary documents."""

import json
import math
import os

import pytest
from pyspark.sql import functions as F

from sparkdraft.operators.summaries import (
    SUMMARY_SCHEMA,
    SWEEP_CSV_COLUMNS,
    experiment_key,
    first_hit_lookup,
    flatten_metrics_long,
    flatten_summary,
    assert_valid,
    quality_scores_long,
    score_names,
    validate_summaries,
)
from sparkdraft.sources.files import (  # noqa: I001
    csv_scan,
    csv_sink_dynamic,
    dynamic_columns,
    final_metrics_scan,
    inline_prompts,
    inventory_scan,
    jsonl_scan,
    jsonl_sink,
    log_metric_scan,
    nonblank_line_count,
    parse_split_slice,
    prompt_source,
    split_sink,
    summary_scan,
)


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(text)


def test_jsonl_roundtrip_and_blank_lines(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in", "a.jsonl")
    write(src, '{"id": "1", "prompt_text": "héllo", "response_text": null}\n\n   \n{"id": "2", "prompt_text": "b", "response_text": "c"}\n')
    df = jsonl_scan(spark, src, "id string, prompt_text string, response_text string")
    assert df.count() == 2
    out = os.path.join(tmp_dir, "out")
    jsonl_sink(df, out)
    text = "".join(open(os.path.join(out, f), encoding="utf-8").read() for f in os.listdir(out) if f.endswith(".json"))
    assert '"response_text":null' in text and "héllo" in text
    assert nonblank_line_count(spark, src) == 2
    bad = os.path.join(tmp_dir, "bad.jsonl")
    write(bad, '{"id": "1"}\n{not json\n')
    with pytest.raises(Exception):
        jsonl_scan(spark, bad, "id string").collect()


def summary_doc(speedup="1.4", vanilla="8.0", quality='{"exact_match_vs_target": 0.25}', engines=None, drop=None):
    d = {
        "model": "run", "target": "t", "draft": "d", "acceptance_rate": 0.5, "avg_accepted_tokens": 2.0,
        "vanilla_time_s": "__V__", "sd_time_s": 2.0, "speedup": "__S__", "tokens_per_second": 2.0,
        "quality_score": "__Q__", "decoding": {"mode": "greedy", "max_new_tokens": 256, "num_assistant_tokens": 4,
                                                "temperature": 0.0, "top_p": 1.0},
        "n_prompts": 1, "n_warmup": 1, "n_repeats": 1,
        "engines": engines or {"vllm": {"num_drafts": 8, "num_draft_tokens": 32, "num_accepted_tokens": 16,
                                        "request_batch_size": 8, "batched": True}},
    }
    if drop:
        d.pop(drop)
    s = json.dumps(d, indent=2)
    return s.replace('"__V__"', vanilla).replace('"__S__"', speedup).replace('"__Q__"', quality)


def test_summary_scan_flatten(spark, tmp_dir):
    write(os.path.join(tmp_dir, "runA", "eval_summary.json"), summary_doc())
    write(os.path.join(tmp_dir, "runB", "eval_summary.json"), summary_doc(vanilla="NaN", quality="{}"))
    s = summary_scan(spark, os.path.join(tmp_dir, "*", "eval_summary.json"), SUMMARY_SCHEMA)
    names = [r["name"] for r in score_names(s).collect()]
    assert [tuple(r) for r in quality_scores_long(s).collect()] == [("runA", "exact_match_vs_target", 0.25)]
    assert names == ["exact_match_vs_target"]
    flat = {r["run"]: r.asDict() for r in flatten_summary(s, names).collect()}
    a, b = flat["runA"], flat["runB"]
    assert (a["vllm_num_drafts"], a["vllm_num_draft_tokens"], a["vllm_num_accepted_tokens"]) == (8, 32, 16)
    assert a["quality_score.exact_match_vs_target"] == 0.25
    assert b["vanilla_time_s"] is None  # NaN is blanked
    assert b["quality_score.exact_match_vs_target"] is None
    cols = dynamic_columns(flatten_summary(s, names), SWEEP_CSV_COLUMNS)
    assert cols[-1] == "quality_score.exact_match_vs_target" and cols[0] == "run"
    out = os.path.join(tmp_dir, "csv")
    csv_sink_dynamic(flatten_summary(s, names), out, SWEEP_CSV_COLUMNS)
    back = spark.read.option("header", True).csv(out)
    assert back.columns == cols and back.count() == 2


def test_flatten_metrics_long_drops_non_numbers(spark, tmp_dir):
    eng = {"hf": {"speedup": 1.4, "target_calls": 12, "batched": False, "note": "text", "quoted": "5"}, "tgi": {"speedup": 2.5, "new_counter": 7, "list": [1]}}
    raw = spark.createDataFrame([("r", summary_doc(quality='{"mt_bench": 6.8}', engines=eng))], "run string, value string")
    m = {r["metric"]: r["value"] for r in flatten_metrics_long(raw).collect()}
    assert m["eval/tgi/speedup"] == 2.5 and m["eval/tgi/new_counter"] == 7
    assert "eval/hf/quoted" not in m and "eval/tgi/list" not in m
    assert m["eval/hf/target_calls"] == 12 and m["eval/quality/mt_bench"] == 6.8
    assert "eval/hf/batched" not in m and "eval/hf/note" not in m
    assert m["eval/speedup"] == 1.4


def test_validate_summary(spark):
    docs = [("ok", summary_doc()), ("missing", summary_doc(drop="speedup")), ("wrongtype", summary_doc(quality="1.0")),
            ("badengine", summary_doc(engines={"hf": 3}))]
    raw = spark.createDataFrame(docs, "run string, value string")
    probs = {}
    for r in validate_summaries(raw).collect():
        probs.setdefault(r["run"], []).append(r["problem"])
    assert "ok" not in probs
    assert probs["missing"] == ["missing required key: speedup"]
    assert probs["wrongtype"] == ["quality_score is not an object"]
    assert probs["badengine"] == ["engine hf is not an object"]
    broken = spark.createDataFrame([("cut", summary_doc()[:80]), ("list", "[1, 2]"), ("empty", ""), ("null", None)], "run string, value string")
    assert {(r["run"], r["problem"]) for r in validate_summaries(broken).collect()} == {(k, "not a JSON object") for k in ("cut", "list", "empty", "null")}
    assert assert_valid(raw.filter("run = 'ok'")).count() == 1
    for df in (raw, broken):
        with pytest.raises(Exception, match="invalid eval summary"):
            assert_valid(df).count()
        with pytest.raises(Exception, match="invalid eval summary"):
            assert_valid(df).collect()


def test_log_metric_scan(spark, tmp_dir):
    p = os.path.join(tmp_dir, "logs", "train.log")
    write(p, "step 1\r{'loss': 1.0, 'eval_loss': 0.91}\r\nfoo {'eval_loss': 0.85} {'eval_loss': 0.80}\n"
             "acceptance_rate=0.459 avg_accepted_tokens=1.83 speedup=0.50x tokens/s=22.2\n")
    got = [r["eval_loss"] for r in log_metric_scan(spark, p).orderBy("line_no", "match_no").collect()]
    assert got == [0.91, 0.85, 0.80]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:  # the same from many blocks
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        q = os.path.join(tmp_dir, "logs", "long.log")
        write(q, "".join(f"step {i}\r{{'eval_loss': {i}.5}}\n" for i in range(1000)) + "acceptance_rate=0.1 avg_accepted_tokens=1.0 speedup=9.0x tokens/s=1.0\n" * 2)
        losses = [r["eval_loss"] for r in log_metric_scan(spark, q).orderBy("line_no", "match_no").collect()]
        assert losses == [i + 0.5 for i in range(1000)]
        assert final_metrics_scan(spark, q).collect()[0]["speedup"] == 9.0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    f = final_metrics_scan(spark, p).collect()[0]
    assert (f["acceptance_rate"], f["speedup"], f["tokens_per_second"]) == (0.459, 0.5, 22.2)


def test_inventory_scan(spark, tmp_dir):
    for f in ("r1/config.yaml", "r1/model/config.json", "r1/model/model.safetensors", "r2/config.yaml"):
        write(os.path.join(tmp_dir, "ck", f), "x")
    inv = inventory_scan(spark, os.path.join(tmp_dir, "ck"))
    got = sorted((r["run"], r["file"], r["length"]) for r in inv.collect())
    assert ("r1", "model/model.safetensors", 1) in got and ("r2", "config.yaml", 1) in got and len(got) == 4


def test_prompt_sources_and_split_sink(spark, tmp_dir):
    assert [r["id"] for r in inline_prompts(spark).collect()] == [f"smoke-{i}" for i in range(4)]
    assert prompt_source(spark, limit=2).count() == 2
    ds = spark.createDataFrame([("b", "q2"), ("a", "q1")], "id string, question string")
    got = prompt_source(spark, dataset=ds, dataset_name="hf", prompt_field="question", order_col="id", limit=1).collect()
    assert [(r["id"], r["prompt_text"], r["source"]) for r in got] == [("a", "q1", "hf")]
    assert parse_split_slice("train_sft[:32]") == ("train_sft", 32) and parse_split_slice("test") == ("test", None)
    df = spark.createDataFrame([("1", "train"), ("2", "val"), ("3", None)], "id string, split string")
    split_sink(df, os.path.join(tmp_dir, "splits"))
    parts = sorted(d for d in os.listdir(os.path.join(tmp_dir, "splits")) if d.startswith("split="))
    assert parts == ["split=train", "split=val"]


def test_experiment_key_and_lookup(spark):
    df = spark.createDataFrame([("fkl", "target_generated", 50000, 42, "x")], "kind string, src string, n long, seed long, extra string")
    k = df.select(experiment_key(["kind", "src", "n", "seed"], "kind", "src", "n", "seed").alias("k")).collect()[0]["k"]
    assert k.startswith("fkl_targetgen_50000_seed42_") and len(k.split("_")[-1]) == 8
    runs = spark.createDataFrame([("/c/r1/model", "/c/r1"), ("/c/r2/model", "/c/r2")], "parent string, dir string")
    meta = spark.createDataFrame([("/c/r1", "m1"), ("/c/r2/model", "m2b"), ("/c/r2", "m2a")], "path string, dataset_id string")
    got = {r["dir"]: (r["meta_path"], r["dataset_id"]) for r in first_hit_lookup(runs, meta, ["parent", "dir"]).collect()}
    assert got["/c/r1"] == ("/c/r1", "m1") and got["/c/r2"] == ("/c/r2/model", "m2b")


def test_lookup_by_any_number_of_ancestors(spark):
    from sparkdraft.operators.summaries import ancestor_paths

    runs = spark.createDataFrame([("/a/b/c", 1), ("/a/b/c", 2), ("/a/x", 3), ("/z", 4), (None, 5), ("/n", 6)], "dir string, n int")
    meta = spark.createDataFrame(
        [("/a/b", "old", 1), ("/a/b", "new", 2), ("/a", "twice-b", 1), ("/a", "twice-a", 1), (None, "lost", 9), ("/n", None, 0)], "path string, dataset_id string, mtime int"
    )
    by_rule = first_hit_lookup(runs, meta, ancestor_paths("dir"))
    assert sorted((r["n"], r["meta_path"], r["dataset_id"]) for r in by_rule.collect()) == [(1, "/a/b", "new"), (2, "/a/b", "new"), (3, "/a", "twice-a"), (4, None, None), (5, None, None), (6, "/n", None)]
    newest = first_hit_lookup(runs, meta, ancestor_paths("dir"), newest="mtime")
    assert {r["n"]: r["dataset_id"] for r in newest.collect()} == {1: "new", 2: "new", 3: "twice-b", 4: None, 5: None, 6: None}
    clash = runs.withColumn("dataset_id", F.lit("own")).withColumn("mtime", F.lit(7))
    assert first_hit_lookup(clash, meta, ["dir"]).columns == ["dir", "n", "meta_path", "dataset_id", "mtime"]
    assert first_hit_lookup(runs.limit(0), meta, ["dir"]).count() == 0 and first_hit_lookup(runs, meta.limit(0), ["dir"]).count() == 6


def test_lookup_spreads_frequent_lists_and_paths(spark):
    from sparkdraft.operators.summaries import _spread_join, ancestor_paths

    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    most = lambda df: max(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        runs = spark.range(0, 8000, 1, 8).select(F.when(F.col("id") < 7000, "/a/b").otherwise(F.concat(F.lit("/a/"), "id")).alias("dir"), "id")
        meta = spark.createDataFrame([("/a", "top"), ("/a/7999", "own"), ("/a/b", None)], "path string, dataset_id string")
        out = first_hit_lookup(runs, meta, ancestor_paths("dir"))
        assert most(out) < 2000  # all 7000 rows of the one list in one task otherwise
        got = {r["id"]: (r["meta_path"], r["dataset_id"]) for r in out.collect()}
        assert got == {i: ("/a/b", None) if i < 7000 else ("/a/7999", "own") if i == 7999 else ("/a", "top") for i in range(8000)}
        joined = _spread_join(runs.selectExpr("'/a' as path", "id"), meta, "path", "inner")
        assert joined.count() == 8000 and most(joined) < 2000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_typed_documents(spark):
    from sparkdraft.functions.documents import document, nested_get

    texts = ['{"a": {"b": 1.5, "q": "7", "t": true, "n": null, "i": 3, "s": "x"}}', '{"a": 1}', '{"a": {"b": NaN}}', "[1]", '{"a": 1} x', '{"a": 1} {"a": 2}', '{"a":', "", None, '{"a": 1, "a": 2}', ' {"a": {}} ']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("d", document("t"))
    get = lambda path, kind, default: [r[0] for r in df.orderBy("i").select(nested_get(F.col("d"), path, kind, default)).collect()]
    assert [r[0] for r in df.orderBy("i").select(F.col("d").isNull()).collect()] == [False] * 4 + [True] * 6 + [False]
    assert get("$.a.b", "double", -1.0)[:2] == [1.5, -1.0] and str(get("$.a.b", "double", -1.0)[2]) == "nan"
    assert get("$.a.q", "double", -1.0)[0] == -1.0 and get("$.a.q", "string", "")[0] == "7"
    assert get("$.a.t", "boolean", False)[0] is True and get("$.a.n", "string", "none")[0] == "none"
    assert get("$.a.i", "int", 0)[0] == 3 and get("$.a.b", "int", 0)[0] == 0 and get("$.a.i", "string", "?")[0] == "?"
    with pytest.raises(ValueError):
        nested_get(F.col("d"), "$.a", "date", None)


def test_numbers_keep_the_type_they_are_written_with(spark):
    quoted = summary_doc(speedup='"1.5"', engines={"vllm": {"speedup": 2.0, "note": {"speedup": "x"}}, "flag": True, "tgi": None})
    m = {r["metric"]: r["value"] for r in flatten_metrics_long(spark.createDataFrame([("r", quoted)], "run string, value string")).collect()}
    assert "eval/speedup" not in m and m["eval/vllm/speedup"] == 2.0 and m["eval/quality/exact_match_vs_target"] == 0.25
    none = spark.createDataFrame([("a", None), ("b", ""), ("c", "[1]"), ("d", quoted[:50]), ("e", quoted + " {}")], "run string, value string")
    assert flatten_metrics_long(none).count() == 0
    assert {r["problem"] for r in validate_summaries(spark.createDataFrame([("r", quoted)], "run string, value string")).collect()} == {"engine flag is not an object", "engine tgi is not an object"}


def test_manifest_and_csv_append(spark, tmp_dir):
    from sparkdraft.sources.files import csv_ready, job_timestamp, manifest_sink, split_manifest

    counts = spark.createDataFrame([("train", 5), ("val", 2), ("eval", 0)], "split string, n_rows long")
    m = split_manifest(spark, counts, data_id="d", seed=7)
    manifest_sink(m, os.path.join(tmp_dir, "manifest"))
    manifest_sink(m, os.path.join(tmp_dir, "manifest"))
    back = spark.read.json(os.path.join(tmp_dir, "manifest"))
    assert back.count() == 2 and back.collect()[0]["n_records"]["train"] == 5
    df = spark.createDataFrame([("r", [1.0, 2.0])], "run string, per_pos array<double>")
    assert csv_ready(df).collect()[0]["per_pos"] == "[1.0,2.0]"
    out = os.path.join(tmp_dir, "csv")
    csv_sink_dynamic(df, out, ["run", "per_pos"])
    csv_sink_dynamic(df, out, ["run", "per_pos"], mode="append")
    assert spark.read.option("header", True).csv(out).count() == 2
    assert job_timestamp().endswith("+00:00")


def test_prompt_records_and_amortised(spark):
    from sparkdraft.operators.decode import amortised_times
    from sparkdraft.operators.prep import prompt_records

    df = spark.createDataFrame([(None, "p", 3)], "id string, prompt_text string, idx long")
    r = prompt_records(df, "idx").collect()[0]
    assert (r["id"], r["prompt_text"], r["response_text"], r["source"]) == ("3", "p", None, None)
    rows = spark.createDataFrame([(1,), (2,)], "k int")
    out = amortised_times(rows, F.lit(10.0), F.lit(float("nan")), F.lit(2)).collect()
    assert out[0]["sd_s_avg"] == 5.0 and out[0]["vanilla_s_avg"] is None


def test_limits_follow_source_order(spark, tmp_dir):
    p = os.path.join(tmp_dir, "prompts.jsonl")
    write(p, "".join(json.dumps({"prompt_text": t}) + "\n" for t in ("z", "m", "a")))
    got = [r["prompt_text"] for r in prompt_source(spark, jsonl=p, limit=2).collect()]
    assert sorted(got) == ["m", "z"]
    df = spark.createDataFrame([("zebra", 0), ("mango", 1), ("apple", 2)], "prompt string, n int")
    assert [r["prompt_text"] for r in prompt_source(spark, dataset=df, order_col="n", limit=1).collect()] == ["zebra"]
    with pytest.raises(ValueError, match="order_col"):
        prompt_source(spark, dataset=df, limit=1)


def test_white_space_is_unicode_everywhere(spark, tmp_dir):
    from sparkdraft.functions.text import is_null_draft, str_to_bool

    p = os.path.join(tmp_dir, "lines.txt")
    write(p, "a\n\t\n  \n b \n")
    assert nonblank_line_count(spark, p) == 2
    df = spark.createDataFrame([("\tnone\n", "true\n"), ("x", "off")], "d string, b string")
    assert [tuple(r) for r in df.select(is_null_draft("d"), str_to_bool("b")).collect()] == [(True, True), (False, False)]


def test_first_rows_of_a_table(spark):
    from sparkdraft.sources.files import first_rows

    rows = [(i % 40, f"t{i}") for i in range(200)] + [(None, "n1"), (None, "n2")]
    df = spark.createDataFrame(rows, "k int, t string").repartition(5)
    order = sorted((-1 if k is None else k for k, _ in rows))
    for n in (0, 1, 2, 3, 7, 50, 201, 202, 500):
        got = sorted(-1 if r["k"] is None else r["k"] for r in first_rows(df, "k", n).collect())
        assert got == order[:n], n
        assert sorted(map(tuple, first_rows(df.repartition(3), "k", n).collect()), key=repr) == sorted(map(tuple, first_rows(df, "k", n).collect()), key=repr)
    assert first_rows(df.limit(0), "k", 5).count() == 0
