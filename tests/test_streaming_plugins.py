"""Streaming jobs (ST1, ST2) and plug-ins."""

import os
import shutil

import pandas as pd
from pyspark.sql import functions as F

from sparkdraft.plugins.generation import apply_collator, echo_generator, generate_responses, rewrite_response, tokenizer_udf
from sparkdraft.plugins.scorers import Score, ScoreTable
from sparkdraft.streaming.jobs import (
    ingest_stream,
    read_sweep_rows,
    start_ingest,
    start_sweep_rows,
    summary_stream,
)
from tests.test_sources import summary_doc, write


def test_st1_incremental_ingest(spark, tmp_dir):
    src = os.path.join(tmp_dir, "raw")
    write(os.path.join(src, "a.jsonl"), '{"id": "1", "prompt": " hi ", "response": "yo"}\n{"id": "2", "prompt": "", "response": "x"}\n')
    out, ck = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck")
    schema = "id string, prompt string, response string"
    q = start_ingest(ingest_stream(spark, src, schema, family="chat", dataset_name="d", split="train"), out, ck)
    q.awaitTermination()
    write(os.path.join(src, "b.jsonl"), '{"id": "3", "prompt": "p3", "response": "r3"}\n')
    q = start_ingest(ingest_stream(spark, src, schema, family="chat", dataset_name="d", split="train"), out, ck)
    q.awaitTermination()
    got = sorted((r["id"], r["prompt_text"]) for r in spark.read.json(out).collect())
    assert got == [("1", "hi"), ("3", "p3")]


def test_st2_one_row_per_run(spark, tmp_dir):
    root = os.path.join(tmp_dir, "runs")
    write(os.path.join(root, "runA", "eval_summary.json"), summary_doc(speedup="1.1"))
    table, ck = os.path.join(tmp_dir, "sweep"), os.path.join(tmp_dir, "ck2")
    start_sweep_rows(summary_stream(spark, root, ["exact_match_vs_target"]), table, ck).awaitTermination()
    write(os.path.join(root, "runB", "eval_summary.json"), summary_doc(speedup="0.9"))
    start_sweep_rows(summary_stream(spark, root, ["exact_match_vs_target"]), table, ck).awaitTermination()
    rows = {r["run"]: r["speedup"] for r in read_sweep_rows(spark, table).collect()}
    assert rows == {"runA": 1.1, "runB": 0.9}


def test_generation_plugin_and_rewrite(spark):
    from sparkdraft.operators.prep import METADATA_TYPE

    recs = spark.createDataFrame(
        [("a", "pa", "old-a", "chat", None), ("b", "pb", "old-b", "chat", None)],
        f"id string, prompt_text string, response_text string, source string, metadata {METADATA_TYPE.simpleString()}",
    )
    gens = generate_responses(recs.withColumn("prompt_input", F.col("prompt_text")), echo_generator, {}, request_batch_size=64)
    out = {r["id"]: r for r in rewrite_response(gens, "2026-01-01T00:00:00Z").collect()}
    assert {out["a"]["response_text"], out["b"]["response_text"]} <= {"generated-0", "generated-1"}
    assert out["a"]["source"] == "target" and out["a"]["metadata"]["original_response_text"] == "old-a"
    assert out["b"]["metadata"]["response_generated_at"] == "2026-01-01T00:00:00Z"


def test_tokenizer_udf_and_collator(spark):
    def factory():
        return lambda texts: [[ord(c) for c in s] for s in texts]

    df = spark.createDataFrame([("ab",), (None,), ("c",)], "t string")
    ids = [r["ids"] for r in df.select(tokenizer_udf(factory)("t").alias("ids")).collect()]
    assert ids == [[97, 98], None, [99]]

    def collate(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"b": [pdf["b"].iloc[0]], "n": [len(pdf)]})

    b = spark.createDataFrame([(0, 1), (0, 2), (1, 3)], "b long, x long")
    assert sorted(tuple(r) for r in apply_collator(b, "b", collate, "b long, n long").collect()) == [(0, 2), (1, 1)]


def test_equal_ids_keep_their_rows_and_one_build_per_worker(spark, tmp_dir):
    from sparkdraft.plugins.generation import generate_responses

    def factory():
        import os
        import uuid

        open(f"{tmp_dir}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return lambda prompts, params: [p.upper() for p in prompts]

    df = spark.createDataFrame([("k", "one"), ("k", "two")] + [(str(i), f"p{i}") for i in range(64)], "id string, prompt_input string").repartition(32)
    for _ in range(2):
        got = sorted(tuple(r) for r in generate_responses(df, factory, {}).collect())
    assert got == sorted([("k", "one", "ONE"), ("k", "two", "TWO")] + [(str(i), f"p{i}", f"P{i}") for i in range(64)])
    import os

    builds = [f.split("-")[0] for f in os.listdir(tmp_dir)]
    assert len(builds) == len(set(builds))


def test_scorers(spark):
    g = spark.createDataFrame([(" x ", "x"), ("y", "z"), ("a", "a"), ("b", "c")], "generation string, target_generation string")
    table = ScoreTable({"length": Score(("generation",), F.length("generation")), "fails": Score(("generation",), "cast(generation as double)"), "lost": Score(("nowhere",), F.col("nowhere")), "wrong": Score(("generation",), "no_such_function(generation)")})
    s = {r["name"]: r["score"] for r in table.scores(g, ["exact_match_vs_target", "no_such_scorer", "length", "lost", "wrong"]).collect()}
    assert s == {"exact_match_vs_target": 0.5, "length": 1.5}
    usable, refused = table.split(g, ["length", "no_such_scorer", "lost", "wrong"])
    assert list(usable) == ["length"] and set(refused) == {"no_such_scorer", "lost", "wrong"}
    assert ScoreTable().scores(g, ["nothing"]).count() == 0
    assert [r["score"] for r in ScoreTable().scores(g.limit(0), ["exact_match_vs_target"]).collect()] == [0.0]


def test_corpus_scores(spark):
    from collections import Counter

    from sparkdraft.plugins import corpus_scores
    from sparkdraft.plugins.corpus_scores import CorpusScore, CorpusScores

    rows = [("a b a c", "a b b"), ("x y", "x y z"), (None, "q"), ("a a a", "a a"), ("", "")] * 9
    g = spark.createDataFrame(rows, "generation string, target_generation string").repartition(7)

    def pooled(n):
        hit = all_ = 0
        for a, b in rows:
            ga, gb = (Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for w in ((a or "").split(" "), (b or "").split(" ")))
            hit, all_ = hit + sum(min(c, gb[k]) for k, c in ga.items()), all_ + sum(ga.values())
        return hit / all_

    def state_too_large(state, rows):
        return state + b"x" * (corpus_scores.MOST_BYTES + 1)

    def cannot_merge(a, b):
        raise RuntimeError("merge")

    def cannot_start():
        raise KeyError("start")

    most = CorpusScore(("generation",), lambda: 0, lambda s, rows: s + len(rows), lambda a, b: a + b, float)
    extra = {
        "rows": most,
        "large": CorpusScore(("generation",), bytes, state_too_large, lambda a, b: a + b, len),
        "unmerged": CorpusScore(("generation",), lambda: 0, lambda s, rows: s, cannot_merge, float),
        "unstarted": CorpusScore(("generation",), cannot_start, lambda s, rows: s, max, float),
        "lost": CorpusScore(("nowhere",), lambda: 0, lambda s, rows: s, max, float),
        "text": CorpusScore(("generation",), lambda: "z", lambda s, rows: s, max, float),
    }
    wanted = ["pooled_unigram_overlap", "pooled_bigram_overlap", *extra, "never", "rows"]
    got = {r["name"]: (r["score"], r["problem"]) for r in CorpusScores(extra).scores(g, wanted).collect()}
    assert set(got) == set(wanted)
    assert abs(got["pooled_unigram_overlap"][0] - pooled(1)) < 1e-12 and abs(got["pooled_bigram_overlap"][0] - pooled(2)) < 1e-12
    assert got["rows"] == (45.0, None)
    assert got["large"][1].startswith("state of ") and got["unmerged"][1] == "RuntimeError: merge" and got["unstarted"][1] == "KeyError: 'start'"
    assert got["lost"] == (None, "lacks nowhere") and got["never"] == (None, "not declared") and got["text"][1].startswith("ValueError")
    empty = {r["name"]: r["score"] for r in CorpusScores(extra).scores(g.limit(0), ["rows", "pooled_bigram_overlap"]).collect()}
    assert empty == {"rows": 0.0, "pooled_bigram_overlap": 0.0}
    # The partitioning does not change a score.
    for n in (1, 64):
        assert CorpusScores().scores(g.repartition(n), ["pooled_bigram_overlap"]).first()["score"] == got["pooled_bigram_overlap"][0]


def test_user_collator_equals_native_padding(spark):
    import pytest

    from sparkdraft.operators.tokens import pad_to_batch_max, tokenize_records
    from sparkdraft.plugins.generation import length_batches, pad_collator

    rows = [(str(i), "p" * (i * 7 % 13), "r" * (1 + i * 5 % 11)) for i in range(30)]
    ex = tokenize_records(spark.createDataFrame(rows, "id string, prompt_text string, response_text string"), max_seq_len=64).drop("prompt_len", "response_len")
    batches = length_batches(ex, F.size("input_ids"), "id", 4)
    sizes = [r["n"] for r in batches.groupBy("batch_id").agg(F.count("*").alias("n")).collect()]
    assert sorted(sizes) == [2, 4, 4, 4, 4, 4, 4, 4]
    native = pad_to_batch_max(batches, "batch_id")
    padded = apply_collator(batches, "batch_id", pad_collator(0, -100), batches.select("*", F.lit(0).alias("n_pad")).schema, most=4).select(*native.columns)
    key = lambda r: r["id"]
    assert sorted(padded.collect(), key=key) == sorted(native.collect(), key=key)
    # Neighbours in length: less padding than in the order of the ids.
    assert padded.agg(F.sum("n_pad")).first()[0] < 40
    with pytest.raises(Exception, match="has 4 rows, at most 3"):
        apply_collator(batches, "batch_id", pad_collator(0, -100), batches.select("*", F.lit(0).alias("n_pad")).schema, most=3).collect()
