"""Tables that grow by commits: replays, retries, late files (S08, ST2)."""

import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from sparkdraft.sources.committed import BUCKETS, Commits, append_runs, compact_runs, read_newest, read_runs, upsert_newest
from sparkdraft.streaming.jobs import read_sweep_rows, run_line_stream, start_sweep_rows, summary_stream
from tests.test_sources import summary_doc, write


def runs(spark, *rows):
    return spark.createDataFrame(list(rows), "run string, speedup double, note string")


def held(spark, root):
    return sorted(tuple(r) for r in read_runs(spark, root).collect())


def test_replayed_append_changes_nothing(spark, tmp_dir):
    one = runs(spark, ("a", 1.0, 'quo"ted, \n line'), ("b", float("nan"), None), ("b", 9.0, "again"), (None, 3.0, "lost"))
    assert append_runs(spark, one, tmp_dir, "job-1") is True
    first = held(spark, tmp_dir)
    assert [r[0] for r in first] == ["a", "b"] and first[0][2] == 'quo"ted, \n line'
    assert append_runs(spark, one, tmp_dir, "job-1") is False
    assert append_runs(spark, runs(spark, ("x", 1.0, "other rows, same commit")), tmp_dir, "job-1") is False
    assert append_runs(spark, runs(spark, ("a", 7.0, "sent again"), ("c", 2.0, "")), tmp_dir, "job-2") is True
    assert [(r[0], r[1]) for r in held(spark, tmp_dir) if r[0] != "b"] == [("a", 1.0), ("c", 2.0)]


def test_append_that_died_is_not_read_and_can_be_retried(spark, tmp_dir):
    append_runs(spark, runs(spark, ("a", 1.0, "x")), tmp_dir, "job-1")
    # Rows written, commit not reached.
    runs(spark, ("half", 5.0, "y")).write.option("header", True).csv(Commits(spark, tmp_dir).data("job-2"))
    assert [r[0] for r in held(spark, tmp_dir)] == ["a"]
    assert append_runs(spark, runs(spark, ("b", 2.0, "y")), tmp_dir, "job-2") is True
    assert [r[0] for r in held(spark, tmp_dir)] == ["a", "b"]


def test_columns_of_later_commits(spark, tmp_dir):
    append_runs(spark, runs(spark, ("a", 1.0, "x")), tmp_dir, "1")
    append_runs(spark, spark.createDataFrame([("b", 2)], "run string, speedup int"), tmp_dir, "2")
    assert held(spark, tmp_dir) == [("a", 1.0, "x"), ("b", 2.0, None)]
    with pytest.raises(ValueError, match="does not have: extra"):
        append_runs(spark, runs(spark, ("c", 1.0, "x")).withColumn("extra", F.lit(1)), tmp_dir, "3")
    with pytest.raises(FileNotFoundError):
        read_runs(spark, tmp_dir + "/none")
    append_runs(spark, runs(spark, ("z", 1.0, "x")).limit(0), tmp_dir, "4")
    assert len(held(spark, tmp_dir)) == 2


def test_compaction_keeps_rows_and_what_was_sent(spark, tmp_dir):
    for i in range(4):
        append_runs(spark, runs(spark, (f"r{i}", float(i), None)), tmp_dir, f"job-{i}")
    before = held(spark, tmp_dir)
    assert compact_runs(spark, tmp_dir).startswith("compact-") and held(spark, tmp_dir) == before
    assert append_runs(spark, runs(spark, ("other", 0.0, None)), tmp_dir, "job-2") is False
    assert compact_runs(spark, tmp_dir) is None
    append_runs(spark, runs(spark, ("r9", 9.0, None)), tmp_dir, "job-9")
    assert len(held(spark, tmp_dir)) == 5
    assert len(os.listdir(f"{tmp_dir}/data")) == 2


def keyed(spark, *rows):
    return spark.createDataFrame(list(rows), "run string, at double, v int")


def test_newest_row_per_key_in_any_order(spark, tmp_dir):
    put = lambda batch, *rows, source="s": upsert_newest(spark, keyed(spark, *rows), tmp_dir, source, batch, key="run", newest=["at"])
    rows = lambda: sorted(tuple(r) for r in read_newest(spark, tmp_dir).collect())
    assert put(0, ("a", 1.0, 1), ("b", 5.0, 2), ("b", 4.0, 3), (None, 1.0, 4))
    assert rows() == [("a", 1.0, 1), ("b", 5.0, 2)]
    assert not put(0, ("a", 9.0, 9)) and rows() == [("a", 1.0, 1), ("b", 5.0, 2)]
    assert put(1, ("a", 0.5, 8), ("b", 6.0, 7), ("c", 1.0, 1), ("c", 1.0, 2))
    assert rows() == [("a", 1.0, 1), ("b", 6.0, 7), ("c", 1.0, 2)]
    # Another stream over the same files brings the same rows.
    assert put(0, ("a", 1.0, 1), ("b", 5.0, 2), source="t") and rows() == [("a", 1.0, 1), ("b", 6.0, 7), ("c", 1.0, 2)]
    assert put(2, ("d", 1.0, 1)) and put(3) and len(rows()) == 4


def test_state_does_not_grow_with_batches(spark, tmp_dir):
    for i in range(12):
        upsert_newest(spark, keyed(spark, *[(f"r{k}", float(i), k) for k in range(5)]), tmp_dir, "s", i, key="run", newest=["at"], buckets=4)
    assert len(Commits(spark, tmp_dir).names()) == 2
    files = [f for d, _, fs in os.walk(f"{tmp_dir}/data") for f in fs if f.endswith(".parquet")]
    assert len(files) <= 2 * 4 and read_newest(spark, tmp_dir).count() == 5
    assert {r["at"] for r in read_newest(spark, tmp_dir).collect()} == {11.0}
    assert BUCKETS == 64


def test_stream_restart_replay_and_late_files(spark, tmp_dir):
    src, table, ck = (os.path.join(tmp_dir, x) for x in ("src", "table", "ck"))

    def line(run, at, speedup):
        return json.dumps({"run": run, "finished_at": at, "speedup": speedup, "quality_score": {"em": 0.5}, "engines": {"vllm": {"num_drafts": 3}}})

    def go(folder=ck):
        start_sweep_rows(run_line_stream(spark, src, ["em"]), table, folder, newest=("finished_at",)).awaitTermination()
        return {r["run"]: (r["speedup"], r["quality_score.em"]) for r in read_sweep_rows(spark, table).collect()}

    write(f"{src}/1.json", line("a", 1, 1.0) + "\n" + line("b", 2, 2.0) + "\n")
    assert go() == {"a": (1.0, 0.5), "b": (2.0, 0.5)}
    write(f"{src}/2.json", line("b", 1, 99.0) + "\n" + line("c", 3, 3.0) + "\n")  # late: b's older summary
    write(f"{src}/3.json", line("a", 5, 5.0) + "\n")
    assert go() == {"a": (5.0, 0.5), "b": (2.0, 0.5), "c": (3.0, 0.5)}
    # The stream's record of the last batch is lost: it is run again and changes nothing.
    commits = f"{ck}/commits"
    last = max(int(f) for f in os.listdir(commits) if f.isdigit())
    for f in (f"{commits}/{last}", f"{commits}/.{last}.crc"):
        if os.path.exists(f):
            shutil.move(f, os.path.join(tmp_dir, "moved-" + os.path.basename(f)))
    n = Commits(spark, table).names()
    assert go() == {"a": (5.0, 0.5), "b": (2.0, 0.5), "c": (3.0, 0.5)} and Commits(spark, table).names() == n
    # A new stream reads all files from the start.
    assert go(os.path.join(tmp_dir, "ck-new")) == {"a": (5.0, 0.5), "b": (2.0, 0.5), "c": (3.0, 0.5)}


def test_rewritten_summary_files(spark, tmp_dir):
    root, table = os.path.join(tmp_dir, "runs"), os.path.join(tmp_dir, "sweep")
    go = lambda: start_sweep_rows(summary_stream(spark, root, []), table, os.path.join(tmp_dir, "ck")).awaitTermination()
    write(os.path.join(root, "r", "old", "eval_summary.json"), summary_doc(speedup="1.0"))
    os.utime(os.path.join(root, "r", "old", "eval_summary.json"), (1_000_000_000, 1_000_000_000))
    go()
    write(os.path.join(root, "r2", "old", "eval_summary.json"), summary_doc(speedup="2.0"))
    go()
    assert [(r["run"], r["speedup"]) for r in read_sweep_rows(spark, table).collect()] == [("old", 2.0)]
