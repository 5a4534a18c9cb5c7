"""Queries over files: written from a driver table below the shared checkpoint
folder, then read back by the sources (S01-S09, S11, S13-S15) and the
streaming jobs (ST1, ST2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdraft.operators.summaries import SUMMARY_SCHEMA, SWEEP_CSV_COLUMNS, flatten_summary
from sparkdraft.plans.prep_queries import ALPACA_RAW_SQL, FIRST_EXCHANGE_SQL, PREPARE_SPLITS_BODY, _alpaca_norm_sql, alpaca_rows, chat_records, documents_splits
from sparkdraft.plans.registry import register, table
from sparkdraft.plans.summary_queries import FLAT_SQL, summary_docs
from sparkdraft.session import scratch_folder
from sparkdraft.sources.committed import append_runs, compact_runs, read_runs
from sparkdraft.sources.files import (
    csv_scan,
    csv_sink_dynamic,
    dataset_scan,
    dynamic_columns,
    inventory_scan,
    jsonl_scan,
    jsonl_sink,
    manifest_sink,
    nonblank_line_count,
    prompt_source,
    split_manifest,
    split_sink,
    summary_scan,
)
from sparkdraft.streaming.jobs import ingest_stream, read_sweep_rows, run_line_stream, start_ingest, start_sweep_rows

RECORD = "id string, prompt_text string, response_text string, source string"


@register("file_records", f"""
WITH rec AS ({FIRST_EXCHANGE_SQL})
SELECT id, prompt_text, response_text, source, CAST((SELECT count(*) FROM rec) AS BIGINT) AS n_lines FROM rec""")
def q_file_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S01 + S02 + S03 + S14: chat records written as JSON Lines, their lines counted and read again."""
    path = scratch_folder(spark, "records")
    jsonl_sink(chat_records(spark, sf_dir).select("id", "prompt_text", "response_text", "source"), path)
    return jsonl_scan(spark, path, RECORD).withColumn("n_lines", F.lit(nonblank_line_count(spark, path)).cast("long"))


def _flat_csv_sql() -> str:
    extra = "quality_score.exact_match_vs_target"
    held = {"speedup", "acceptance_rate", "avg_accepted_tokens", "tokens_per_second", "sd_time_s", "vanilla_time_s", "n_prompts", "n_warmup", "n_repeats", "vllm_num_drafts", "vllm_num_draft_tokens", "vllm_num_accepted_tokens", "vllm_request_batch_size"}
    cols = ", ".join(c if c in held | {"run"} else f"CAST(NULL AS VARCHAR) AS {c}" for c in SWEEP_CSV_COLUMNS)
    return f'SELECT {cols}, "{extra}" FROM ({FLAT_SQL})'


@register("file_summaries", _flat_csv_sql())
def q_file_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S04 + S06 + S07 + X19: one summary file per run directory, flattened,
    written as CSV of the fixed columns and the scores found, and read again."""
    root, out = scratch_folder(spark, "summaries"), scratch_folder(spark, "sweep-csv")
    summary_docs(spark, sf_dir).repartition("run").write.partitionBy("run").text(root)
    read = summary_scan(spark, f"{root}/run=*/*.txt", SUMMARY_SCHEMA)
    flat = flatten_summary(read.withColumn("run", F.regexp_replace("run", "^run=", "")), ["exact_match_vs_target"])
    csv_sink_dynamic(flat, out, SWEEP_CSV_COLUMNS)
    kinds = dict(flat.dtypes)
    schema = ", ".join(f"`{c}` {kinds.get(c, 'string')}" for c in dynamic_columns(flat, SWEEP_CSV_COLUMNS))
    return csv_scan(spark, out, schema)


APPENDED_SQL = """
SELECT CAST(o_orderkey AS VARCHAR) AS run, CAST(o_totalprice AS DOUBLE) AS price, o_orderpriority AS priority, [o_custkey, o_orderkey % 3] AS parts FROM orders
"""


@register("appended_runs", f"SELECT run, price, priority, '[' || array_to_string(parts, ',') || ']' AS parts FROM ({APPENDED_SQL})")
def q_appended_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs, appended as CSV in three jobs of which one is run
    again whole, one sends runs again that another has sent, and all are put
    together in between; each run is there once."""
    root = scratch_folder(spark, "runs")
    o = table(spark, sf_dir, "orders")
    runs = o.select(
        F.col("o_orderkey").cast("string").alias("run"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"), F.array(F.col("o_custkey"), F.col("o_orderkey") % 3).alias("parts"), (F.col("o_orderkey") % 3).alias("job")
    )
    sent = lambda *jobs: runs.filter(F.col("job").isin(*jobs)).drop("job")
    append_runs(spark, sent(0), root, "job-0")
    append_runs(spark, sent(1), root, "job-1")
    append_runs(spark, sent(1), root, "job-1")
    compact_runs(spark, root)
    append_runs(spark, sent(0, 2), root, "job-2")
    append_runs(spark, sent(0), root, "job-0")
    return read_runs(spark, root)


#: The head of the table, as asked for by the split's slice.
SLICE = 500


@register("file_dataset_slice", f"SELECT doc_id, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT {SLICE}")
def q_file_dataset_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S09 + L01: a registered dataset by name and split slice, the first rows by id."""
    places = {"documents": f"{sf_dir.rstrip('/')}/{{split}}.parquet"}
    return dataset_scan(spark, places, "documents", f"documents[:{SLICE}]", "doc_id").select("doc_id", "lang", "source", "n_chars")


@register("file_prompts", f"""
WITH rec AS ({FIRST_EXCHANGE_SQL}),
p AS (SELECT id, prompt_text, response_text, 'conv-' || id AS source, row_number() OVER (ORDER BY 'conv-' || id) - 1 AS pos FROM rec)
SELECT CASE WHEN length(prompt_text) % 2 = 0 THEN CAST(pos AS VARCHAR) ELSE id END AS id, prompt_text, response_text, source FROM p WHERE pos < {SLICE}""")
def q_file_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S13 + L03: evaluation prompts from JSON Lines, some without an id (the
    position stands in), limited to the first by source."""
    path = scratch_folder(spark, "prompts")
    recs = chat_records(spark, sf_dir).select("id", "prompt_text", "response_text", F.concat(F.lit("conv-"), F.col("id")).alias("source"))
    jsonl_sink(recs.withColumn("id", F.when(F.length("prompt_text") % 2 != 0, F.col("id"))), path)
    return prompt_source(spark, jsonl=path, order_col="source", limit=SLICE)


@register("file_splits", PREPARE_SPLITS_BODY + """
SELECT split, count(*) AS n_rows, CAST(sum(length(prompt_text)) AS BIGINT) AS n_chars, count(*) AS in_manifest FROM lab WHERE split IS NOT NULL GROUP BY split""")
def q_file_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S15 + S05: the splits as one folder each, with a manifest of their rows, read again."""
    path, notes = scratch_folder(spark, "splits"), scratch_folder(spark, "manifest")
    split_sink(documents_splits(spark, sf_dir).select("id", "prompt_text", "response_text", "split"), path)
    read = spark.read.schema("id string, prompt_text string, response_text string, split string").json(path)
    counts = read.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.length("prompt_text")).alias("n_chars"))
    manifest_sink(split_manifest(spark, counts.select("split", "n_rows"), data_id="documents", seed=7), notes)
    noted = spark.read.schema("data_id string, seed int, n_records map<string,bigint>").json(notes).select(F.explode("n_records").alias("split", "in_manifest"))
    return counts.join(noted, "split").select("split", "n_rows", "n_chars", "in_manifest")


@register("file_inventory", """
SELECT 'nation=' || c_nationkey AS run, count(DISTINCT c_mktsegment) AS n_files, CAST(sum(length(c_name) + 1) AS BIGINT) AS n_bytes FROM customer GROUP BY c_nationkey""")
def q_file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files below run directories, listed by the tasks. Stand-in: a nation
    is a run, its segments are folders of one text file."""
    root = scratch_folder(spark, "inventory")
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("value"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    c.repartition("nation", "segment").write.partitionBy("nation", "segment").text(root)
    found = inventory_scan(spark, root).filter(F.col("file").endswith(".txt"))
    return found.groupBy("run").agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes"))


@register("stream_records", f"""
WITH raw AS ({ALPACA_RAW_SQL}),
r AS ({_alpaca_norm_sql('(SELECT *, 0 AS idx FROM raw)', 'idx')})
SELECT CAST(doc_id AS VARCHAR) AS id, prompt_text, response_text, 'alpaca' AS source, lang AS category
FROM r WHERE prompt_text <> '' AND response_text <> ''""")
def q_stream_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1: documents come as JSON Lines in two lots; a stream normalizes what is
    new each time it is started, and the records are read at the end."""
    src, out, marks = (scratch_folder(spark, f"stream-{x}") for x in ("in", "out", "marks"))
    rows = alpaca_rows(table(spark, sf_dir, "documents")).withColumn("id", F.col("id").cast("string"))
    for lot in (0, 1):
        rows.filter(F.pmod(F.xxhash64("id"), F.lit(2)) == lot).write.mode("append").json(src)
        start_ingest(ingest_stream(spark, src, rows.schema, family="alpaca", dataset_name="documents", split="train"), out, marks).awaitTermination()
    read = spark.read.schema("id string, prompt_text string, response_text string, source string, metadata struct<category: string>").json(out)
    return read.select("id", "prompt_text", "response_text", "source", F.col("metadata.category").alias("category"))


STREAM_ROWS_SQL = """
WITH v AS (SELECT CAST(o_custkey AS VARCHAR) AS run, CAST(epoch(o_orderdate) AS DOUBLE) AS finished_at, o_totalprice AS speedup, o_orderkey FROM orders WHERE o_custkey IS NOT NULL)
SELECT run, max(finished_at) AS finished_at, arg_max(speedup, (finished_at, speedup)) AS speedup, CAST(NULL AS DOUBLE) AS acceptance_rate, arg_max(speedup, (finished_at, speedup)) / 2 AS "quality_score.em" FROM v GROUP BY run
"""


@register("stream_sweep_rows", STREAM_ROWS_SQL)
def q_stream_sweep_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST2: one row per run, the newest, from summaries that come in three lots
    in no order. Stand-in: a customer is a run, an order a summary of it that was
    finished at the order's date (the larger price of one date counts)."""
    src, out, marks = (scratch_folder(spark, f"sweep-{x}") for x in ("in", "out", "marks"))
    o = table(spark, sf_dir, "orders")
    lines = o.select(
        F.col("o_custkey").cast("string").alias("run"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("double").alias("finished_at"), F.col("o_totalprice").alias("speedup"),
        F.lit(float("nan")).alias("acceptance_rate"), F.create_map(F.lit("em"), F.col("o_totalprice") / 2).alias("quality_score"), (F.pmod(F.xxhash64("o_orderkey"), F.lit(3))).alias("lot"),
    )
    for lot in range(3):
        lines.filter(F.col("lot") == lot).drop("lot").write.mode("append").json(src)
        start_sweep_rows(run_line_stream(spark, src, ["em"]), out, marks, newest=("finished_at", "speedup")).awaitTermination()
    return read_sweep_rows(spark, out).select("run", "finished_at", "speedup", "acceptance_rate", "`quality_score.em`")
