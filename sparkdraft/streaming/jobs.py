"""Structured Streaming twins of the two incrementally growing outputs.

ST1: raw JSONL files arriving in a folder -> canonical records (stateless,
the same P08 select as batch). ST2: finished run summaries -> flattened
sweep rows, at most one row per run.

Both use file sources (which track processed files in the checkpoint) and
are written for ``trigger(availableNow=True)`` runs; the checkpoint
location must be on shared storage so a restarted driver resumes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sparkdraft.operators.prep import normalize_rows
from sparkdraft.operators.summaries import SUMMARY_SCHEMA, flatten_summary
from sparkdraft.sources.committed import read_newest, upsert_newest
from sparkdraft.sources.files import RUN_FROM_PATH


def ingest_stream(spark: SparkSession, src_dir: str, schema: T.StructType | str, *, family: str,
                  dataset_name: str, split: str) -> DataFrame:
    """ST1 source + transform. A stream has no global row position, so
    the positional index of the batch job is replaced by a content key
    (xxhash64 of file path and row), stable across restarts."""
    raw = spark.readStream.schema(schema).option("mode", "FAILFAST").json(src_dir)
    keyed = raw.withColumn(
        "source_index", F.xxhash64(F.col("_metadata.file_path"), F.to_json(F.struct(*[F.col(c) for c in raw.columns])))
    )
    return normalize_rows(keyed, family=family, dataset_name=dataset_name, split=split)


def start_ingest(stream: DataFrame, out_dir: str, checkpoint: str) -> StreamingQuery:
    """ST1 sink: append JSON records, process what is there, then stop."""
    return (
        stream.writeStream.format("json")
        .option("path", out_dir)
        .option("checkpointLocation", checkpoint)
        .option("ignoreNullFields", "false")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def summary_stream(spark: SparkSession, pattern_dir: str, score_names: list[str]) -> DataFrame:
    """ST2 source + flatten: ``<root>/<run>/eval_summary.json`` documents."""
    raw = (
        spark.readStream.schema(SUMMARY_SCHEMA)
        .option("multiLine", True)
        .option("allowNonNumericNumbers", True)
        .option("pathGlobFilter", "eval_summary.json")
        .option("recursiveFileLookup", True)
        .json(pattern_dir)
    )
    raw = raw.withColumn("summary_path", F.col("_metadata.file_path")).withColumn(
        "run", F.regexp_extract("summary_path", RUN_FROM_PATH, 1)
    ).withColumn("file_mtime", F.col("_metadata.file_modification_time"))
    return flatten_summary(raw, score_names, keep=("run", "summary_path", "file_mtime"))


#: Columns of a line of ``run_line_stream`` besides the summary's own.
RUN_LINE = T.StructType([T.StructField("run", T.StringType()), T.StructField("finished_at", T.DoubleType()), *SUMMARY_SCHEMA.fields])


def run_line_stream(spark: SparkSession, src_dir: str, score_names: list[str]) -> DataFrame:
    """ST2 source for many runs a file: JSON Lines of summaries with ``run`` and
    ``finished_at``, flattened."""
    raw = spark.readStream.schema(RUN_LINE).option("allowNonNumericNumbers", True).json(src_dir)
    return flatten_summary(raw, score_names, keep=("run", "finished_at"))


def start_sweep_rows(stream: DataFrame, table_dir: str, checkpoint: str, newest: tuple[str, ...] = ("file_mtime", "summary_path")) -> StreamingQuery:
    """ST2 sink: at most one row per run, the newest by ``newest``, whatever order
    files come in. Each micro-batch rewrites the buckets of the table that it
    touches and commits (``upsert_newest``); a replayed batch of this query
    changes nothing, nor does a file that comes late but is older."""

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        source = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "stream"
        upsert_newest(spark, batch, table_dir, source, batch_id, key="run", newest=newest)

    return (
        stream.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_sweep_rows(spark: SparkSession, table_dir: str) -> DataFrame:
    """ST2 table view: one row per run as of the last commit."""
    return read_newest(spark, table_dir)
