"""File sources and sinks.

Canonical tables are best kept as Parquet (pushdown, pruning); JSONL, CSV
and free text appear only at the edges, so these readers always take an
explicit schema (no inference pass over the data).
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdraft.functions.text import clean
from sparkdraft.operators.prep import SPLIT_NAMES

# The built-in smoke prompts used when no source is set.
BUILTIN_PROMPTS = [
    "Explain the theory of relativity in simple terms.",
    "Write a Python function to compute the Fibonacci sequence.",
    "What are the main differences between TCP and UDP?",
    "Summarise the plot of Romeo and Juliet in one paragraph.",
]

RUN_FROM_PATH = r"([^/]+)/[^/]+$"


def jsonl_scan(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON Lines with a fixed schema. Blank and whitespace-only
    lines are skipped; a malformed line fails the job (FAILFAST)."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def jsonl_sink(df: DataFrame, path: str) -> None:
    """Overwrite as JSON Lines, keeping null fields and non-ASCII text."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def summary_scan(spark: SparkSession, pattern: str, schema: T.StructType | str) -> DataFrame:
    """One multi-line JSON document per run directory; the run name is
    the parent directory of the file. Bare ``NaN`` literals are accepted."""
    df = (
        spark.read.schema(schema)
        .option("multiLine", True)
        .option("allowNonNumericNumbers", True)
        .json(pattern)
    )
    return df.withColumn("summary_path", F.col("_metadata.file_path")).withColumn(
        "run", F.regexp_extract(F.col("summary_path"), RUN_FROM_PATH, 1)
    )


def manifest_sink(manifest: DataFrame, path: str) -> None:
    """Append one manifest row (ids, seed, row counts, config) to a
    manifest table."""
    manifest.coalesce(1).write.mode("append").option("ignoreNullFields", "false").json(path)


def split_manifest(spark: SparkSession, counts: DataFrame, **fields) -> DataFrame:
    """S05 body: one row with the given scalar fields and ``n_records``
    as a map split -> count built from the (3-row) split counts."""
    n = counts.agg(F.map_from_entries(F.collect_list(F.struct("split", "n_rows"))).alias("n_records"))
    return n.select(*[F.lit(v).alias(k) for k, v in fields.items()], "n_records")


def csv_scan(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header row and a fixed schema."""
    return spark.read.option("header", True).schema(schema).csv(path)


def dynamic_columns(df: DataFrame, fixed: Sequence[str], extra_prefix: str = "quality_score.") -> list[str]:
    """S07 column order: the fixed columns, then every ``quality_score.*``
    column present, sorted; anything else is dropped."""
    extras = sorted(c for c in df.columns if c.startswith(extra_prefix))
    return [*fixed, *extras]


def csv_ready(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs become JSON text so CSV can hold them."""
    return df.select(
        *[
            F.to_json(F.col(f"`{f.name}`")).alias(f.name)
            if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def csv_sink_dynamic(df: DataFrame, path: str, fixed: Sequence[str], mode: str = "overwrite") -> None:
    """Fixed + sorted extra columns (missing fixed ones blank),
    nested values as JSON text, header; ``mode="append"`` adds rows."""
    cols = dynamic_columns(df, fixed)
    out = df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in cols])
    csv_ready(out).write.mode(mode).option("header", True).csv(path)


def job_timestamp() -> str:
    """One UTC ISO-8601 stamp per job, taken on the driver and used as
    a literal, so every row (and every retry) gets the same value."""
    import datetime as _dt

    return _dt.datetime.now(_dt.timezone.utc).isoformat()


def parse_split_slice(split: str) -> tuple[str, int | None]:
    """``train[:32]`` -> ("train", 32); ``train`` -> ("train", None)."""
    if "[" in split and split.endswith("]"):
        name, rest = split[:-1].split("[", 1)
        if rest.startswith(":"):
            return name, int(rest[1:])
        raise ValueError(f"unsupported split slice {split!r}")
    return split, None


def dataset_scan(spark: SparkSession, registry: dict[str, str], name: str, split: str,
                 order_col: str, fmt: str = "parquet") -> DataFrame:
    """Resolve a dataset name to a path, read the split, and apply a
    ``[:n]`` slice: the first n rows under ``order_col``, nulls first."""
    split_name, n = parse_split_slice(split)
    path = registry[name].format(split=split_name)
    df = spark.read.format(fmt).load(path)
    return df if n is None else first_rows(df, order_col, n)


def first_rows(df: DataFrame, order_col: str, n: int) -> DataFrame:
    """The first ``n`` rows under ``order_col``, nulls first; of rows equal at
    the end of the slice those of the smallest hashes.

    Only the order column is sorted and checkpointed, to find the value at the
    end of the slice; the rows are then a filter on that value, which reaches the scan.
    """
    from sparkdraft.operators.ordering import with_global_index

    if n <= 0:
        return df.limit(0)
    key = F.col(f"`{order_col}`")
    placed = with_global_index(df.select(key.alias("k")), ["k"], "_sd_row")
    edge = placed.filter(F.col("_sd_row") == n - 1).first()
    if edge is None:
        return df
    last = F.lit(edge["k"]).cast(df.schema[order_col].dataType)
    before = F.lit(False) if edge["k"] is None else key.isNull() | (key < last)
    sooner = placed.filter((F.col("_sd_row") < n) & ~F.col("k").eqNullSafe(last)).count()
    tied = df.filter(key.eqNullSafe(last)).withColumn("_sd_hash", F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
    picked = with_global_index(tied, ["_sd_hash"], "_sd_row").filter(F.col("_sd_row") < n - sooner).drop("_sd_hash", "_sd_row")
    return df.filter(before).unionByName(picked)


EVAL_LOSS = r"'eval_loss': ([0-9.]+)"
FINAL_LINE = r"acceptance_rate=([0-9.]+) avg_accepted_tokens=([0-9.]+) speedup=([0-9.]+)x tokens/s=([0-9.]+)"


def eval_losses_from_text(df: DataFrame, key_cols: Sequence[str], text_col: str = "value") -> DataFrame:
    """S10 core: split each text on ``\\r``/``\\n`` (progress bars use
    ``\\r``), keep line order with ``posexplode``, and extract every
    ``'eval_loss': x`` per line. Output: keys, line_no, match_no, eval_loss."""
    keys = list(key_cols)
    lines = df.select(*keys, F.posexplode(F.split(text_col, r"[\r\n]+")).alias("line_no", "line"))
    hits = lines.select(
        *keys, "line_no", F.posexplode(F.regexp_extract_all("line", F.lit(EVAL_LOSS), 1)).alias("match_no", "v")
    )
    return hits.select(*keys, "line_no", "match_no", F.col("v").cast("double").alias("eval_loss"))


def _log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the log files (``\\r`` ends one, too) with their place: file,
    block of the file, row in the block, part of the row. Files are split
    like any text input, so a log may be of any length."""
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), F.posexplode(F.split("value", r"\r+")).alias("part", "line"),
    )
    return rows


def log_metric_scan(spark: SparkSession, path: str) -> DataFrame:
    """Every ``'eval_loss': x`` of each log file, in order. Output: file,
    line_no (of the lines with a loss), match_no, eval_loss."""
    from sparkdraft.operators.ordering import with_global_index

    lines = _log_lines(spark, path).filter(F.col("line").rlike(EVAL_LOSS))
    placed = with_global_index(lines, ["file", "block", "row", "part"], "_sd_n")
    first = placed.groupBy(F.col("file").alias("_sd_file")).agg(F.min("_sd_n").alias("_sd_first"))
    numbered = placed.join(first, F.col("file") == F.col("_sd_file")).withColumn("line_no", F.col("_sd_n") - F.col("_sd_first"))
    hits = numbered.select("file", "line_no", F.posexplode(F.regexp_extract_all("line", F.lit(EVAL_LOSS), 1)).alias("match_no", "v"))
    return hits.select("file", "line_no", "match_no", F.col("v").cast("double").alias("eval_loss"))


def final_metrics_scan(spark: SparkSession, path: str) -> DataFrame:
    """The last ``acceptance_rate=... speedup=...x tokens/s=...`` line
    of each log (max_by on its place, combined map-side)."""
    lines = _log_lines(spark, path).filter(F.col("line").rlike(FINAL_LINE))
    last = lines.groupBy("file").agg(F.max_by("line", F.struct("block", "row", "part")).alias("line"))
    return last.select(
        "file",
        *[F.regexp_extract("line", FINAL_LINE, i).cast("double").alias(n)
          for i, n in enumerate(["acceptance_rate", "avg_accepted_tokens", "speedup", "tokens_per_second"], start=1)],
    )


def inventory_scan(spark: SparkSession, root: str, runs: Sequence[str] | None = None) -> DataFrame:
    """One row per file under ``root`` (path, length, run directory, path
    relative to the run), listed by the tasks, run directory by run directory
    (``sources.inventory``); ``runs`` restricts the listing to some of them, and
    so does a filter on ``run`` if the session lets filters reach Python sources.
    File contents are never read."""
    from sparkdraft.sources.inventory import FilteredRunInventory, RunInventory

    filtered = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "true"
    source = FilteredRunInventory if filtered else RunInventory
    spark.dataSource.register(source)
    reader = spark.read.format(source.name()).option("root", root)
    if runs is not None:
        reader = reader.option("runs", json.dumps(list(runs)))
    return reader.load()


def inline_prompts(spark: SparkSession) -> DataFrame:
    """The built-in smoke prompts (id, prompt_text, response_text,
    source)."""
    rows = [(f"smoke-{i}", t, None, "builtin") for i, t in enumerate(BUILTIN_PROMPTS)]
    return spark.createDataFrame(rows, "id string, prompt_text string, response_text string, source string")


def prompt_source(
    spark: SparkSession,
    *,
    jsonl: str | None = None,
    dataset: DataFrame | None = None,
    dataset_name: str | None = None,
    prompt_field: str = "prompt",
    order_col: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """JSONL prompts, else a dataset's ``prompt_field``, else the
    built-in list; then an optional head limit (L01) by position.

    id falls back to the row position; the schema is the same for all
    three sources.
    """
    from sparkdraft.operators.ordering import with_global_index

    if jsonl:
        raw = jsonl_scan(spark, jsonl, "id string, prompt_text string, response_text string, source string")
        # Source order: the file, the block in it, the row in the block.
        raw = raw.select("*", F.col("_metadata.file_path").alias("_sd_file"), F.col("_metadata.file_block_start").alias("_sd_block")).withColumn(
            "_sd_row", F.monotonically_increasing_id()
        )
        ix = with_global_index(raw, [order_col] if order_col else ["_sd_file", "_sd_block", "_sd_row"], "_sd_pos")
        out = ix.select(
            F.coalesce("id", F.col("_sd_pos").cast("string")).alias("id"),
            "prompt_text",
            "response_text",
            "source",
            "_sd_pos",
        )
    elif dataset is not None:
        if order_col is None:
            if limit is not None and int(limit) > 0:
                raise ValueError("a limit over a dataset needs order_col: a table has no order of its own")
            order_col = prompt_field
        ix = with_global_index(dataset, [order_col], "_sd_pos")
        rid = F.col("id").cast("string") if "id" in dataset.columns else F.lit(None).cast("string")
        out = ix.select(
            F.coalesce(rid, F.col("_sd_pos").cast("string")).alias("id"),
            F.col(prompt_field).cast("string").alias("prompt_text"),
            F.lit(None).cast("string").alias("response_text"),
            F.lit(dataset_name).alias("source"),
            "_sd_pos",
        )
    else:
        out = inline_prompts(spark).withColumn("_sd_pos", F.regexp_extract("id", r"(\d+)$", 1).cast("long"))
    if limit is not None and int(limit) > 0:
        out = out.filter(F.col("_sd_pos") < int(limit))
    return out.drop("_sd_pos")


def nonblank_line_count(spark: SparkSession, path: str) -> int:
    """Number of non-blank lines (a count action)."""
    return spark.read.text(path).filter(clean("value") != "").count()


def split_sink(df: DataFrame, path: str, split_col: str = "split") -> None:
    """One directory per split (train/val/eval)."""
    df.filter(F.col(split_col).isin(*SPLIT_NAMES)).write.mode("overwrite").partitionBy(split_col).json(path)
