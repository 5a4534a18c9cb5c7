"""Run-summary documents: validation, flattening, dynamic score columns
(P18, P22-P25, A30, A31, SO2, SO3, J14, S07 column order).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdraft.functions.documents import FIELDS, document, fields, is_object, number
from sparkdraft.operators.sweeps import finite_or_null

# The required top-level keys of a run summary.
REQUIRED_SUMMARY_KEYS = [
    "model", "target", "draft", "acceptance_rate", "avg_accepted_tokens", "vanilla_time_s", "sd_time_s",
    "speedup", "tokens_per_second", "quality_score", "decoding", "n_prompts", "n_warmup", "n_repeats",
]
DICT_KEYS = ["quality_score", "decoding"]
# Top-level numbers reported as eval metrics.
METRIC_KEYS = [
    "acceptance_rate", "avg_accepted_tokens", "speedup", "tokens_per_second", "sd_time_s", "vanilla_time_s",
    "n_prompts", "n_warmup", "n_repeats",
]
# The fixed columns of the sweep CSV.
SWEEP_CSV_COLUMNS = [
    "run", "checkpoint_run", "checkpoint_dir_name", "status", "returncode", "elapsed_s", "target_model",
    "draft_init", "loss_kind", "loss_alpha", "loss_temperature", "data_id", "response_source", "seed",
    "train_loss_final", "steps", "eval_backend", "runtime_mode", "runtime_temperature", "runtime_top_p", "gamma",
    "max_new_tokens", "run_vanilla_baseline", "speedup", "acceptance_rate", "avg_accepted_tokens",
    "tokens_per_second", "sd_time_s", "vanilla_time_s", "n_prompts", "n_warmup", "n_repeats", "vllm_num_drafts",
    "vllm_num_draft_tokens", "vllm_num_accepted_tokens", "vllm_request_batch_size", "checkpoint_dir", "model_dir",
    "config_path", "prompts_jsonl", "summary_path",
]

# Of a join's keys, how many at most are broadcast for being frequent.
FREQUENT = 500

# Names and types of a summary document's fields.
ENGINE_FIELDS = T.StructType(
    [
        T.StructField("sd_time_s", T.DoubleType()),
        T.StructField("vanilla_time_s", T.DoubleType()),
        T.StructField("tokens_per_second", T.DoubleType()),
        T.StructField("vanilla_tokens_per_second", T.DoubleType()),
        T.StructField("speedup", T.DoubleType()),
        T.StructField("acceptance_rate", T.DoubleType()),
        T.StructField("avg_accepted_tokens", T.DoubleType()),
        T.StructField("n_outer_steps", T.LongType()),
        T.StructField("target_calls", T.LongType()),
        T.StructField("draft_calls", T.LongType()),
        T.StructField("draft_forward_s", T.DoubleType()),
        T.StructField("target_forward_s", T.DoubleType()),
        T.StructField("num_drafts", T.LongType()),
        T.StructField("num_draft_tokens", T.LongType()),
        T.StructField("num_accepted_tokens", T.LongType()),
        T.StructField("accepted_tokens_per_pos", T.ArrayType(T.DoubleType())),
        T.StructField("batched", T.BooleanType()),
        T.StructField("request_batch_size", T.LongType()),
        T.StructField("note", T.StringType()),
    ]
)
SUMMARY_SCHEMA = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("draft", T.StringType()),
        T.StructField("acceptance_rate", T.DoubleType()),
        T.StructField("avg_accepted_tokens", T.DoubleType()),
        T.StructField("vanilla_time_s", T.DoubleType()),
        T.StructField("sd_time_s", T.DoubleType()),
        T.StructField("speedup", T.DoubleType()),
        T.StructField("tokens_per_second", T.DoubleType()),
        T.StructField("quality_score", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField(
            "decoding",
            T.StructType(
                [
                    T.StructField("mode", T.StringType()),
                    T.StructField("max_new_tokens", T.IntegerType()),
                    T.StructField("num_assistant_tokens", T.IntegerType()),
                    T.StructField("temperature", T.DoubleType()),
                    T.StructField("top_p", T.DoubleType()),
                ]
            ),
        ),
        T.StructField("n_prompts", T.IntegerType()),
        T.StructField("n_warmup", T.IntegerType()),
        T.StructField("n_repeats", T.IntegerType()),
        T.StructField(
            "engines",
            T.StructType([T.StructField("hf", ENGINE_FIELDS), T.StructField("vllm", ENGINE_FIELDS)]),
        ),
    ]
)


def validate_summaries(raw: DataFrame, text_col: str = "value", key_col: str = "run") -> DataFrame:
    """P25: one row per problem of a document: it is not one JSON object, lacks
    a required key, or holds something else than an object in ``quality_score``,
    ``decoding``, ``engines`` or an entry of ``engines``."""
    doc = raw.select(key_col, document(text_col).alias("doc"))
    parsed = doc.select(key_col, fields(F.col("doc")).alias("top"), fields(F.col("doc"), "$.engines").alias("engines"))
    none = F.array().cast("array<string>")
    missing = F.array_except(F.array(*[F.lit(k) for k in REQUIRED_SUMMARY_KEYS]), F.map_keys("top"))
    flat = F.map_keys(F.map_filter("top", lambda k, v: k.isin(*DICT_KEYS, "engines") & ~is_object(v)))
    flat_engines = F.map_keys(F.map_filter("engines", lambda k, v: ~is_object(v)))
    problems = F.concat(
        F.transform(missing, lambda k: F.concat(F.lit("missing required key: "), k)),
        F.transform(flat, lambda k: F.concat(k, F.lit(" is not an object"))),
        F.coalesce(F.transform(flat_engines, lambda k: F.concat(F.lit("engine "), k, F.lit(" is not an object"))), none),
    )
    found = F.when(F.col("top").isNotNull(), problems).otherwise(F.array(F.lit("not a JSON object")))
    return parsed.select(key_col, F.explode(found).alias("problem"))


def assert_valid(raw: DataFrame, text_col: str = "value", key_col: str = "run") -> DataFrame:
    """P25 strict mode: the documents as they are; the query fails on the
    first invalid one, also if only a count is asked for."""
    v = validate_summaries(raw, text_col, key_col).groupBy(key_col).agg(F.min("problem").alias("_p"))
    fails = F.raise_error(F.concat(F.lit("invalid eval summary: "), F.col("_p"))).cast("boolean")
    # A filter stays in the plan whatever columns are selected.
    return raw.join(v, key_col, "left").filter(F.when(F.col("_p").isNull(), F.lit(True)).otherwise(fails)).drop("_p")


def quality_scores_long(summaries: DataFrame, key_col: str = "run", map_col: str = "quality_score") -> DataFrame:
    """A31 in long form: (run, name, value), for any number of names."""
    return summaries.select(key_col, F.explode(map_col).alias("name", "value"))


def score_names(summaries: DataFrame, map_col: str = "quality_score") -> DataFrame:
    """A31 + SO2: the sorted union of score names, as rows (name)."""
    return summaries.select(F.explode(F.map_keys(map_col)).alias("name")).distinct().orderBy("name")


def flatten_summary(summaries: DataFrame, score_cols: Sequence[str], keep: Sequence[str] = ("run",)) -> DataFrame:
    """P22 + P23 + A31: one flat sweep row per summary: finite metrics (else
    null), counts, the vLLM engine counters and one ``quality_score.<name>``
    column per known score name; ``keep`` columns pass through."""
    vllm = "engines.vllm."
    return summaries.select(
        *keep,
        *[finite_or_null(k).alias(k) for k in ("speedup", "acceptance_rate", "avg_accepted_tokens", "tokens_per_second", "sd_time_s", "vanilla_time_s")],
        "n_prompts",
        "n_warmup",
        "n_repeats",
        F.col(vllm + "num_drafts").alias("vllm_num_drafts"),
        F.col(vllm + "num_draft_tokens").alias("vllm_num_draft_tokens"),
        F.col(vllm + "num_accepted_tokens").alias("vllm_num_accepted_tokens"),
        F.col(vllm + "request_batch_size").alias("vllm_request_batch_size"),
        *[F.try_element_at("quality_score", F.lit(n)).alias(f"quality_score.{n}") for n in score_cols],
    )


def flatten_metrics_long(raw: DataFrame, key_col: str = "run", text_col: str = "value") -> DataFrame:
    """(run, metric, value) for every number of a summary document:
    top-level ``eval/<key>``, ``eval/<engine>/<key>`` for whatever engines and
    counters it names, ``eval/quality/<name>``. Booleans, texts (quoted numbers
    too), lists, objects and nulls are not numbers and do not enter; NaN is one.
    An engine named ``quality`` shares that prefix; both numbers are rows."""
    parsed = raw.select(key_col, document(text_col).alias("doc"))
    kind = f"array<struct<prefix: string, fields: {FIELDS}>>"
    part = lambda prefix, found: F.struct(prefix.alias("prefix"), found.alias("fields"))
    metrics = F.map_filter(fields(F.col("doc")), lambda k, v: k.isin(*METRIC_KEYS))
    engines = F.transform(F.map_entries(fields(F.col("doc"), "$.engines")), lambda e: part(F.concat(F.lit("eval/"), e["key"], F.lit("/")), fields(e["value"])))
    parts = F.concat(
        F.array(part(F.lit("eval/"), metrics), part(F.lit("eval/quality/"), fields(F.col("doc"), "$.quality_score"))),
        F.coalesce(engines, F.array().cast(kind)),
    )
    named = parsed.select(key_col, F.explode(parts).alias("p")).select(key_col, "p.prefix", F.explode("p.fields").alias("name", "held"))
    return named.select(key_col, F.concat("prefix", "name").alias("metric"), number(F.col("held")).alias("value")).filter(F.col("value").isNotNull())


def missing_items(required: Column, present: Column) -> Column:
    """SO3: required minus present (array difference)."""
    return F.array_except(required, present)


def experiment_key(cols: Sequence[str], kind: str | Column, source: str | Column, n_samples: str | Column,
                   seed: str | Column) -> Column:
    """Readable run name ``<kind>_<source>_<n>_seed<seed>_<hash8>``.

    The hash is sha256 of a canonical JSON of the identity columns (names
    sorted); ``_generated`` in the source is shortened to ``gen``.
    """
    ident = F.to_json(F.struct(*[F.col(c) for c in sorted(cols)]))
    h = F.substring(F.sha2(ident, 256), 1, 8)

    def c(x):
        return F.col(x) if isinstance(x, str) else x

    src = F.regexp_replace(c(source).cast("string"), "_generated", "gen")
    return F.concat_ws("_", c(kind).cast("string"), src, c(n_samples).cast("string"),
                       F.concat(F.lit("seed"), c(seed).cast("string")), h)


def ancestor_paths(path: str | Column) -> Column:
    """A path and the folders above it, the nearest first, as candidates for ``first_hit_lookup``."""
    parts = F.split(F.col(path) if isinstance(path, str) else path, "/")
    every = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.filter(every, lambda p: p != "")


def first_hit_lookup(df: DataFrame, meta: DataFrame, candidates: Sequence[str] | Column, meta_key: str = "path", newest: str | None = None) -> DataFrame:
    """Metadata by candidate paths, first hit wins.

    ``candidates`` are path columns in order, or one array of paths of any
    length (``ancestor_paths``). The distinct lists are exploded with their
    rank and meet the metadata in an equi-join on the path; the hit of lowest
    rank is kept per list, and joined back. Frequent paths (a root folder is in
    every list) and frequent lists meet theirs by broadcast, so that no task of
    a join gets all rows of one. ``meta`` has (path, meta columns...);
    of several rows with one path the one with the largest ``newest`` counts,
    or else the one that is least in column order, so no row is multiplied.
    Null candidates and a null path match nothing. Adds ``meta_path`` (null
    without a hit) and the meta columns, which replace columns of their name.
    """
    value_cols = [c for c in meta.columns if c != meta_key]
    values = F.struct(*[F.col(f"`{c}`") for c in value_cols])
    chosen = F.max_by(values, F.struct(F.col(newest), values)) if newest else F.min(values)
    known = meta.filter(F.col(meta_key).isNotNull()).groupBy(F.col(meta_key).alias("_path")).agg(chosen.alias("_values"))
    listed = candidates if isinstance(candidates, Column) else F.array(*[F.col(c) for c in candidates])
    asked = df.withColumn("_asked", F.coalesce(listed, F.array().cast("array<string>")))
    ranked = asked.select("_asked").distinct().select("_asked", F.posexplode("_asked").alias("_rank", "_path")).filter("_path is not null")
    hits = _spread_join(ranked, known, "_path", "inner").groupBy("_asked").agg(F.min_by(F.struct("_path", "_values"), "_rank").alias("_hit"))
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("meta_path", *value_cols)]
    return _spread_join(asked, hits, "_asked", "left").select(*kept, F.col("_hit._path").alias("meta_path"), *[F.col("_hit._values").getField(c).alias(c) for c in value_cols])


def _spread_join(left: DataFrame, right: DataFrame, key: str, how: str) -> DataFrame:
    """Equi-join with ``right``, which has a key once: keys that are frequent in ``left`` (at most
    ``FREQUENT``, found by a sketch that tasks fill) are broadcast, all others are shuffled."""
    tag = F.xxhash64(key)
    frequent = left.agg(F.expr(f"approx_top_k(xxhash64({key}), {FREQUENT}, {8 * FREQUENT})").alias("_top")).select(F.explode("_top.item").alias("_tag"))
    marked = lambda df: df.withColumn("_tag", tag).join(F.broadcast(frequent.withColumn("_often", F.lit(True))), "_tag", "left").drop("_tag")
    left, right = marked(left), marked(right)
    often = left.filter("_often").drop("_often").join(F.broadcast(right.filter("_often").drop("_often")), key, how)
    return often.unionByName(left.filter("_often is null").drop("_often").join(right.filter("_often is null").drop("_often"), key, how))
