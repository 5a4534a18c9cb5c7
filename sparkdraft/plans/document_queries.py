"""Queries over JSON documents of many shapes (P24, P25, X10) and over
metadata found at any folder above a run (J14).

Stand-in: every order is a run whose summary document is text, composed by
the order's key: whole and right, with a quoted number, without required
keys, a list, cut off, with texts and numbers in place of objects, followed by
more text, empty or missing. Numbers come from the order's price and customer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdraft.functions.documents import document, nested_get
from sparkdraft.operators.summaries import ancestor_paths, first_hit_lookup, flatten_metrics_long, validate_summaries
from sparkdraft.plans.registry import register, table

KINDS = 12
(WHOLE, QUOTED, LACKING, LISTED, CUT, FLAT_QUALITY, FLAT_ENGINES, FLAT_BLOCKS, FOLLOWED, EMPTY, NOTHING, NESTED) = range(KINDS)

_FIELDS = {
    "model": '"m"', "target": '"t"', "draft": '"d"', "acceptance_rate": "0.5", "avg_accepted_tokens": "2",
    "vanilla_time_s": "NaN", "sd_time_s": "{price}", "speedup": "{price}", "tokens_per_second": "{customer}",
    "quality_score": '{{"em": 0.25, "note": "7", "flag": true}}',
    "decoding": '{{"mode": "greedy", "temperature": 0.5, "top_p": "0.9"}}', "n_prompts": "1", "n_warmup": "{customer}", "n_repeats": "3",
    "engines": '{{"vllm": {{"speedup": {price}, "note": {{"speedup": "x"}}, "batched": true, "per_pos": [1, 2]}}, "tgi": {{"new_counter": {customer}, "gone": null}}}}',
}
_CHANGES = {
    QUOTED: {"speedup": '"1.5"', "decoding": '{{"temperature": "0.5", "mode": 3}}'},
    LACKING: {"n_warmup": None, "n_repeats": None, "engines": None, "decoding": "{{}}"},
    FLAT_QUALITY: {"quality_score": "{price}"},
    FLAT_ENGINES: {"engines": '{{"vllm": 3, "hf": null, "tgi": {{"speedup": {price}}}}}'},
    FLAT_BLOCKS: {"decoding": '"greedy"', "engines": "[1]"},
    NESTED: {"quality_score": '{{"speedup": {price}, "deep": {{"speedup": "9", "em": 4}}, "em": "4"}}'},
}


def _composed(kind: int) -> Column:
    held = {k: v for k, v in (_FIELDS | _CHANGES.get(kind, {})).items() if v is not None}
    text = "{{" + ", ".join(f'"{k}": {v}' for k, v in held.items()) + "}}"
    parts = text.replace("{price}", "\0price\0").replace("{customer}", "\0customer\0").replace("{{", "{").replace("}}", "}").split("\0")
    return F.concat(*[F.col(p) if p in ("price", "customer") else F.lit(p) for p in parts])


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, value): the summary document of every order."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("run"), (F.col("o_orderkey") % KINDS).alias("kind"), F.col("o_totalprice").cast("string").alias("price"), F.col("o_custkey").cast("string").alias("customer")
    )
    whole = _composed(WHOLE)
    value = F.when(F.col("kind") == LISTED, "[1, 2]").when(F.col("kind") == CUT, F.substring(whole, 1, 200)).when(F.col("kind") == FOLLOWED, F.concat(whole, F.lit(" {}"))).when(F.col("kind") == EMPTY, "")
    value = value.when(F.col("kind") == NOTHING, F.lit(None).cast("string"))
    for kind in _CHANGES:
        value = value.when(F.col("kind") == kind, _composed(kind))
    return o.select("run", value.otherwise(whole).alias("value"))


def _rows(*pairs: tuple[int, str]) -> str:
    return ", ".join(f"({k}, '{v}')" for k, v in pairs)


DOCUMENT_PROBLEMS_SQL = f"""
SELECT CAST(o_orderkey AS VARCHAR) AS run, problem FROM orders JOIN (VALUES {_rows(
    *[(k, "not a JSON object") for k in (LISTED, CUT, FOLLOWED, EMPTY, NOTHING)],
    (LACKING, "missing required key: n_warmup"), (LACKING, "missing required key: n_repeats"),
    (FLAT_QUALITY, "quality_score is not an object"), (FLAT_ENGINES, "engine vllm is not an object"), (FLAT_ENGINES, "engine hf is not an object"),
    (FLAT_BLOCKS, "decoding is not an object"), (FLAT_BLOCKS, "engines is not an object"))}) AS p(kind, problem)
ON o_orderkey % {KINDS} = p.kind
"""


@register("document_problems", DOCUMENT_PROBLEMS_SQL)
def q_document_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P25 + SO3 on documents of every shape: what is wrong with each."""
    return validate_summaries(order_documents(spark, sf_dir))


_READ = "kind NOT IN (%s)" % ", ".join(map(str, (LISTED, CUT, FOLLOWED, EMPTY, NOTHING)))
_METRICS = [
    ("acceptance_rate", "0.5", "true"), ("avg_accepted_tokens", "2", "true"), ("vanilla_time_s", "'NaN'::DOUBLE", "true"), ("sd_time_s", "price", "true"),
    ("speedup", "price", f"kind <> {QUOTED}"), ("tokens_per_second", "customer", "true"), ("n_prompts", "1", "true"),
    ("n_warmup", "customer", f"kind <> {LACKING}"), ("n_repeats", "3", f"kind <> {LACKING}"),
    ("quality/em", "0.25", f"kind NOT IN ({FLAT_QUALITY}, {NESTED})"), ("quality/speedup", "price", f"kind = {NESTED}"),
    ("vllm/speedup", "price", f"kind NOT IN ({LACKING}, {FLAT_ENGINES}, {FLAT_BLOCKS})"), ("tgi/speedup", "price", f"kind = {FLAT_ENGINES}"),
    ("tgi/new_counter", "customer", f"kind NOT IN ({LACKING}, {FLAT_ENGINES}, {FLAT_BLOCKS})"),
]
DOCUMENT_METRICS_SQL = f"""
WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS run, o_orderkey % {KINDS} AS kind, o_totalprice AS price, o_custkey AS customer FROM orders)
""" + " UNION ALL ".join(f"SELECT run, 'eval/{name}' AS metric, CAST({value} AS DOUBLE) AS value FROM o WHERE {_READ} AND {held}" for name, value, held in _METRICS)


@register("document_metrics", DOCUMENT_METRICS_SQL)
def q_document_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P24 on documents of every shape: numbers by the type they are written
    with; quoted ones, those of nested objects, booleans and lists stay out."""
    return flatten_metrics_long(order_documents(spark, sf_dir))


DOCUMENT_FIELDS_SQL = f"""
WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS run, o_orderkey % {KINDS} AS kind, o_custkey AS customer FROM orders)
SELECT run,
       CASE WHEN {_READ} AND kind NOT IN ({QUOTED}, {LACKING}, {FLAT_BLOCKS}) THEN 'greedy' ELSE 'sampling' END AS mode,
       CAST(CASE WHEN {_READ} AND kind NOT IN ({QUOTED}, {LACKING}, {FLAT_BLOCKS}) THEN 0.5 ELSE 1.0 END AS DOUBLE) AS temperature,
       CAST(1.0 AS DOUBLE) AS top_p,
       CAST(CASE WHEN {_READ} AND kind NOT IN ({LACKING}) THEN customer ELSE -1 END AS BIGINT) AS n_warmup,
       {_READ} AND kind NOT IN ({LACKING}, {FLAT_ENGINES}, {FLAT_BLOCKS}) AS batched
FROM o
"""


@register("document_fields", DOCUMENT_FIELDS_SQL)
def q_document_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested fields with a default where they are missing, of another
    type, or the document can't be read."""
    doc = F.col("doc")
    return order_documents(spark, sf_dir).select("run", document("value").alias("doc")).select(
        "run",
        nested_get(doc, "$.decoding.mode", "string", "sampling").alias("mode"),
        nested_get(doc, "$.decoding.temperature", "double", 1.0).alias("temperature"),
        nested_get(doc, "$.decoding.top_p", "double", 1.0).alias("top_p"),
        nested_get(doc, "$.n_warmup", "bigint", -1).alias("n_warmup"),
        nested_get(doc, "$.engines.vllm.batched", "boolean", False).alias("batched"),
    )


ANCESTOR_SQL = """
WITH meta AS (SELECT path, min(dataset) AS dataset FROM (
  SELECT '/ckpt/' || s_nationkey AS path, s_name AS dataset FROM supplier WHERE s_nationkey % 3 <> 0
  UNION ALL SELECT '/ckpt/' || c_nationkey || '/' || c_custkey, c_name FROM customer WHERE c_acctbal > 5000) GROUP BY path),
run AS (SELECT o_orderkey, '/ckpt/' || c_nationkey || '/' || c_custkey || '/' || o_orderkey AS dir, '/ckpt/' || c_nationkey || '/' || c_custkey AS p1, '/ckpt/' || c_nationkey AS p2
        FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT dir, coalesce(m1.path, m2.path) AS meta_path, CASE WHEN m1.path IS NOT NULL THEN m1.dataset ELSE m2.dataset END AS dataset
FROM run LEFT JOIN meta m1 ON m1.path = p1 LEFT JOIN meta m2 ON m2.path = p2
"""


@register("meta_by_ancestors", ANCESTOR_SQL)
def q_meta_by_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J14 over all folders above a run. Stand-in: an order is a run folder
    below its customer and nation; suppliers put several files at their nation's
    folder, customers with a high balance one at theirs."""
    place = lambda *parts: F.concat_ws("/", F.lit("/ckpt"), *[F.col(p).cast("string") for p in parts])
    c, s, o = (table(spark, sf_dir, t) for t in ("customer", "supplier", "orders"))
    runs = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(place("c_nationkey", "c_custkey", "o_orderkey").alias("dir"))
    meta = s.filter(F.col("s_nationkey") % 3 != 0).select(place("s_nationkey").alias("path"), F.col("s_name").alias("dataset"))
    meta = meta.unionByName(c.filter(F.col("c_acctbal") > 5000).select(place("c_nationkey", "c_custkey").alias("path"), F.col("c_name").alias("dataset")))
    return first_hit_lookup(runs, meta, ancestor_paths("dir"))
