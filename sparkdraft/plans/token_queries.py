"""Tokenization queries over the normalized conversations and documents."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdraft.operators.fingerprints import content_parts, dataset_fingerprint, digest_text, merge_parts
from sparkdraft.operators.ordering import with_global_index
from sparkdraft.operators.tokens import (
    IGNORE_INDEX,
    TEST_EOS_TEXT,
    TEST_PAD_ID,
    TEST_TEMPLATE,
    apply_template,
    batch_id,
    char_token_ids,
    left_truncate,
    pad_to_batch_max,
    prompt_budget,
    tokenize_records,
    truncation_count,
)
from sparkdraft.plans.prep_queries import (
    ALPACA_NORMALIZE_SQL,
    FIRST_EXCHANGE_SQL,
    chat_records,
    q_alpaca_normalize,
)
from sparkdraft.plans.registry import register, table
from sparkdraft.plugins.generation import apply_collator, length_batches, pad_collator

CHAT_MAX_LEN = 4096
BATCH_SIZE = 8
MODEL_LEN, MAX_NEW = 256, 64


def _checksum(ids: str) -> F.Column:
    """sum(id * position) over a token array (1-based positions)."""
    return F.aggregate(
        F.transform(ids, lambda x, i: x.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, b: a + b
    )


def _tok_sql(records_sql: str, max_len: int | None) -> str:
    pre, post = TEST_TEMPLATE.split("{text}")
    return f"""
WITH rec AS ({records_sql}),
txt AS (SELECT id, '{pre}' || prompt_text || '{post}' AS p, response_text || '{TEST_EOS_TEXT}' AS r FROM rec),
ids AS (SELECT id,
   CASE WHEN length(p) = 0 THEN []::INTEGER[] ELSE list_transform(string_split(p, ''), lambda c: CAST(2 + unicode(c) % 101 AS INTEGER)) END AS pids,
   CASE WHEN length(r) = 0 THEN []::INTEGER[] ELSE list_transform(string_split(r, ''), lambda c: CAST(2 + unicode(c) % 101 AS INTEGER)) END AS rids
   FROM txt),
ex0 AS (SELECT id, list_concat(pids, rids)[1:{max_len or ''}] AS ids, len(pids) AS np FROM ids),
ex AS (SELECT id, ids, least(np, len(ids)) AS plen, len(ids) - least(np, len(ids)) AS rlen FROM ex0 WHERE len(ids) - least(np, len(ids)) > 0)
"""


TOKENIZE_CHAT_SQL = _tok_sql(FIRST_EXCHANGE_SQL, CHAT_MAX_LEN) + """
SELECT id, CAST(len(ids) AS INTEGER) AS n_tokens, CAST(plen AS INTEGER) AS prompt_len, CAST(rlen AS INTEGER) AS response_len,
       array_to_string(ids, ',') AS input_ids,
       CAST(coalesce(list_sum(ids[plen + 1:]), 0) - 100 * plen AS BIGINT) AS label_sum
FROM ex
"""


def _summarize(ex: DataFrame) -> DataFrame:
    return ex.select(
        "id",
        F.size("input_ids").alias("n_tokens"),
        "prompt_len",
        "response_len",
        F.array_join("input_ids", ",").alias("input_ids"),
        F.aggregate("labels", F.lit(0).cast("long"), lambda a, b: a + b).alias("label_sum"),
    )


@register("tokenize_chat", TOKENIZE_CHAT_SQL)
def q_tokenize_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P09 template + P10 EOS + X07 char ids + X08 labels/masks + F03 over
    the canonical chat records."""
    ex = tokenize_records(chat_records(spark, sf_dir).select("id", "prompt_text", "response_text"),
                          max_seq_len=CHAT_MAX_LEN)
    return _summarize(ex)


TOKENIZE_DOCS_SQL = _tok_sql(ALPACA_NORMALIZE_SQL, None) + """
SELECT id, CAST(len(ids) AS INTEGER) AS n_tokens, CAST(plen AS INTEGER) AS prompt_len, CAST(rlen AS INTEGER) AS response_len,
       CAST(list_sum(list_transform(ids, lambda x, i: CAST(x AS BIGINT) * i)) AS BIGINT) AS checksum
FROM ex
"""


@register("tokenize_documents", TOKENIZE_DOCS_SQL)
def q_tokenize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-document tokenization of the Alpaca-normalized documents."""
    recs = q_alpaca_normalize(spark, sf_dir).select("id", "prompt_text", "response_text")
    ex = tokenize_records(recs, max_seq_len=None)
    return ex.select(
        "id",
        F.size("input_ids").alias("n_tokens"),
        "prompt_len",
        "response_len",
        _checksum("input_ids").alias("checksum"),
    )


PAD_SQL = _tok_sql(FIRST_EXCHANGE_SQL, CHAT_MAX_LEN) + f"""
, b AS (SELECT *, (row_number() OVER (ORDER BY id) - 1) // {BATCH_SIZE} AS batch_id FROM ex),
p AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS padded_len FROM b)
SELECT id, CAST(batch_id AS BIGINT) AS batch_id, CAST(len(ids) AS INTEGER) AS n_tokens,
       CAST(padded_len AS INTEGER) AS padded_len, CAST(padded_len - len(ids) AS INTEGER) AS n_pad,
       CAST(list_sum(list_transform(list_concat(ids, list_transform(range(padded_len - len(ids)), lambda z: 0)), lambda x, i: CAST(x AS BIGINT) * i)) AS BIGINT) AS checksum,
       CAST(CASE WHEN padded_len > len(ids) THEN -100 ELSE ids[len(ids)] END AS INTEGER) AS last_label,
       CAST(plen + (padded_len - len(ids)) AS INTEGER) AS n_unsupervised
FROM p
"""


@register("pad_batches", PAD_SQL)
def q_pad_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W01 position by id, W04 batches of 8, W05 padding to the batch max."""
    ex = tokenize_records(chat_records(spark, sf_dir).select("id", "prompt_text", "response_text"),
                          max_seq_len=CHAT_MAX_LEN)
    ix = with_global_index(ex, ["id"], "idx").withColumn("batch_id", batch_id("idx", BATCH_SIZE))
    padded = pad_to_batch_max(ix, "batch_id")
    return padded.select(
        "id",
        "batch_id",
        (F.size("input_ids") - F.col("n_pad")).alias("n_tokens"),
        F.size("input_ids").alias("padded_len"),
        F.col("n_pad").cast("int").alias("n_pad"),
        _checksum("input_ids").alias("checksum"),
        F.element_at("labels", -1).alias("last_label"),
        F.size(F.filter("response_mask", lambda m: ~m)).alias("n_unsupervised"),
    )


@register("collated_batches", PAD_SQL.replace("ORDER BY id", "ORDER BY len(ids), id"))
def q_collated_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's collator pads batches of 8 examples of like length, each
    batch a group of its own."""
    ex = tokenize_records(chat_records(spark, sf_dir).select("id", "prompt_text", "response_text"), max_seq_len=CHAT_MAX_LEN)
    batches = length_batches(ex, F.size("input_ids"), "id", BATCH_SIZE)
    schema = "id string, input_ids array<int>, attention_mask array<int>, labels array<int>, response_mask array<boolean>, batch_id bigint, n_pad int"
    padded = apply_collator(batches.drop("prompt_len", "response_len"), "batch_id", pad_collator(TEST_PAD_ID, IGNORE_INDEX), schema, most=BATCH_SIZE)
    return padded.select(
        "id",
        "batch_id",
        (F.size("input_ids") - F.col("n_pad")).alias("n_tokens"),
        F.size("input_ids").alias("padded_len"),
        "n_pad",
        _checksum("input_ids").alias("checksum"),
        F.element_at("labels", -1).alias("last_label"),
        F.size(F.filter("response_mask", lambda m: ~m)).alias("n_unsupervised"),
    )


def _truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = chat_records(spark, sf_dir)
    ids = char_token_ids(apply_template("prompt_text", TEST_TEMPLATE), "identity")
    return recs.select("id", left_truncate(ids, prompt_budget(MODEL_LEN, MAX_NEW)).alias("t"))


_TRUNC_SQL_BODY = f"""
WITH rec AS ({FIRST_EXCHANGE_SQL}),
ids AS (SELECT id, list_transform(string_split('{TEST_TEMPLATE.split("{text}")[0]}' || prompt_text || '{TEST_TEMPLATE.split("{text}")[1]}', ''), lambda c: CAST(unicode(c) AS INTEGER)) AS a FROM rec),
t AS (SELECT id, a, len(a) AS n, a[greatest(len(a) - {prompt_budget(MODEL_LEN, MAX_NEW)}, 0) + 1:] AS kept FROM ids)
"""

TRUNCATE_SQL = _TRUNC_SQL_BODY + f"""
SELECT id, CAST(n AS INTEGER) AS tokens_original, CAST(len(kept) AS INTEGER) AS tokens_used,
       n > {prompt_budget(MODEL_LEN, MAX_NEW)} AS truncated,
       CAST(list_sum(list_transform(kept, lambda x, i: CAST(x AS BIGINT) * i)) AS BIGINT) AS checksum
FROM t
"""


@register("truncate_prompts", TRUNCATE_SQL)
def q_truncate_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templated prompts (identity char ids) left-truncated to
    max(1, model_len - max_new_tokens) tokens."""
    t = _truncated(spark, sf_dir)
    return t.select(
        "id",
        F.col("t.tokens_original").alias("tokens_original"),
        F.col("t.tokens_used").alias("tokens_used"),
        F.col("t.truncated").alias("truncated"),
        _checksum("t.ids").alias("checksum"),
    )


TRUNC_COUNT_SQL = _TRUNC_SQL_BODY + f"""
SELECT CAST(count(*) FILTER (WHERE n > {prompt_budget(MODEL_LEN, MAX_NEW)}) AS BIGINT) AS n_truncated FROM t
"""


@register("truncation_count", TRUNC_COUNT_SQL)
def q_truncation_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts truncated during generation prep."""
    return truncation_count(_truncated(spark, sf_dir), "t.truncated")


_FP_COLS = ["id", "prompt_text", "response_text", "source"]


def _lanes_sql(cols: list[str]) -> str:
    """Sums modulo 2**60 of the four lanes of each row's hash, twin of ``content_parts``."""
    row = " || ".join(f"coalesce(length({c}) || ':' || {c}, '-')" for c in cols)
    lanes = (f"coalesce(sum(CAST(('0x' || substr(sha256({row}), {1 + 15 * i}, 15))::BIGINT AS HUGEINT)), 0) % {1 << 60} AS lane{i}" for i in range(4))
    return "count(*) AS n_rows, " + ", ".join(lanes)


_DIGEST_SQL = "concat_ws('-', " + ", ".join(f"CAST(lane{i} AS VARCHAR)" for i in range(4)) + ")"
_FP_SETTINGS = json.dumps(
    {"columns": [[c, "string"] for c in _FP_COLS], "tokenizer": "char-mod101", "template": TEST_TEMPLATE, "max_seq_len": CHAT_MAX_LEN, "add_eos": True, "mask": "response_only_v1"}, sort_keys=True
)
FP_SQL = f"""
WITH rec AS ({FIRST_EXCHANGE_SQL}),
l AS (SELECT {_lanes_sql(_FP_COLS)} FROM rec),
d AS (SELECT CAST(n_rows AS BIGINT) AS n_rows, {_DIGEST_SQL} AS digest FROM l)
SELECT n_rows, digest, substr(sha256(concat_ws('|', CAST(n_rows AS VARCHAR), digest, '{_FP_SETTINGS}')), 1, 16) AS fingerprint
FROM d
"""


@register("chat_fingerprint", FP_SQL)
def q_chat_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-addressed key of the tokenized chat dataset."""
    recs = chat_records(spark, sf_dir)
    return dataset_fingerprint(recs, _FP_COLS, tokenizer_name="char-mod101", template=TEST_TEMPLATE, max_seq_len=CHAT_MAX_LEN)


MERGED_SQL = f"""
WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS id, nullif(text, '') AS text, lang, source FROM documents),
parts AS (SELECT source, lang, {_lanes_sql(["id", "text", "lang", "source"])} FROM d GROUP BY source, lang),
by_source AS (SELECT source, {_lanes_sql(["id", "text", "lang", "source"])} FROM d GROUP BY source),
whole AS (SELECT {_lanes_sql(["id", "text", "lang", "source"])} FROM d)
SELECT 'part' AS level, source, lang, CAST(n_rows AS BIGINT) AS n_rows, {_DIGEST_SQL} AS digest FROM parts
UNION ALL SELECT 'source', source, NULL, CAST(n_rows AS BIGINT), {_DIGEST_SQL} FROM by_source
UNION ALL SELECT 'whole', NULL, NULL, CAST(n_rows AS BIGINT), {_DIGEST_SQL} FROM whole
"""


@register("merged_fingerprints", MERGED_SQL)
def q_merged_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the documents by source and language; those of sources
    and of the whole table are merged from them, no text is read again. The
    oracle reads all texts for each level."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.nullif(F.col("text"), F.lit("")).alias("text"), "lang", "source")
    parts = content_parts(d, ["id", "text", "lang", "source"], by=["source", "lang"])
    none = F.lit(None).cast("string")
    levels = [
        parts.withColumn("level", F.lit("part")),
        merge_parts(parts, ["source"]).withColumns({"level": F.lit("source"), "lang": none}),
        merge_parts(merge_parts(parts, ["source"])).withColumns({"level": F.lit("whole"), "source": none, "lang": none}),
    ]
    rows = [x.select("level", "source", "lang", "n_rows", digest_text().alias("digest")) for x in levels]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


SHORT_LEN = 160
TOKENIZE_SHORT_SQL = _tok_sql(FIRST_EXCHANGE_SQL, SHORT_LEN) + """
SELECT id, CAST(len(ids) AS INTEGER) AS n_tokens, CAST(plen AS INTEGER) AS prompt_len, CAST(rlen AS INTEGER) AS response_len,
       array_to_string(ids, ',') AS input_ids,
       CAST(coalesce(list_sum(ids[plen + 1:]), 0) - 100 * plen AS BIGINT) AS label_sum
FROM ex
"""


@register("tokenize_truncated", TOKENIZE_SHORT_SQL)
def q_tokenize_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X08 + F03 at a length that cuts most records: what is beyond it goes,
    and records left without a response token are dropped."""
    return _summarize(tokenize_records(chat_records(spark, sf_dir).select("id", "prompt_text", "response_text"), max_seq_len=SHORT_LEN))
