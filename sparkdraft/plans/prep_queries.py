"""Prep queries: conversations and documents as raw chat / Alpaca rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdraft.operators.ordering import index_by_key, join_by_key, with_global_index
from sparkdraft.operators.prep import first_exchange_fold, first_exchange_turns, from_chat_or_pr, normalize_rows, prepare_splits, rows_per_split, split_assignment
from sparkdraft.plans.registry import register, strip_sql, table


def flatten_records(recs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Canonical records with the metadata fields as top-level columns."""
    return recs.select(
        "id",
        "prompt_text",
        "response_text",
        "source",
        F.col("metadata.dataset").alias("meta_dataset"),
        F.col("metadata.split").alias("meta_split"),
        F.col("metadata.source_index").alias("meta_source_index"),
        *[F.col("metadata." + k).alias("meta_" + k) for k in extra],
    )


def chat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in: ``conversations`` turns -> one chat row per conversation
    (P03 table form), positioned by conv_id, then P08."""
    turns = table(spark, sf_dir, "conversations")
    # Only the ids are sorted and checkpointed; the texts meet their position by id.
    position = with_global_index(turns.select("conv_id").distinct(), ["conv_id"], "source_index")
    indexed = first_exchange_turns(turns).join(position, "conv_id")
    raw = indexed.select(
        F.col("conv_id").alias("conversation_id"),
        F.col("prompt").alias("prompt_text"),
        F.col("response").alias("response_text"),
        "source_index",
    )
    return normalize_rows(raw, family="chat", dataset_name="conversations", split="train")


FIRST_EXCHANGE_SQL = f"""
WITH t AS (SELECT conv_id, turn, lower(role) AS role, text FROM conversations),
u AS (SELECT conv_id, arg_min(text, turn) AS prompt, min(turn) AS u_turn FROM t
      WHERE role IN ('user', 'human') AND text IS NOT NULL AND text <> '' GROUP BY conv_id),
a AS (SELECT t.conv_id, arg_min(t.text, t.turn) AS response FROM t JOIN u
      ON t.conv_id = u.conv_id AND t.turn > u.u_turn
      WHERE t.role IN ('assistant', 'gpt', 'bot') GROUP BY t.conv_id),
c AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS source_index
      FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, c.source_index, {strip_sql('u.prompt')} AS prompt_text,
             {strip_sql('a.response')} AS response_text
      FROM c LEFT JOIN u ON c.conv_id = u.conv_id LEFT JOIN a ON c.conv_id = a.conv_id)
SELECT CASE WHEN conv_id <> 0 THEN CAST(conv_id AS VARCHAR) ELSE CAST(source_index AS VARCHAR) END AS id,
       prompt_text, response_text, 'chat' AS source, 'conversations' AS meta_dataset,
       'train' AS meta_split, source_index AS meta_source_index,
       CAST(conv_id AS VARCHAR) AS meta_conversation_id
FROM r WHERE prompt_text <> '' AND response_text <> ''
"""


@register("first_exchange", FIRST_EXCHANGE_SQL)
def q_first_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slice 0: conversations -> first user/assistant exchange -> canonical
    records (P03 + P04 + P05 + P06 + P07 + P08)."""
    return flatten_records(chat_records(spark, sf_dir), extra=("conversation_id",))


# ---------------------------------------------------------------------------
# documents as Alpaca rows
# ---------------------------------------------------------------------------


def alpaca_rows(docs: DataFrame) -> DataFrame:
    """Stand-in: instruction = first line of ``text``, input = ``source``,
    output = the rest of ``text`` ("" without a newline), category = lang."""
    return docs.select(
        F.col("doc_id").alias("id"),
        F.substring_index("text", "\n", 1).alias("instruction"),
        F.col("source").alias("input"),
        F.regexp_extract("text", r"(?s)^[^\n]*\n(.*)$", 1).alias("output"),
        F.col("lang").alias("category"),
        F.col("source"),
    )


ALPACA_RAW_SQL = r"""
SELECT doc_id,
       CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, 1, strpos(text, chr(10)) - 1) ELSE text END AS instruction,
       source AS inp,
       regexp_extract(text, '(?s)^[^\n]*\n(.*)$', 1) AS output,
       lang, source
FROM documents
"""


def _alpaca_norm_sql(raw_with_idx: str, idx: str) -> str:
    """SQL twin of P01 + P04 over a relation with an index column."""
    return f"""
SELECT doc_id, {idx}, lang, source,
       {strip_sql("CASE WHEN nullif(instruction, '') IS NOT NULL AND nullif(inp, '') IS NOT NULL "
                  "THEN instruction || chr(10) || chr(10) || 'Input:' || chr(10) || inp "
                  "ELSE nullif(instruction, '') END")} AS prompt_text,
       {strip_sql("nullif(output, '')")} AS response_text
FROM {raw_with_idx}
"""


ALPACA_NORMALIZE_SQL = f"""
WITH raw AS ({ALPACA_RAW_SQL}),
ix AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM raw),
r AS ({_alpaca_norm_sql('ix', 'idx')})
SELECT CASE WHEN doc_id <> 0 THEN CAST(doc_id AS VARCHAR) ELSE CAST(idx AS VARCHAR) END AS id,
       prompt_text, response_text, 'alpaca' AS source, 'documents' AS meta_dataset, 'train' AS meta_split,
       idx AS meta_source_index, lang AS meta_category, source AS meta_source
FROM r WHERE prompt_text <> '' AND response_text <> ''
"""


@register("alpaca_normalize", ALPACA_NORMALIZE_SQL)
def q_alpaca_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P01 + P04-P08 over every document read as an Alpaca row, positioned
    by doc_id."""
    raw = index_by_key(alpaca_rows(table(spark, sf_dir, "documents")), ["id"], ["id"], "source_index")
    recs = normalize_rows(raw, family="Alpaca", dataset_name="documents", split="train")
    return flatten_records(recs, extra=("category", "source"))


SPLIT_SEED = 7


def split_sizes_for(n_rows: int) -> tuple[int, int, int]:
    """Split budget as fractions of the table (60/10/10 %), so the cut and
    the eval shrinkage from dropped rows both happen at every scale."""
    return n_rows * 6 // 10, n_rows // 10, n_rows // 10


def split_settings(docs: DataFrame, limit: int | None = None) -> dict:
    t, v, e = split_sizes_for(docs.count())
    return dict(family="alpaca", key_col="id", seed=SPLIT_SEED, n_train=t, n_val=v, n_eval=e, limit=limit)


def documents_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return prepare_splits(alpaca_rows(docs), dataset_name="documents", source_split="train", **split_settings(docs))


def documents_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits and positions of the documents, without their texts."""
    docs = table(spark, sf_dir, "documents")
    return split_assignment(alpaca_rows(docs), **split_settings(docs))


_SIZES_SQL = """
sz AS (SELECT n * 6 // 10 AS t, n // 10 AS v, n // 10 AS e FROM (SELECT count(*) AS n FROM documents))
"""

PREPARE_SPLITS_BODY = f"""
WITH raw AS ({ALPACA_RAW_SQL}), {_SIZES_SQL},
s AS (SELECT raw.*, row_number() OVER (ORDER BY sha256('{SPLIT_SEED}:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS src_idx FROM raw),
cut AS (SELECT s.* FROM s, sz WHERE s.src_idx < sz.t + sz.v + sz.e),
r AS ({_alpaca_norm_sql('cut', 'src_idx')}),
kept AS (SELECT *, row_number() OVER (ORDER BY src_idx) - 1 AS pos FROM r WHERE prompt_text <> '' AND response_text <> ''),
lab AS (SELECT kept.*, CASE WHEN pos < t THEN 'train' WHEN pos < t + v THEN 'val' WHEN pos < t + v + e THEN 'eval' END AS split,
               CASE WHEN pos < t THEN pos WHEN pos < t + v THEN pos - t ELSE pos - t - v END AS split_pos
        FROM kept, sz)
"""

PREPARE_SPLITS_SQL = PREPARE_SPLITS_BODY + """
SELECT CASE WHEN doc_id <> 0 THEN CAST(doc_id AS VARCHAR) ELSE CAST(src_idx AS VARCHAR) END AS id,
       split, split_pos, src_idx AS meta_source_index, prompt_text, response_text
FROM lab WHERE split IS NOT NULL
"""


@register("prepare_splits", PREPARE_SPLITS_SQL)
def q_prepare_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded shuffle (W02) -> position (W01) -> budget cut before
    normalization (L02) -> P08/P05 -> dense re-index -> train/val/eval (W03)."""
    s = documents_splits(spark, sf_dir)
    return s.select(
        "id",
        "split",
        "split_pos",
        F.col("metadata.source_index").alias("meta_source_index"),
        "prompt_text",
        "response_text",
    )


#: A limit on the budget: 78 % of the documents, of which train takes 60 % and val 10 %.
LIMITED_SQL = """
SELECT split, count(*) AS n_rows, CAST(min(split_pos) AS BIGINT) AS first_pos, CAST(max(split_pos) AS BIGINT) AS last_pos,
       CAST(sum(src_idx) AS BIGINT) AS index_sum
FROM lab WHERE split IS NOT NULL GROUP BY split
"""
LIMITED_BODY = PREPARE_SPLITS_BODY.replace(_SIZES_SQL, """
sz AS (SELECT n * 6 // 10 AS t, n // 10 AS v, greatest(n * 39 // 50 - n * 6 // 10 - n // 10, 0) AS e FROM (SELECT count(*) AS n FROM documents))
""")


@register("limited_splits", LIMITED_BODY + LIMITED_SQL)
def q_limited_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L02 with a limit: the budget is cut at 78 % of the rows, so
    eval gets what train and val leave of them."""
    docs = table(spark, sf_dir, "documents")
    places = split_assignment(alpaca_rows(docs), **split_settings(docs, limit=docs.count() * 39 // 50))
    return places.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("split_pos").alias("first_pos"), F.max("split_pos").alias("last_pos"), F.sum("source_index").alias("index_sum")
    )


SPLIT_COUNTS_SQL = PREPARE_SPLITS_BODY + """
SELECT n.split, CAST(coalesce(c.n_rows, 0) AS BIGINT) AS n_rows
FROM (VALUES ('train'), ('val'), ('eval')) n(split)
LEFT JOIN (SELECT split, count(*) AS n_rows FROM lab WHERE split IS NOT NULL GROUP BY split) c ON n.split = c.split
"""


@register("split_counts", SPLIT_COUNTS_SQL)
def q_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per split of the E1 output, zero-count splits included."""
    return rows_per_split(documents_places(spark, sf_dir))


SPLIT_COMPLETENESS_SQL = PREPARE_SPLITS_BODY + """
, ex AS (SELECT 'train' AS split, t AS expected_rows FROM sz UNION ALL SELECT 'val', v FROM sz UNION ALL SELECT 'eval', e FROM sz),
c AS (SELECT split, count(*) AS n_rows FROM lab WHERE split IS NOT NULL GROUP BY split)
SELECT ex.split, ex.expected_rows, CAST(coalesce(c.n_rows, 0) AS BIGINT) AS n_rows,
       (c.n_rows IS NOT NULL AND (ex.expected_rows <= 0 OR c.n_rows >= ex.expected_rows)) AS complete
FROM ex LEFT JOIN c ON ex.split = c.split
"""


@register("split_completeness", SPLIT_COMPLETENESS_SQL)
def q_split_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actual rows per split vs the requested budget."""
    from sparkdraft.operators.prep import completeness

    docs = table(spark, sf_dir, "documents")
    t, v, e = split_sizes_for(docs.count())
    counts = documents_places(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))
    expected = spark.createDataFrame(
        [("train", t), ("val", v), ("eval", e)], "split string, expected_rows bigint"
    )
    return completeness(counts, expected)


@register("prompt_records", f"""
WITH rec AS ({FIRST_EXCHANGE_SQL})
SELECT id, prompt_text, response_text, source FROM rec""")
def q_prompt_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation prompts (id, prompt, reference response, source)
    from the canonical chat records."""
    from sparkdraft.operators.prep import prompt_records

    return prompt_records(chat_records(spark, sf_dir), "source_index")


CACHE_SQL = PREPARE_SPLITS_BODY + """
, c AS (SELECT lang AS cache, split, count(*) AS n_rows FROM lab WHERE split IN ('train', 'val') GROUP BY lang, split),
k AS (SELECT cache, row_number() OVER (ORDER BY cache) % 4 AS kind FROM (SELECT DISTINCT lang AS cache FROM documents WHERE lang IS NOT NULL)),
w AS (SELECT k.cache, s.split, CASE WHEN kind = 0 OR (kind = 3 AND s.split = 'val') THEN NULL WHEN kind = 2 AND s.split = 'val' THEN 'target-32b' ELSE 'target-8b' END AS target_model,
             CASE WHEN kind = 0 THEN NULL ELSE c.n_rows END AS n_rows
      FROM k, (VALUES ('train'), ('val')) s(split) LEFT JOIN c ON c.cache = k.cache AND c.split = s.split)
SELECT cache, CASE WHEN count(*) FILTER (WHERE target_model IS NOT NULL OR coalesce(n_rows, 0) > 0) = 0 THEN 'absent'
            WHEN count(*) FILTER (WHERE target_model IS NOT NULL AND target_model <> 'target-8b') > 0 THEN 'mismatch'
            WHEN count(*) FILTER (WHERE target_model IS NULL OR coalesce(n_rows, 0) <= 0) > 0 THEN 'partial'
            ELSE 'reuse' END AS state,
       count(*) FILTER (WHERE target_model IS NOT NULL OR coalesce(n_rows, 0) > 0) AS n_present,
       count(*) FILTER (WHERE target_model IS NOT NULL AND target_model <> 'target-8b') AS n_mismatch,
       count(*) FILTER (WHERE target_model IS NULL OR coalesce(n_rows, 0) <= 0) AS n_incomplete
FROM w GROUP BY cache HAVING count(*) FILTER (WHERE target_model IS NOT NULL OR coalesce(n_rows, 0) > 0) > 0
"""


@register("cache_coherence", CACHE_SQL)
def q_cache_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J12 on the E1 splits: may the cached train and val data of each language be
    used for the expected target model? Stand-in: a language is a cache; by its
    place in the alphabet its manifests name the model, name another one for val,
    lack val, or cache and manifests are missing (no row)."""
    from sparkdraft.operators.sweeps import cache_state

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("cache"))
    kinds = with_global_index(docs.select("cache").filter("cache is not null").distinct(), ["cache"], "place").select("cache", ((F.col("place") + 1) % 4).alias("kind"))
    counts = join_by_key(docs, documents_places(spark, sf_dir), ["id"]).groupBy("cache", "split").agg(F.count(F.lit(1)).alias("n_rows"))
    counts = counts.join(kinds.filter("kind <> 0"), "cache").select("cache", "split", "n_rows")
    named = kinds.filter("kind <> 0").select("cache", "kind", F.explode(F.array(F.lit("train"), F.lit("val"))).alias("split"))
    named = named.filter(~((F.col("kind") == 3) & (F.col("split") == "val")))
    model = F.when((F.col("kind") == 2) & (F.col("split") == "val"), "target-32b").otherwise("target-8b")
    return cache_state(named.select("cache", "split", model.alias("target_model")), counts, "target-8b", cache_col="cache")


OUTPUT_TOKENS_SQL = f"""
WITH rec AS ({FIRST_EXCHANGE_SQL})
SELECT CAST(coalesce(sum(length(response_text)), 0) AS BIGINT) AS output_tokens FROM rec
"""


@register("output_tokens", OUTPUT_TOKENS_SQL)
def q_output_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total generated tokens (identity char ids of every response;
    a missing output counts 0)."""
    from sparkdraft.operators.decode import output_token_count
    from sparkdraft.operators.tokens import char_token_ids

    recs = chat_records(spark, sf_dir)
    return output_token_count(recs.select(char_token_ids("response_text", "identity").alias("token_ids")))


def _code_points() -> object:
    """Tokenizer plug-in factory used by ``udf_tokenize``: texts -> code points."""
    return lambda texts: [[ord(c) for c in s] for s in texts]


UDF_TOKENIZE_SQL = f"""
WITH rec AS ({FIRST_EXCHANGE_SQL})
SELECT id, CAST(length(prompt_text) AS INTEGER) AS n_ids,
       CAST(list_sum(list_transform(string_split(prompt_text, ''), lambda c, i: CAST(unicode(c) AS BIGINT) * i)) AS BIGINT) AS checksum
FROM rec
"""


@register("udf_tokenize", UDF_TOKENIZE_SQL)
def q_udf_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user tokenizer (Python callable, built once per worker) run
    through the Arrow-batched pandas UDF over every chat prompt."""
    from sparkdraft.plugins.generation import tokenizer_udf

    recs = chat_records(spark, sf_dir)
    ids = recs.select("id", tokenizer_udf(_code_points)("prompt_text").alias("ids"))
    checksum = F.aggregate(F.transform("ids", lambda x, i: x.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, b: a + b)
    return ids.select("id", F.size("ids").alias("n_ids"), checksum.alias("checksum"))


MESSAGES_SQL = """
WITH t AS (SELECT conv_id, turn, lower(role) AS role, text, conv_id % 4 AS kind FROM conversations),
u AS (SELECT conv_id, arg_min(text, turn) AS prompt, min(turn) AS u_turn FROM t WHERE role IN ('user', 'human') AND text <> '' GROUP BY conv_id),
a AS (SELECT t.conv_id, arg_min(t.text, t.turn) AS response FROM t JOIN u ON t.conv_id = u.conv_id AND t.turn > u.u_turn
      WHERE t.role IN ('assistant', 'gpt', 'bot') GROUP BY t.conv_id)
SELECT c.conv_id, CASE c.kind WHEN 0 THEN 'messages' WHEN 1 THEN 'conversations' WHEN 2 THEN 'chosen' ELSE 'pair' END AS form,
       CASE WHEN c.kind <> 3 OR a.response <> '' THEN u.prompt END AS prompt, CASE WHEN c.kind <> 3 OR a.response <> '' THEN a.response END AS response
FROM (SELECT DISTINCT conv_id, kind FROM t) c LEFT JOIN u ON u.conv_id = c.conv_id LEFT JOIN a ON a.conv_id = c.conv_id
"""


@register("list_messages", MESSAGES_SQL)
def q_list_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P02 + P03 on one table with every input shape. Stand-in: a
    conversation is a ``messages`` list (role, content), a ``conversations`` list
    (from, value) beside an empty ``messages``, a ``chosen`` list, or the plain
    pair of its first exchange. These formats hold a conversation in one row."""
    t = table(spark, sf_dir, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    c = t.groupBy("conv_id").agg(turns.alias("t"))
    kind = F.col("conv_id") % 4
    named = lambda role, text: F.transform("t", lambda m: F.struct(m["role"].alias(role), m["text"].alias(text)))
    empty = F.array().cast("array<struct<role: string, content: string>>")
    own = T.StructType.fromDDL("role string, content string")
    c = c.withColumn("first", F.when(kind == 3, first_exchange_fold(named("role", "content"), own)))
    rows = c.select(
        "conv_id",
        F.when(kind == 0, named("role", "content")).when(kind == 1, empty).alias("messages"),
        F.when(kind == 1, named("from", "value")).alias("conversations"),
        F.when(kind == 2, named("role", "content")).alias("chosen"),
        F.col("first.prompt").alias("prompt_text"),
        F.col("first.response").alias("response_text"),
    )
    pair = from_chat_or_pr(rows)
    form = F.when(kind == 0, "messages").when(kind == 1, "conversations").when(kind == 2, "chosen").otherwise("pair")
    return rows.select("conv_id", form.alias("form"), pair["prompt"].alias("prompt"), pair["response"].alias("response"))
