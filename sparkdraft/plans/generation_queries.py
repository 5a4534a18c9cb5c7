"""Batch generation and scoring queries.

* target generation (E2): canonical chat records -> chat template ->
  identity char ids left-truncated to the prompt budget (X09) -> batched
  generation through ``mapInPandas`` (U03, whole records travel along; the stand-in model echoes its
  prompt) -> P14 rewrite with the per-job timestamp.
* quality scores (U01/A30): ``documents`` joined to ``labels``; the
  generation is the document text, the target generation is the same
  text for quality-1 documents and the language code otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdraft.operators.tokens import TEST_TEMPLATE, apply_template, char_token_ids, left_truncate, prompt_budget
from sparkdraft.plans.prep_queries import FIRST_EXCHANGE_SQL, chat_records
from sparkdraft.plans.registry import register, strip_sql, table
from sparkdraft.plugins.generation import generate_responses, prompt_echo_generator, rewrite_response
from sparkdraft.plugins.corpus_scores import CorpusScore, CorpusScores
from sparkdraft.plugins.scorers import ScoreTable

MODEL_LEN, MAX_NEW = 256, 64
GENERATED_AT = "2026-01-01T00:00:00+00:00"
BUDGET = prompt_budget(MODEL_LEN, MAX_NEW)
PRE, POST = TEST_TEMPLATE.split("{text}")

GEN_SQL = f"""
WITH rec AS ({FIRST_EXCHANGE_SQL}),
t AS (SELECT id, response_text, '{PRE}' || prompt_text || '{POST}' AS templ FROM rec),
k AS (SELECT id, response_text, length(templ) AS n, substr(templ, greatest(length(templ) - {BUDGET}, 0) + 1) AS kept FROM t)
SELECT id, {strip_sql('kept')} AS response_text, 'target' AS source, response_text AS original_response_text,
       '{GENERATED_AT}' AS response_generated_at, CASE WHEN n > {BUDGET} THEN true END AS target_prompt_truncated,
       CASE WHEN n > {BUDGET} THEN CAST(n AS INTEGER) END AS target_prompt_tokens_original,
       CASE WHEN n > {BUDGET} THEN CAST(length(kept) AS INTEGER) END AS target_prompt_tokens_used
FROM k
"""


@register("target_generation", GEN_SQL)
def q_target_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template + left truncation + batched generation (mapInPandas,
    records carried with each batch) + P14 rewrite of every chat record."""
    recs = chat_records(spark, sf_dir)
    templated = apply_template("prompt_text", TEST_TEMPLATE)
    ids = char_token_ids(templated, "identity")
    trunc = recs.withColumn("_t", left_truncate(ids, BUDGET))
    # With one id per character the last ids are the text's last characters.
    # Truncation metadata exists only for prompts that were truncated
    # (absent keys are null fields of the typed struct).
    cut = F.col("_t.truncated")
    meta = F.col("metadata")
    for key, value in (("truncated", F.lit(True)), ("tokens_original", F.col("_t.tokens_original")), ("tokens_used", F.col("_t.tokens_used"))):
        meta = meta.withField(f"target_prompt_{key}", F.when(cut, value))
    prompts = trunc.select("id", "prompt_text", "response_text", "source", meta.alias("metadata"), F.right(templated, F.lit(BUDGET)).alias("prompt_input"))
    gens = generate_responses(prompts, prompt_echo_generator, {"temperature": 0.0}, request_batch_size=16)
    out = rewrite_response(gens, GENERATED_AT)
    return out.select(
        "id",
        "response_text",
        "source",
        F.col("metadata.original_response_text").alias("original_response_text"),
        F.col("metadata.response_generated_at").alias("response_generated_at"),
        F.col("metadata.target_prompt_truncated").alias("target_prompt_truncated"),
        F.col("metadata.target_prompt_tokens_original").alias("target_prompt_tokens_original"),
        F.col("metadata.target_prompt_tokens_used").alias("target_prompt_tokens_used"),
    )


SCORE_SQL = f"""
SELECT 'exact_match_vs_target' AS name,
       round(coalesce(avg(CASE WHEN {strip_sql('d.text')} = {strip_sql("CASE WHEN l.quality = 1 THEN d.text ELSE d.lang END")} THEN 1.0 ELSE 0.0 END), 0.0), 9) AS score
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""


@register("quality_scores", SCORE_SQL)
def q_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U01 + A30: declared scores over generations; unknown names give no row."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    g = d.join(lab, "doc_id").select(
        F.col("text").alias("generation"),
        F.when(F.col("quality") == 1, F.col("text")).otherwise(F.col("lang")).alias("target_generation"),
    )
    s = ScoreTable().scores(g, ["exact_match_vs_target", "not_declared"])
    return s.select("name", F.round("score", 9).alias("score"))


def _grams_sql(n: int) -> str:
    """Counts of word n-grams by record and side."""
    words = "string_split({}, ' ')"
    gram = " || ' ' || ".join(f"w[i + {k}]" if k else "w[i]" for k in range(n))
    listed = " UNION ALL ".join(f"SELECT id, '{side}' AS side, {words.format(col)} AS w FROM rec" for side, col in (("g", "response_text"), ("t", "prompt_text")))
    return f"(SELECT id, side, gram, count(*) AS n FROM (SELECT id, side, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: {gram})) AS gram FROM ({listed})) GROUP BY id, side, gram)"


def _overlap_sql(n: int) -> str:
    g = _grams_sql(n)
    return f"(SELECT round(coalesce(sum(least(g.n, coalesce(t.n, 0))) / sum(g.n), 0.0), 9) FROM {g} g LEFT JOIN {g} t ON t.id = g.id AND t.gram = g.gram AND t.side = 't' WHERE g.side = 'g')"


CORPUS_SCORE_SQL = f"""
WITH rec AS (SELECT meta_conversation_id AS id, prompt_text, response_text FROM ({FIRST_EXCHANGE_SQL}))
SELECT 'pooled_unigram_overlap' AS name, CAST({_overlap_sql(1)} AS DOUBLE) AS score, CAST(NULL AS VARCHAR) AS problem
UNION ALL SELECT 'pooled_bigram_overlap', CAST({_overlap_sql(2)} AS DOUBLE), NULL
UNION ALL SELECT 'longest_answer', CAST((SELECT max(length(response_text)) FROM rec) AS DOUBLE), NULL
UNION ALL SELECT 'fails_on_rows', NULL, 'ValueError: no score for this row'
UNION ALL SELECT 'fails_at_the_end', NULL, 'ends in nan'
UNION ALL SELECT 'unknown', NULL, 'not declared'
"""


def _refuse(state: int, rows) -> int:
    raise ValueError("no score for this row")


@register("corpus_scores", CORPUS_SCORE_SQL)
def q_corpus_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U01 + A30 over a whole table: pooled n-gram overlaps of answers with
    their prompts and a user's score, in one pass; scores that fail on a row or
    at the end leave their reason."""
    recs = chat_records(spark, sf_dir).select(F.col("response_text").alias("generation"), F.col("prompt_text").alias("target_generation"))
    longest = CorpusScore(("generation",), lambda: 0, lambda s, rows: max(s, int(rows["generation"].str.len().max())), max, float)
    scores = CorpusScores({
        "longest_answer": longest,
        "fails_on_rows": CorpusScore(("generation",), lambda: 0, _refuse, max, float),
        "fails_at_the_end": CorpusScore(("generation",), lambda: 0, lambda s, rows: s, max, lambda s: float("nan")),
    }).scores(recs, ["pooled_unigram_overlap", "pooled_bigram_overlap", "longest_answer", "fails_on_rows", "fails_at_the_end", "unknown"])
    return scores.select("name", F.round("score", 9).alias("score"), "problem")
