"""Corpus pipeline: stages that each call one operator of the training-data subpackage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``. All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkdraft.llm.decontam import without_contaminated
from sparkdraft.llm.langid import DIM, UNDETERMINED, identify, prototypes
from sparkdraft.llm.linetree import drop_recurring_lines
from sparkdraft.llm.packing import pack_documents
from sparkdraft.llm.queries import table, tokenizer_path
from sparkdraft.llm.simhash import one_of_each_group
from sparkdraft.llm.store import stored


#: Letters from which on a text's score says something, and the score up to which it is that of
#: unrelated vectors: cosines of random vectors in DIM dimensions deviate by 1 / sqrt(DIM); twice that.
LEAST_LETTERS = 20
NOISE = 2 * DIM**-0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, by prototypes learned from their
    labels. A text is rejected if it is null or has no letter, or if it has
    LEAST_LETTERS letters and is no nearer to any language than unrelated vectors
    are (other scripts, lists of codes, one repeated word). Without any label
    nothing can be learned, and all documents pass."""
    langs, matrix = prototypes(docs.select("lang", "text"))
    if not langs:
        return docs
    # The row travels as one struct, so that no column name can clash.
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    letters = F.length(F.regexp_replace(F.col("row").getField("text").cast("string"), r"[^\p{L}]", ""))
    told = (F.col("lang_pred") != UNDETERMINED) & ((F.col("score") > NOISE) | (letters < LEAST_LETTERS))
    return identify(spark, packed, langs, matrix, ["row"]).filter(told).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of recurring templates; n_chars follows the text."""
    found = drop_recurring_lines(spark, docs, counts=False)
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return one_of_each_group(spark, docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return without_contaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces packed into sequences of at most 1024 tokens."""
    return pack_documents(spark, docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Profiles, alignments, tokenization and packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(spark, docs, f"stage-{name}")
    return docs
