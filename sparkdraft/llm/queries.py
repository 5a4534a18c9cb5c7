"""The registered queries of this subpackage: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op8_best_fit_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    from sparkdraft.llm.packing import pack_documents

    return pack_documents(spark, table(spark, sf_dir, "documents"), tokenizer_path())


@query("op2_simhash_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    from pyspark.sql import functions as F

    from sparkdraft.llm.simhash import simhash_components

    found = simhash_components(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op7_substring_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 35-word windows that occur elsewhere too."""
    from pyspark.sql import functions as F

    from sparkdraft.llm.rlz import without_repeats

    found = without_repeats(spark, table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op6_lm_scoring")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffix-tree and unigram log10 probability of every document."""
    from sparkdraft.llm.folds import held_out_of
    from sparkdraft.llm.pst import score_texts

    return score_texts(spark, table(spark, sf_dir, "documents"), held_out_of("doc_id", 7, 2))


@query("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from those not held out."""
    from sparkdraft.llm.folds import held_out_of
    from sparkdraft.llm.langid import identify, prototypes

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out_of("doc_id", 4, 2).alias("held_out"))
    langs, matrix = prototypes(docs.filter("not held_out"))
    return identify(spark, docs, langs, matrix, ["doc_id", "held_out"])


@query("op1_benchmark_decontamination")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of a benchmark item in a document."""
    from sparkdraft.llm.decontam import contaminated

    return contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])


@query("op10_approximate_nearest_neighbours")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest found of every 50th vector."""
    from pyspark.sql import functions as F

    from sparkdraft.llm.rpforest import nearest

    return nearest(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


from sparkdraft.llm.licenses import oracle_sql as license_sql  # noqa: E402


@query("op5_license_scans", license_sql())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and detected license labels of every document."""
    from sparkdraft.llm.licenses import license_labels

    return license_labels(table(spark, sf_dir, "documents"), ["doc_id"])


from sparkdraft.llm.linetree import oracle_sql as line_sql  # noqa: E402


@query("op3_line_dedup", line_sql())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines of recurring templates."""
    from sparkdraft.llm.linetree import drop_recurring_lines

    return drop_recurring_lines(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))


from sparkdraft.llm.preference import ORACLE_SQL as PREFERENCE_SQL  # noqa: E402


@query("op9_preference_formatting", PREFERENCE_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt and masked completions of every conversation and its worse twin."""
    from pyspark.sql import functions as F

    from sparkdraft.llm.preference import conversation_pairs, preference_pairs

    found = preference_pairs(conversation_pairs(table(spark, sf_dir, "conversations")))
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return found.withColumns({c: written(c) for c in ("chosen_loss", "rejected_loss")})


@query("op11_periodic_run_detection")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of periodic words in every document, some of which are made periodic."""
    from sparkdraft.llm.periods import periodic_runs, run_digests, with_planted_period

    return run_digests(periodic_runs(with_planted_period(table(spark, sf_dir, "documents")), ["doc_id"]))


@query("op12_pii")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    from sparkdraft.llm.pii import personal_data, span_digests

    return span_digests(personal_data(table(spark, sf_dir, "documents"), ["doc_id"]))


from sparkdraft.llm.resample import ORACLE_SQL as RESAMPLE_SQL  # noqa: E402


@query("op13_importance_resampling", RESAMPLE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights towards the benchmark's distribution, and the documents drawn by them."""
    from sparkdraft.llm.resample import drawn

    found = drawn(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")
